"""Long conversations: the work grows with the turns, and reading back is exact."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from murmura.llm import chat, oracles, registered

FOLDER = "/root/testdata/sf0.001"


def long_conversation(spark, turns):
    return spark.range(turns).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é<|im_end|>\\ "), F.col("id"), F.repeat(F.lit("xy"), F.lit(10))).alias("text"),
    )


def test_sql(spark):
    name = "op3_chat_formatting"
    assert difference(registered.queries()[name](spark, FOLDER), connect(FOLDER), oracles.statements()[name]) is None


def test_a_hundred_thousand_turns_take_seconds(spark):
    turns = long_conversation(spark, 100_000)
    start = time.perf_counter()
    back = chat.read_chats(chat.format_chats(turns))
    row = back.select(
        F.size("turns").alias("n"),
        F.md5(F.array_join(F.transform("turns", lambda t: t["text"]), "")).alias("texts"),
        F.size("learned").alias("learned"),
        F.md5(F.array_join("learned", "")).alias("spoken"),
    ).first()
    took = time.perf_counter() - start
    joined = lambda where: F.md5(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("turn", "text")))), lambda x: x["text"]), "")
    )
    wanted = turns.agg(joined(F.lit(True)).alias("texts"), joined(F.col("role") == "assistant").alias("spoken")).first()
    assert (row.n, row.learned) == (100_000, 66_666)
    assert (row.texts, row.spoken) == (wanted.texts, wanted.spoken)
    assert took < 60
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("chars", [0, 1, 1023, 1024, 1025, 5000])
def test_masked_texts_at_the_edges_of_parts(spark, chars):
    rows = [(1, 0, "user", "é" * chars), (1, 1, "assistant", "𝒳" * chars), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "assistant", "<|" * chars)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_chats(chat.format_chats(turns)).first()
    assert list(back.learned) == ["𝒳" * chars, "", "<|" * chars]
    assert [(t.role, t.text) for t in back.turns] == [(r, t or "") for _, _, r, t in rows]
