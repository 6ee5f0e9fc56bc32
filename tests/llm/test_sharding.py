"""Shards along the Hilbert curve against ranks counted one by one."""

from __future__ import annotations

import collections
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from murmura.llm import oracles, registered, sharding, storage

FOLDER = "/root/testdata/sf0.001"
NAME = "op11_hilbert_sharding"


def place(point, bits):
    """The curve index of a grid point, by the tables, a bit at a time."""
    following, digits = sharding.curve(len(point))
    state = index = 0
    for bit in reversed(range(bits)):
        corner = sum((x >> bit & 1) << k for k, x in enumerate(point))
        at = (state << len(point)) + corner
        state, index = following[at], (index << len(point)) + digits[at]
    return index


@pytest.mark.parametrize("dimensions,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_point_and_moves_one_step_at_a_time(spark, dimensions, bits):
    points = list(itertools.product(range(1 << bits), repeat=dimensions))
    by_place = {place(p, bits): p for p in points}
    assert sorted(by_place) == list(range(len(points)))
    steps = (sum(abs(a - b) for a, b in zip(by_place[i], by_place[i + 1])) for i in range(len(points) - 1))
    assert set(steps) == {1}
    names = [f"x{k}" for k in range(dimensions)]
    rows = spark.createDataFrame(points, ", ".join(f"{c} int" for c in names))
    for row in rows.withColumn("at", sharding.curve_index(names, bits)).collect():
        assert by_place[row["at"]] == tuple(row[c] for c in names)


def test_sql(spark):
    found = registered.queries()[NAME](spark, FOLDER)
    assert difference(found, connect(FOLDER), oracles.statements()[NAME]) is None


def awkward(spark):
    rows = [(k % 50, f"t{k % 7}", "hot" if k % 3 else f"s{k % 11}", k % 5) for k in range(400)]
    rows += [(None, None, None, None)] * 9 + [(3, "", "", 0), (4, "x" * 300_000, "hot", 300_000)]
    schema = "doc_id bigint, text string, source string, slot int"
    return spark.createDataFrame(rows, schema).withColumns({"shard": F.lit("mine"), "row": F.lit(7), "_rank": F.lit(1)})


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_by_brute_force(spark, parts):
    docs = awkward(spark)
    dimensions, bits, shards = ("source", "slot"), 3, 5
    found = sharding.hilbert_shards(docs.repartition(parts), dimensions, shards, bits, ties=("doc_id", "text"))
    got = [(r["shard"], r["slot"], r["curve"], tuple(r["row"])) for r in found.collect()]
    rows = [tuple(r) for r in docs.collect()]
    key = lambda v: (v is not None, v)

    def cell(k, value):
        return sum(key(r[k]) < key(value) for r in rows) * (1 << bits) // len(rows)

    cells = {k: {v: cell(k, v) for v in {r[k] for r in rows}} for k in (2, 3)}
    ordered = sorted(rows, key=lambda r: (place((cells[2][r[2]], cells[3][r[3]]), bits), key(r[0]), key(r[1])))
    expected = []
    for rank, row in enumerate(ordered):
        shard = rank * shards // len(rows)
        first = -(-shard * len(rows) // shards)
        expected.append((shard, rank - first, place((cells[2][row[2]], cells[3][row[3]]), bits), row[:2]))
    # Rows equal in all ties change places freely.
    plain = lambda rows: sorted((s, p, c, key(r[0]), key(r[1])) for s, p, c, r in rows)
    assert plain(got) == plain(expected)
    assert collections.Counter(r for *_, r in got) == collections.Counter(rows)
    sizes = collections.Counter(s for s, *_ in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(p for s, p, *_ in got if s == shard) == list(range(n))


def test_empty_table_and_fewer_rows_than_shards(spark):
    docs = awkward(spark)
    assert sharding.hilbert_shards(docs.where("false"), ("source",)).collect() == []
    few = sharding.hilbert_shards(docs.limit(3), ("source",), 24).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3


def test_files_come_back_and_filters_pass_over_most_of_them(spark):
    rows = spark.range(6400).select(
        F.col("id").alias("doc_id"), (F.col("id") % 80).alias("a"), F.expr("id div 80").alias("b")
    )
    folder = storage.shared_folder(spark)
    sharding.write_shards(sharding.hilbert_shards(rows, ("a", "b"), 16, 5), folder)
    back = sharding.read_shards(spark, folder)
    assert sorted(r["row"]["doc_id"] for r in back.collect()) == list(range(6400))
    for column in ("a", "b"):
        ranges = back.groupBy("shard").agg(F.min(f"row.{column}").alias("low"), F.max(f"row.{column}").alias("high")).collect()
        met = [sum(r["low"] <= v <= r["high"] for r in ranges) for v in range(80)]
        # Of 16 shards that tile the square a line meets about four.
        assert sum(met) / len(met) <= 5
    plan = back.where("row.a = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(row.a,3)" in plan


def test_checksums_are_those_of_the_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for row in registered.queries()[NAME](spark, FOLDER).collect():
        data = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(data) + 8, zlib.crc32(data))
