"""Repaired conversations against all edits in a table, under several partitionings."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from compare import connect, difference
from murmura.llm import conversation_repair as repair
from murmura.llm import oracles, registered

FOLDER = "/root/testdata/sf0.001"
NAME = "op13_conversation_repair"
WHITE = " \t\n\x0b\x0c\r"


def fixed(rows):
    """``(blank, duplicate, truncated, illegal, cost, audit, repaired)`` of ordered ``(role, text)``."""
    seen, faults = set(), []
    for role, text in rows:
        inside = text.strip(WHITE)
        if not inside:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if inside[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # Cheapest edits from row i on, what was written last being in state; None: not reached.
    follow = lambda last, now: now == ("u" if last in ("", "s", "a") else "a") or (last, now) == ("", "s")
    best = {}
    for i in range(len(rows), -1, -1):
        plain = {}
        for last in ("", "s", "u", "a"):
            ways = []
            if i == len(rows):
                if last in ("", "a"):
                    ways.append((0, "", []))
            else:
                (role, text), fault = rows[i], faults[i]
                cost, audit, out = best[i + 1, last]
                ways.append((cost + 2, "D" + audit, out))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    if role[:1] in ("s", "u", "a") and follow(last, role[:1]):
                        cost, audit, out = best[i + 1, role[:1]]
                        ways.append((cost + more, "K" + audit, [f"{role}:{text}"] + out))
                    for name in ("user", "assistant"):
                        if follow(last, name[0]):
                            cost, audit, out = best[i + 1, name[0]]
                            ways.append((cost + more + 1, "R" + audit, [f"{name}:{text}"] + out))
            plain[last] = min(ways) if ways else (10**9, "", [])
        for _ in range(3):
            for last in plain:
                for name in ("user", "assistant"):
                    if follow(last, name[0]):
                        cost, audit, out = plain[name[0]]
                        plain[last] = min(plain[last], (cost + 5, "I" + audit, [f"{name}:"] + out))
        best |= {(i, last): way for last, way in plain.items()}
    cost, audit, out = best[0, ""]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (*counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def expected(turns):
    """By conversation, from its ``(turn, role, text)``."""
    found = {}
    for conv, rows in turns.items():
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = {t for t, *_ in rows if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        found[conv] = (gaps, *fixed([r[1:] for r in ordered]))
    return found


def report(found):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in found.collect()}


def damage(rows):
    """The contract's damage, row by row: by conversation, and all conversations."""
    turns = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        parts = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(parts).encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        elif fault == 4:
            role = "user"
        turns[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return turns


def run(spark, rows, parts=8):
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return report(repair.repair_report(given, repair.damaged(given)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sql(spark):
    found = registered.queries()[NAME](spark, FOLDER)
    assert difference(found, connect(FOLDER), oracles.statements()[NAME]) is None


def test_given_conversations_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == expected(damage(rows))


def awkward():
    draw = random.Random(13)
    roles = ["user", "assistant", "system", "User", "", None, "u", "tool"]
    texts = ["Yes.", "no", " ", "", None, "Why?\n", "a: b!", "x" * 50_000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(draw.randrange(12)):
            when = None if draw.random() < 0.1 else turn + draw.choice([0, 0, 0, 5])
            rows.append((conv, when, draw.choice(roles), draw.choice(texts)))
    rows += [(None, 0, "user", "Lost."), (None, 1, "assistant", "Found."), (999, None, None, None)]
    # One conversation with most rows, over all partitions; every second row of it is the same.
    rows += [(7, t, draw.choice(roles[:3]), "Same." if t % 2 else f"Text {t}{draw.choice('. ')}") for t in range(700)]
    return rows


@pytest.mark.parametrize("parts", [1, 8, 31])
def test_awkward_conversations_by_brute_force(spark, parts):
    rows = awkward()
    assert run(spark, rows, parts) == expected(damage(rows))


def test_empty_table(spark):
    given = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair_report(given, repair.damaged(given)).collect() == []


def test_clashing_columns_and_string_ids(spark):
    given = spark.createDataFrame(
        [("c", 0, "user", "Hi.", 1, "x", True), ("c", 1, "assistant", "Ho.", 2, "y", False)],
        "conv_id string, turn int, role string, text string, n int, _at string, blank boolean",
    )
    assert report(repair.repair_report(given, given)) == {
        "c": (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())
    }


def test_divide_and_conquer_over_runs_of_rows_is_that_over_rows():
    draw = random.Random(5)
    for _ in range(300):
        codes = bytes(draw.randrange(9) for _ in range(draw.randrange(1, 40)))
        states, letters, cost = repair.edits(codes + bytes([repair.END]))
        cuts = sorted({0, len(codes), *(draw.randrange(len(codes) + 1) for _ in range(3))})
        runs = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        chain = [*map(repair.matrix, runs), repair.STEPS[repair.END]]
        borders = bytes([0]) + bytes(repair.crossings(chain, 0, 0))
        audit, total = "", 0
        for k, run_ in enumerate(runs):
            end = bytes([repair.END]) if k == len(runs) - 1 else b""
            _, own, price = repair.edits(run_ + end, borders[k], 0 if end else borders[k + 1])
            audit, total = audit + "".join(own), total + price
        assert (audit, total) == ("".join(letters), cost)
