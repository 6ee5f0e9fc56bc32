"""Passages at the threshold, by size, and a benchmark of several passes."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from murmura.llm import decontamination


def passage(draw, size, kind):
    """An item, and a text with a passage that is just similar enough."""
    item = [f"w{draw.randrange(10**9)}" for _ in range(size)]
    shingles = size - 4
    if kind == "short":
        # A text that ends within the item.
        return item, item[: -(-3 * shingles // 4) + 4]
    changed = int(shingles / 7 - 4)
    at = draw.randrange(4, size - changed - 3)
    around = [f"a{draw.randrange(10**9)}" for _ in range(40)]
    other = [f"n{draw.randrange(10**9)}" for _ in range(changed)]
    return item, around[:20] + item[:at] + other + item[at + changed :] + around[20:]


@pytest.mark.parametrize("kind", ["changed", "short"])
@pytest.mark.parametrize("size", [60, 200, 400, 800])
def test_passages_at_the_threshold_are_found(size, kind):
    draw = random.Random(size)
    missed = 0
    for _ in range(150):
        item, text = passage(draw, size, kind)
        index = decontamination.Index([1], [" ".join(item)])
        found = next(index.of_column(pa.array([" ".join(text)])))
        missed += not found
        assert all(0.75 <= alike <= 0.8 for alike, _, _ in found.values())
    assert missed == 0


def test_the_radius_grows_with_what_may_differ():
    assert decontamination.radius(3, 3) == decontamination.LEAST_RADIUS
    sizes = [decontamination.radius(n, n) for n in (20, 60, 200, 800)]
    assert sizes == sorted(sizes) and sizes[-1] > decontamination.LEAST_RADIUS
    assert decontamination.radius(200, 200, 90) < decontamination.radius(200, 200, 75)


def test_fingerprints_within_the_radius_are_all_found(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(6)
    prints = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = prints[:50] ^ (np.uint64(1) << draw.integers(0, 64, 50, dtype=np.uint64))
    for pairs in (1 << 20, 100):
        monkeypatch.setattr(decontamination, "PAIRS", pairs)
        blocks = decontamination.Blocks(prints, np.arange(300), 22)
        wanted = {(i, j) for i in range(50) for j in range(300) if bin(int(asked[i] ^ prints[j])).count("1") <= 22}
        assert set(blocks.near(asked)) == wanted and len(wanted) >= 50


def test_a_benchmark_of_several_passes(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"a b {text} c") for k, text in items[::3]] + [(99, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "PASS_CHARS", 500)
    held = []
    make = decontamination.Index
    monkeypatch.setattr(decontamination, "Index", lambda *a: held.append(a) or make(*a))
    found = decontamination.contaminated(docs, bench)
    assert len(held) > 3
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(0, 30, 3)}
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [99]
