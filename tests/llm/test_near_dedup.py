"""Large groups of near copies: all their links, and what is copied for them."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import near_dedup, storage
from murmura.llm.components import components


def texts(count, seed, changes):
    """Copies of a text of 100 words, each with some words of its own."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    found = []
    for k in range(count):
        words = list(base)
        for at in draw.sample(range(100), draw.choice(changes)):
            words[at] = f"n{draw.randrange(40)}" if draw.random() < 0.5 else f"o{k}"
        found.append(" ".join(words))
    return found


def groups(rows):
    """The least reachable place of each text, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in rows)]
    seen = collections.Counter(s for x in sets for s in x)
    ids = {s: i for i, s in enumerate(s for s, n in seen.items() if n > 1)}
    there = np.zeros((len(sets), len(ids)), np.float32)
    for k, x in enumerate(sets):
        there[k, [ids[s] for s in x if s in ids]] = 1
    shared, n = there @ there.T, np.array([len(x) for x in sets])
    links = 100 * shared >= 75 * (n[:, None] + n[None] - shared)
    np.fill_diagonal(links, True)
    group = np.arange(len(sets))
    while True:
        least = np.where(links, group[None], len(sets)).min(1)
        if (least == group).all():
            return group.tolist()
        group = least


@pytest.mark.parametrize("changes", [(0, 1, 1, 2), (1, 2, 3, 4, 5)])
def test_groups_of_near_copies_by_all_pairs(spark, changes):
    rows = texts(700, 4, changes)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(8)
    found = [r.component_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert found == groups(rows)


def test_what_is_copied_grows_with_the_band(spark):
    rows = texts(4000, 9, (0, 1, 1, 1, 1, 1, 1, 3))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(8)
    signed = near_dedup.signatures(docs).withColumn("id", F.col("doc_id"))
    own = storage.written(signed.dropDuplicates(["h1", "h2"]))
    banded = near_dedup.bands(own)
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = storage.written(banded.join(sizes, "key"))
    sets = storage.written(near_dedup.full_sets(docs, members.select("id").distinct()))
    first = near_dedup.confirmed(near_dedup.likely(near_dedup.pivot_pairs(members), own), sets)
    joined = components(storage.written(first))
    outside = near_dedup.open_bands(members, joined).where("NOT settled").select("id").distinct().count()
    joined = near_dedup.pivot_rounds(members, joined, own, sets)
    opened = near_dedup.open_bands(members, joined)
    assert opened.where("NOT settled").select("id").distinct().count() <= outside
    by_band = {r.key: r.n for r in opened.groupBy("key").agg(F.count("*").alias("n")).collect()}
    tiles = {r.key: r.n for r in near_dedup.tiles(members, joined, sets).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert max(by_band.values()) > 1000
    assert all(n <= 4 * by_band[key] for key, n in tiles.items())


def test_members_that_are_settled_never_meet(spark):
    """Of a band of five, three connected: the other two meet each other and all of these."""
    members = spark.createDataFrame([(1, k, 5) for k in range(5)], "key bigint, id bigint, size bigint")
    joined = spark.createDataFrame([(k, 0) for k in range(3)], "id bigint, component bigint")
    sets = spark.createDataFrame([(k, bytearray(8 * 9)) for k in range(5)], "id bigint, set binary")
    rows = near_dedup.tiles(members, joined, sets).collect()
    assert {(r.id, r.settled) for r in rows} == {(0, True), (1, True), (2, True), (3, False), (4, False)}
    assert sum(r.tile.settled for r in rows) == 5 and len(rows) == 7
