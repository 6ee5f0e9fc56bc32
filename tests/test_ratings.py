from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from murmura.operators import per_key
from murmura.operators import ratings as R


def frame(spark, rows):
    return spark.createDataFrame(rows, "product string, user string, rating double")


def test_small_example(spark):
    reviews = frame(
        spark,
        [("P1", "U1", 5.0), ("P2", "U1", 1.0), ("P1", "U2", 4.0), ("P3", "U2", 2.0)],
    )
    assert [tuple(r) for r in R.top_normalized(reviews, 3).collect()] == [
        ("P1", 2.0), ("P3", -1.0), ("P2", -2.0)
    ]
    assert [r.product for r in R.top_normalized(reviews, 1).collect()] == ["P1"]


def test_one_review(spark):
    assert R.max_normalized(frame(spark, [("P", "U", 3.0)])).first().max_norm == 0.0


def test_equal_products_come_in_order(spark):
    reviews = frame(spark, [(p, "U", 2.0) for p in "cab"])
    assert [r.product for r in R.top_normalized(reviews, 2).collect()] == ["a", "b"]


def test_empty(spark):
    assert R.top_normalized(frame(spark, []), 5).collect() == []


@pytest.mark.parametrize("share", [1, 3, 1000])
@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_hot_and_rare_users_get_the_same_treatment(spark, monkeypatch, share, partitions):
    """At share 3 only the hot user is broadcast; at 1 no user; at 1000 most are."""
    monkeypatch.setattr(per_key, "HEAVY_SHARE", share)
    rows = [(f"p{i % 7}", "hot" if i % 2 else f"u{i % 50}", float(i * i % 11)) for i in range(2000)]
    by_user = defaultdict(list)
    for _, user, rating in rows:
        by_user[user].append(rating)
    expected = sorted(
        (p, u, r, round(r - sum(by_user[u]) / len(by_user[u]), 9)) for p, u, r in rows
    )
    got = R.normalized_ratings(frame(spark, rows).repartition(partitions)).collect()
    assert sorted((r.product, r.user, r.rating, round(r.norm, 9)) for r in got) == expected


def test_rare_users_join_by_shuffle_when_their_table_is_large(spark, monkeypatch):
    """Without broadcasts by size the light branch is a shuffle join, and results stay."""
    monkeypatch.setattr(per_key, "HEAVY_SHARE", 3)
    rows = [(f"p{i % 7}", "hot" if i % 2 else f"u{i % 50}", float(i % 11)) for i in range(1000)]
    expected = sorted(map(tuple, R.max_normalized(frame(spark, rows)).collect()))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        result = R.max_normalized(frame(spark, rows))
        assert sorted(map(tuple, result.collect())) == expected
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_rows_of_a_null_user_stay(spark):
    from murmura.operators import ratings

    rows = [("p", None, 4.0), ("q", None, 2.0), ("p", "u", 5.0), ("q", "u", 1.0)]
    reviews = spark.createDataFrame(rows, "product string, user string, rating double")
    for share in (1000, 1):
        import murmura.operators.per_key as per_key

        before, per_key.HEAVY_SHARE = per_key.HEAVY_SHARE, share
        try:
            got = ratings.normalized_ratings(reviews).collect()
        finally:
            per_key.HEAVY_SHARE = before
        assert sorted(r["norm"] for r in got) == [-2.0, -1.0, 1.0, 2.0]
