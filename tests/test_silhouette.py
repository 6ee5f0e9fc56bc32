from __future__ import annotations

import numpy as np
import pytest

from murmura.functions import kernels as K
from murmura.operators import kmeans as KM
from murmura.operators import per_key
from murmura.operators import silhouette as S
from murmura.sources import tables

FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows, labels):
    return spark.createDataFrame(
        [(i, list(map(float, x)), int(c)) for i, (x, c) in enumerate(zip(rows, labels))],
        "id bigint, x array<double>, cluster int",
    )


def brute(rows, labels, sample_rows, sample_labels, t):
    """Scores by the definition: sums over all pairs, divided by min(t, cluster size)."""
    rows, sample_rows = np.asarray(rows, float), np.asarray(sample_rows, float)
    labels, sample_labels = np.asarray(labels), np.asarray(sample_labels)
    scores = []
    for x, own in zip(rows, labels):
        a, b = None, None
        for c in np.unique(sample_labels):
            total = ((sample_rows[sample_labels == c] - x) ** 2).sum()
            value = total / min(t, (labels == c).sum())
            if c == own:
                a = value
            else:
                b = value if b is None else min(b, value)
        if a is not None and b is not None and max(a, b) > 0:
            scores.append((b - a) / max(a, b))
    return np.mean(scores) if scores else None, len(scores)


@pytest.fixture(scope="module")
def labelled(spark):
    df = tables.labelled_points(spark, FOLDER)
    rows = df.collect()
    return df, [r.x for r in rows], [r.cluster for r in rows], [r.id for r in rows]


def test_exact_silhouette(labelled):
    df, x, labels, _ = labelled
    row = S.mean_silhouette(df).first()
    mean, count = brute(x, labels, x, labels, np.inf)
    assert row.silhouette == pytest.approx(mean, abs=1e-12) and row.points == count
    large = S.mean_silhouette(df, t=10_000).first()
    assert large.silhouette == pytest.approx(mean, abs=1e-12)


@pytest.mark.parametrize("t", [3, 7.5, 20])
def test_sampled_silhouette(labelled, t):
    df, x, labels, ids = labelled
    at = {i: n for n, i in enumerate(ids)}
    picked = [at[r.id] for r in S.cluster_sample(df, t).collect()]
    sx, sl = [x[i] for i in picked], [labels[i] for i in picked]
    mean, count = brute(x, labels, sx, sl, t)
    row = S.mean_silhouette(df, t).first()
    assert row.silhouette == pytest.approx(mean, abs=1e-12) and row.points == count
    mean, count = brute(sx, sl, sx, sl, np.inf)
    row = S.sample_silhouette(df, t).first()
    assert row.silhouette == pytest.approx(mean, abs=1e-12) and row.points == count


def test_far_from_the_origin_no_digits_are_lost(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1e-3, (40, 2)) for c in (1e6, 1e6 + 0.01)])
    labels = [0] * 40 + [1] * 40
    got = S.mean_silhouette(frame(spark, x, labels)).first().silhouette
    assert got == pytest.approx(brute(x, labels, x, labels, np.inf)[0], abs=1e-9)


def test_sample_does_not_depend_on_partitioning(labelled):
    df, *_ = labelled
    expected = {r.id for r in S.cluster_sample(df, 9).collect()}
    for count in (1, 3, 8):
        assert {r.id for r in S.cluster_sample(df.repartition(count), 9).collect()} == expected


def test_hot_and_rare_clusters_are_sampled_alike(labelled, monkeypatch):
    df, *_ = labelled
    expected = {(r.id, r.size) for r in S.cluster_sample(df, 9).collect()}
    for share in (1, 9, 10**6):
        monkeypatch.setattr(per_key, "HEAVY_SHARE", share)
        assert {(r.id, r.size) for r in S.cluster_sample(df, 9).collect()} == expected


def test_a_known_number_of_clusters_gives_the_same_sample(labelled):
    df, *_ = labelled
    expected = {(r.id, r.size) for r in S.cluster_sample(df, 9).collect()}
    got = S.cluster_sample(df, 9, clusters=10)
    assert got.columns == S.cluster_sample(df, 9).columns
    assert {(r.id, r.size) for r in got.collect()} == expected


def test_many_clusters_take_several_passes(labelled, monkeypatch):
    df, *_ = labelled
    moments = S.sample_moments(S.cluster_sample(df, 20), 20)
    expected = {r.id: (r.a, r.b, r.score) for r in S.point_scores(df, moments).collect()}
    monkeypatch.setattr(S, "BLOCK_DOUBLES", 200)
    assert len(list(S._blocks(moments))) > 2
    got = {r.id: (r.a, r.b, r.score) for r in S.point_scores(df, moments).collect()}
    assert got == expected


@pytest.mark.parametrize(
    "rows, labels", [([(1,), (2,)], [0, 0]), ([(3,), (3,), (3,)], [0, 1, 1]), ([], [])]
)
def test_no_score(spark, rows, labels):
    row = S.mean_silhouette(frame(spark, rows, labels)).first()
    assert (row.silhouette, row.points) == (None, 0)


def test_clusters_without_sample(spark):
    """A point whose own cluster was not drawn has no score; others skip that cluster."""
    points = frame(spark, [(0,), (1,), (10,), (11,)], [0, 0, 1, 1])
    sample = S.with_sizes(points).where("cluster = 0")
    scores = S.point_scores(points, S.sample_moments(sample, 5)).collect()
    assert all(r.score is None for r in scores)
    assert [r.b is not None for r in sorted(scores)] == [False, False, True, True]


def test_bad_sample_size(labelled):
    with pytest.raises(ValueError):
        S.cluster_sample(labelled[0], 0)


def test_score_of_a_model_equals_brute_force(labelled):
    df, *_ = labelled
    assigned = KM.kmeans_assign(df.drop("cluster"), KM.kmeans_fit(df, 3, 4))
    rows = assigned.collect()
    x, labels = [r.x for r in rows], [r.cluster for r in rows]
    mean, _ = brute(x, labels, x, labels, np.inf)
    assert S.mean_silhouette(assigned).first().silhouette == pytest.approx(mean, abs=1e-12)


def labelled_with_null(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(i % 3 * 4, 1, 2).tolist(), None if i % 3 == 2 else i % 3) for i in range(90)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, cluster int"), rows


def test_null_is_a_cluster_whether_or_not_the_number_is_known(spark):
    points, rows = labelled_with_null(spark)
    few = points.where("id < 3")
    for clusters in (None, 5, 60_000):
        sized = {(r.id, r.cluster, r.size) for r in S.with_sizes(points, clusters).collect()}
        assert sized == {(i, c, 30) for i, _, c in rows}
        assert S.with_sizes(few, clusters).count() == 3
        picked = {r.id for r in S.cluster_sample(points, 9, clusters=clusters).collect()}
        assert picked == {r.id for r in S.cluster_sample(points, 9).collect()}
        assert any(rows[i][2] is None for i in picked)
    plan = S.with_sizes(points, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("t", [9, S.EVERY_POINT])
def test_null_has_scores_like_any_cluster(spark, t):
    points, rows = labelled_with_null(spark)
    named = frame(spark, [x for _, x, _ in rows], [2 if c is None else c for _, _, c in rows])
    for clusters in (None, 5):
        got = S.mean_silhouette(points, t, clusters=clusters).first()
        assert tuple(got) == pytest.approx(tuple(S.mean_silhouette(named, t, clusters=clusters).first()))
        assert got.points == 90
    # Labels may be texts.
    text = points.withColumn("cluster", points.cluster.cast("string"))
    assert tuple(S.mean_silhouette(text, t).first()) == pytest.approx(tuple(S.mean_silhouette(points, t).first()))


def test_far_clusters_are_passed_over(monkeypatch):
    rng = np.random.default_rng(11)
    k, d, n = 5000, 8, 400
    means = rng.normal(0, 30, (k, d))
    own = rng.integers(-1, k, n)
    points = means[own] + rng.normal(0, 1, (n, d))
    spreads, ratios = rng.uniform(0, 5, k), rng.uniform(0.5, 1, k)
    met, plain = [], K.square_distance
    monkeypatch.setattr(K, "square_distance", lambda p, c: met.append(len(p)) or plain(p, c))
    a, b = K.silhouette_parts(points, own, means, spreads, ratios, K.balls(means, spreads, ratios))
    assert 2 * sum(met) < n * k
    for i in range(n):
        values = ratios * (plain(means, points[i]) + spreads)
        if own[i] >= 0:
            assert a[i] == pytest.approx(values[own[i]], rel=1e-12)
            values[own[i]] = np.inf
        else:
            assert np.isnan(a[i])
        assert b[i] == pytest.approx(values.min(), rel=1e-12)


@pytest.mark.parametrize("k", [1, 2, 3, 30])
def test_equal_means_and_few_clusters(k):
    rng = np.random.default_rng(2)
    means = np.repeat(rng.normal(0, 1, (max(1, k // 2), 3)), 2, axis=0)[:k]
    spreads, ratios = np.zeros(len(means)), np.ones(len(means))
    points, own = rng.normal(0, 1, (50, 3)), rng.integers(0, len(means), 50)
    a, b = K.silhouette_parts(points, own, means, spreads, ratios, K.balls(means, spreads, ratios))
    for i in range(50):
        values = K.square_distance(means, points[i])
        others = np.delete(values, own[i])
        assert a[i] == pytest.approx(values[own[i]])
        assert (np.isnan(b[i]) and not len(others)) or b[i] == pytest.approx(others.min())
