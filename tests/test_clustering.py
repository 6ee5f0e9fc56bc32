from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.functions import kernels as K
from murmura.operators import centers as C
from murmura.operators import coreset as M
from murmura.operators import kmeans as KM
from murmura.operators import lloyd as L
from murmura.operators import seeding as S
from murmura.sources import tables

FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows, weights=None):
    if weights is None:
        return spark.createDataFrame(
            [(i, list(map(float, x))) for i, x in enumerate(rows)], "id bigint, x array<double>"
        )
    return spark.createDataFrame(
        [(i, list(map(float, x)), float(w)) for i, (x, w) in enumerate(zip(rows, weights))],
        "id bigint, x array<double>, w double",
    )


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 10, 20)])
    return frame(spark, rows), rows


def brute(rows, centers):
    distance = np.sqrt(((rows[:, None, :] - centers[None]) ** 2).sum(-1))
    return distance.argmin(1), distance.min(1)


@pytest.mark.parametrize("unrolled", [0, 100])
def test_nearest_center(cloud, monkeypatch, unrolled):
    monkeypatch.setattr(C, "UNROLLED_DOUBLES", unrolled)
    df, rows = cloud
    centers = rows[[5, 70, 130, 3]]
    which, distance = brute(rows, centers)
    got = {r.id: (r.cid, r.d) for r in C.nearest_center(df, centers).collect()}
    assert [got[i][0] for i in range(len(rows))] == which.tolist()
    assert [got[i][1] for i in range(len(rows))] == pytest.approx(distance.tolist())
    assert C.objective(df, centers).first()[0] == pytest.approx(distance.mean())
    runs = C.mean_distance_runs(df.repartition(5), [centers, centers[:1]])
    merged = {r.run: r.objective for r in runs.collect()}
    assert merged[0] == pytest.approx(distance.mean())
    assert merged[1] == pytest.approx(brute(rows, centers[:1])[1].mean())


@pytest.mark.parametrize("unrolled", [0, 100])
def test_many_centers_take_several_passes(cloud, monkeypatch, unrolled):
    monkeypatch.setattr(C, "UNROLLED_DOUBLES", unrolled)
    df, rows = cloud
    centers = rows[::9]

    def found():
        return sorted(
            map(tuple, C.nearest_center(df, centers).select("id", "cid", "d").collect())
        )

    expected = found()
    monkeypatch.setattr(C, "BLOCK_DOUBLES", 21)
    assert len(C.blocks(centers)) == 3
    assert found() == expected


@pytest.mark.parametrize("unrolled", [0, 100])
def test_equal_distance_goes_to_the_smaller_id(spark, monkeypatch, unrolled):
    monkeypatch.setattr(C, "UNROLLED_DOUBLES", unrolled)
    row = C.nearest_center(frame(spark, [(1, 0)]), [[0, 0], [2, 0], [0, 0]]).first()
    assert (row.cid, row.d) == (0, 1.0)


BAD_ROWS = [
    [(1.0, 2.0, 3.0), (1.0, 2.0, 3.0, 4.0)],
    [(1.0, 2.0, 3.0), (1.0, 2.0)],
    [(1.0, 2.0, 3.0), None],
    [(1.0, 2.0, 3.0), (1.0, None, 3.0)],
    [(1.0,), (2.0,)],
    [(1.0, 2.0, 3.0, 4.0)] * 2,
]


@pytest.mark.parametrize("unrolled", [0, 100])
@pytest.mark.parametrize("rows", BAD_ROWS)
def test_vectors_of_another_length_fail(spark, monkeypatch, rows, unrolled):
    monkeypatch.setattr(C, "UNROLLED_DOUBLES", unrolled)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id bigint, x array<double>")
    df, center = df.coalesce(1), np.zeros((1, 3))
    for result in (
        lambda: C.nearest_center(df, center).collect(),
        lambda: C.objective(df, center).collect(),
        lambda: C.center_weights(df, center).collect(),
        lambda: C.mean_distance_runs(df, [center]).collect(),
        lambda: L.lloyd(df, center, 1),
    ):
        with pytest.raises(Exception, match="missing|of another length"):
            result()


@pytest.mark.parametrize("rows", BAD_ROWS[:4])
def test_vectors_of_several_lengths_fail_without_centers(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id bigint, x array<double>")
    for result in (lambda: S.seed_centers(df.coalesce(1), 2), lambda: M.coreset(df, 2, 1, 1).collect()):
        with pytest.raises(Exception, match="missing|of another length"):
            result()


def test_center_weights_keep_zeros(spark):
    df = frame(spark, [(0,), (1,), (9,)])
    got = {r.cid: r.weight for r in C.center_weights(df, [[0.0], [100.0], [10.0]]).collect()}
    assert got == {0: 2, 1: 0, 2: 1}


def test_lloyd_step(spark):
    df = frame(spark, [(0,), (1,), (10,)], [1, 3, 1])
    got = {r.cid: list(r.x) for r in L.lloyd_step(df, [[0.0], [10.0], [500.0]]).collect()}
    assert got == {0: [0.75], 1: [10.0], 2: [500.0]}


def lloyd_brute(rows, weights, centers, rounds):
    best = np.inf
    for _ in range(rounds):
        which, _ = brute(rows, centers)
        after = centers.copy()
        for c in range(len(centers)):
            if weights[which == c].sum() > 0:
                after[c] = np.average(rows[which == c], axis=0, weights=weights[which == c])
        cost = (weights * np.sqrt(((rows - after[which]) ** 2).sum(1))).sum()
        if not cost < best:
            break
        best, centers = cost, after
    return centers


@pytest.mark.parametrize("rounds", [0, 1, 2, 30])
def test_lloyd_runs_to_its_end(spark, cloud, rounds):
    _, rows = cloud
    weights = np.arange(len(rows)) % 4 + 1.0
    df = frame(spark, rows, weights).repartition(4)
    starts = [rows[[0, 1, 2]], rows[[0, 70, 150, 2]]]
    got = L.lloyd_runs(df, starts, [rounds, 2])
    assert got[0] == pytest.approx(lloyd_brute(rows, weights, starts[0], rounds))
    assert got[1] == pytest.approx(lloyd_brute(rows, weights, starts[1], 2))


def test_lloyd_keeps_previous_centers_when_nothing_improves(spark):
    """Means minimize squares, so a move may raise the sum of distances."""
    df = frame(spark, [(0,), (0,), (0,), (10,)])
    assert L.lloyd(df, np.array([[0.0]]), 1).tolist() == [[2.5]]
    assert L.lloyd(df, np.array([[0.0]]), 5).tolist() == [[2.5]]


def test_seeding_is_the_same_for_any_partitioning(spark, cloud):
    df, _ = cloud
    expected = S.seed_centers(df, 5, seed=7)
    assert len({i for i, _ in expected}) == 5
    for count in (1, 3, 8):
        assert S.seed_centers(df.repartition(count), 5, seed=7) == expected
    shared = S.seed_runs(df, [5, 2, 5], [7, 7, 8])
    assert shared[0] == expected and shared[1] == expected[:2] and shared[2] != expected


def test_seeding_with_few_distinct_points(spark):
    picks = S.seed_centers(frame(spark, [(1,), (1,), (2,), (2,)]), 4)
    assert len(picks) == 2 and {x[0] for _, x in picks} == {1.0, 2.0}
    assert S.seed_centers(frame(spark, []), 3) == []


def test_seeding_follows_the_weights(spark):
    """Two candidates at equal distance, one nine times as heavy."""
    df = frame(spark, [(0,), (1,), (-1,)], [0, 9, 1])
    picks = S.seed_runs(df, [2] * 300, list(range(300)))
    second = [p[1][0] for p in picks if p[0][0] == 0]
    assert len(second) > 60
    assert 0.78 < second.count(1) / len(second) < 1.0


def test_seeding_takes_text_ids(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [5.0])], "id string, x array<double>")
    assert {i for i, _ in S.seed_centers(df, 2)} == {"a", "b"}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_coreset_weighs_every_point_once(spark, cloud, parts):
    df, rows = cloud
    core = M.coreset(df, 3, parts, 2).collect()
    assert sum(r.w for r in core) == len(rows)
    assert len({r.id for r in core}) == len(core) <= 3 * parts
    again = M.coreset(df.repartition(5), 3, parts, 2).collect()
    assert {r.id: r.w for r in again} == {r.id: r.w for r in core}


def test_more_parts_than_points(spark):
    core = M.coreset(frame(spark, [(0,), (9,)]), 2, 500, 1).collect()
    assert sum(r.w for r in core) == 2


@pytest.mark.parametrize("partitions, copied", [(1, True), (5, True), (5, False)])
def test_large_parts_give_what_small_ones_give(spark, monkeypatch, partitions, copied):
    rows = spark.range(0, 600, 1, partitions).select(
        F.when((F.col("id") % 3 == 0) & copied, 0).otherwise(F.col("id")).alias("id"),
        F.array((F.col("id") % 7).cast("double"), F.sqrt("id")).alias("x"),
    )

    def found():
        return {r.id: (pytest.approx(list(r.x)), r.w) for r in M.coreset(rows, 3, 2, 2).collect()}

    expected = found()
    assert len(expected) == 6 and sum(w for _, w in expected.values()) == 600
    monkeypatch.setattr(M, "PART_DOUBLES", 450 if copied else 20)
    got = {r.id: (list(r.x), r.w) for r in M.coreset(rows.repartition(partitions), 3, 2, 2).collect()}
    assert got == expected


def test_passes_over_large_parts_read_their_own_folder(spark, monkeypatch):
    rows = spark.range(600).select("id", F.array(F.sqrt("id"), F.col("id") % 5.0).alias("x"))
    placed = rows.withColumn("part", (F.col("id") % 6).cast("int"))
    stored = M.stored_by_batch(placed, [0, 2, 4, 5], 3)
    one = stored.where("_batch = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_batch" in plan and "(_batch" in plan.split("PartitionFilters")[1]
    # Three parts share the first folder, the last part is alone in the second.
    assert {(r._batch, r._run, r.id % 6) for r in stored.collect()} == {(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 5)}
    assert sorted(r.id for r in one.collect()) == list(range(5, 600, 6))
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files and all("_batch=1/" in f for f in files)


def test_batches_of_large_parts_give_what_one_batch_gives(spark, monkeypatch):
    rows = spark.range(900).select("id", F.array(F.sqrt("id"), F.col("id") % 7.0).alias("x"))

    def found():
        return {r.id: (pytest.approx(list(r.x)), r.w) for r in M.coreset(rows, 3, 5, 2).collect()}

    expected = found()
    monkeypatch.setattr(M, "PART_DOUBLES", 20)
    monkeypatch.setattr(M, "RUN_DOUBLES", 2 * S.vectors_held(3) * 2)
    batches = []
    stored = M.stored_by_batch
    monkeypatch.setattr(M, "stored_by_batch", lambda *a: batches.append(stored(*a)) or batches[-1])
    got = {r.id: (list(r.x), r.w) for r in M.coreset(rows, 3, 5, 2).collect()}
    assert got == expected
    assert {r._batch for r in batches[0].select("_batch").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("power", [1, 2])
@pytest.mark.parametrize("parted", [False, True])
def test_centers_in_blocks_are_picked_alike(spark, cloud, monkeypatch, power, parted):
    df, rows = cloud
    if parted:
        df = df.withColumn("_run", (F.col("id") % 2).cast("int"))
    expected = S.seed_runs(df.repartition(3), [20, 9], [1, 2], power)
    monkeypatch.setattr(C, "BLOCK_DOUBLES", 12)
    seen, upto = [], S._Distances.upto
    monkeypatch.setattr(S._Distances, "upto", lambda self, chosen: seen.append(len(chosen)) or upto(self, chosen))
    assert S.seed_runs(df.repartition(2), [20, 9], [1, 2], power) == expected
    assert seen and max(seen) * rows.shape[1] > 12


@pytest.mark.parametrize("rounds", [1, 4])
def test_centers_in_blocks_move_alike(spark, cloud, monkeypatch, rounds):
    df, rows = cloud
    weighed = df.withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    starts = [rows[::9], rows[4:6]]
    expected = L.lloyd_runs(weighed, starts, [rounds, rounds])
    moved = L.moved_runs(weighed, starts, rounds)
    weights = L.run_weights(weighed, expected)
    means = {r.run: r.objective for r in C.mean_distance_runs(df, expected).collect()}
    step = {r.cid: list(r.x) for r in L.lloyd_step(weighed, starts[0]).collect()}
    monkeypatch.setattr(C, "BLOCK_DOUBLES", 12)
    monkeypatch.setattr(K, "refine", None)
    monkeypatch.setattr(K, "mean_distances", None)
    assert not C.fit_a_pass(starts)
    for mine, theirs in zip(L.lloyd_runs(weighed, starts, [rounds, rounds]), expected):
        assert mine == pytest.approx(theirs)
    for mine, theirs in zip(L.moved_runs(weighed, starts, rounds), moved):
        assert mine == pytest.approx(theirs)
    for mine, theirs in zip(L.run_weights(weighed, expected), weights):
        assert mine == pytest.approx(theirs)
    found = {r.run: r.objective for r in C.mean_distance_runs(df, expected).collect()}
    assert found == {run: pytest.approx(v) for run, v in means.items()}
    assert {r.cid: pytest.approx(list(r.x)) for r in L.lloyd_step(weighed, starts[0]).collect()} == step


def test_runs_of_their_own_points_move_alike_in_blocks(spark, cloud, monkeypatch):
    df, rows = cloud
    parted = df.withColumn("_run", (F.col("id") % 2).cast("int"))
    starts = [rows[0:12:2], rows[1:13:2]]
    expected = L.lloyd_runs(parted, starts, [3, 3])
    monkeypatch.setattr(C, "BLOCK_DOUBLES", 9)
    for mine, theirs in zip(L.lloyd_runs(parted, starts, [3, 3]), expected):
        assert mine == pytest.approx(theirs)


def test_three_rounds_find_the_groups(cloud):
    df, rows = cloud
    row = M.kmedian_coreset(df, 3, 4, 3).first()
    assert row.centers == 3 and row.coreset_points == 12
    assert row.objective < 2.5


def test_many_parts_get_tasks_of_their_own(cloud, monkeypatch):
    df, _ = cloud
    expected = {r.id: r.w for r in M.coreset(df, 2, 20, 1).collect()}
    monkeypatch.setattr(M, "PARTS_PER_TASK", 1)
    core = M.coreset(df, 2, 20, 1)
    assert "REPARTITION_BY_NUM" in core._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.w for r in core.collect()} == expected


def test_no_points(spark):
    none = frame(spark, [])
    assert M.coreset(none, 2, 3, 1).collect() == []
    assert tuple(M.kmedian_coreset(none, 2, 3, 1).first()) == (0, 0, None)
    assert M.kmedian_trials(none, [2], [1], 2).collect() == []
    assert C.objective(none, [[0.0]]).first().objective is None


def test_bad_parameters(cloud):
    df, _ = cloud
    for k, parts, rounds in ((0, 1, 1), (1, 0, 1), (1, 1, -1)):
        with pytest.raises(ValueError):
            M.coreset(df, k, parts, rounds)
    with pytest.raises(ValueError):
        M.kmedian_trials(df, [0], [1], 1)


def test_trials_improve_with_more_centers_and_rounds(spark, monkeypatch):
    points = tables.points(spark, FOLDER)
    together = {
        (r.k, r.rounds): r for r in M.kmedian_trials(points, [2, 6], [0, 3], 4).collect()
    }
    assert together[2, 0].average > together[2, 3].average > together[6, 3].average
    assert together[2, 0].average > together[6, 0].average
    monkeypatch.setattr(M, "RUN_DOUBLES", 1000)
    apart = {(r.k, r.rounds): r for r in M.kmedian_trials(points, [2, 6], [0, 3], 4).collect()}
    for key, row in together.items():
        assert apart[key].lowest == pytest.approx(row.lowest)
        assert apart[key].average == pytest.approx(row.average)


def test_kmeans(cloud):
    df, rows = cloud
    model = KM.kmeans_fit(df, 3, 20)
    centers = np.array(model.clusterCenters())
    assert len(centers) <= 3
    got = {r.id: r.cluster for r in KM.kmeans_assign(df, model).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, centers)[0].tolist()


def test_kmeans_on_fewer_points_than_clusters(spark):
    df = frame(spark, [(0,), (0,), (5,)])
    assert len(KM.kmeans_fit(df, 5, 3).clusterCenters()) <= 5


def test_kmeans_by_races_does_not_depend_on_partitioning(spark):
    points = tables.points(spark, FOLDER)
    found = [KM.kmeans_centers(points.repartition(n), 5, 4, 7) for n in (1, 3, 8)]
    assert len(found[0]) == 5
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-9)
    sweeps = [
        [tuple(r) for r in KM.kmeans_sweep(points.repartition(n), 2, 2, 3, 100).collect()] for n in (1, 8)
    ]
    assert sweeps[0] == [pytest.approx(row) for row in sweeps[1]]


def test_kmeans_by_races_moves_to_means(cloud):
    df, rows = cloud
    centers = rows[[0, 1, 150]]
    for _ in range(3):
        which = brute(rows, centers)[0]
        centers = np.array([rows[which == i].mean(0) for i in range(3)])
    start = rows[[0, 1, 150]]
    got = L.moved_runs(df, [start, start[:1]], 3)
    assert got[0] == pytest.approx(centers)
    assert got[1] == pytest.approx(rows.mean(0)[None])
    assert L.moved_runs(df, [start], 0)[0] == pytest.approx(start)
    got = {r.id: r.cluster for r in KM.kmeans_assign(df, centers).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, centers)[0].tolist()


def test_kmeans_by_races_on_few_points(spark):
    assert len(KM.kmeans_centers(frame(spark, [(0,), (0,), (5,)]), 5, 3)) == 2
    none = frame(spark, [(1, 2)]).limit(0)
    assert KM.kmeans_centers(none, 2, 3) is None
    assert [tuple(r) for r in KM.kmeans_sweep(none, 2, 1, 3, 10).collect()] == [(2, 0, None)]


@pytest.mark.parametrize("start", KM.STARTS)
def test_sweep(cloud, start):
    df, _ = cloud
    rows = {r.k: r for r in KM.kmeans_sweep(df, 1, 4, 10, 10_000, start=start).collect()}
    assert rows[1].silhouette is None and rows[1].centers == 1
    assert max((2, 3, 4), key=lambda k: rows[k].silhouette) == 3
    assert rows[3].silhouette > 0.9
    for wrong in ({"k_start": 0}, {"start": "other"}):
        with pytest.raises(ValueError):
            KM.kmeans_sweep(df, **{"k_start": 1, "h": 1, "rounds": 1, "sample": 1, **wrong})


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e12])
@pytest.mark.parametrize("k, d", [(1, 3), (2, 3), (9, 1), (40, 5), (7, 64)])
def test_matrix_product_picks_the_same_centers_as_plain_comparison(offset, k, d):
    rng = np.random.default_rng(k * d)
    rows = np.round(rng.normal(0, 2, (9000, d)), 1) + offset
    centers = np.concatenate([rows[: k - k // 3], rows[: k // 3]])
    which, distance = K.nearest(rows, centers)
    assert (which == K._nearest_one_by_one(rows, centers)).all()
    expected = np.sqrt(((rows - centers[which]) ** 2).sum(1))
    assert distance == pytest.approx(expected, rel=1e-13)


@pytest.mark.parametrize("ahead, kept, sent", [(1, 8, 32), (8, 1, 1), (8, 2, 3), (4, 8, 32)])
def test_picks_do_not_depend_on_how_many_turns_a_pass_prepares(
    cloud, monkeypatch, ahead, kept, sent
):
    df, rows = cloud
    for name, value in (("AHEAD", ahead), ("KEPT", kept), ("SENT", sent)):
        monkeypatch.setattr(S, name, value)
    got = S.seed_runs(df.repartition(5), [12, 7], [3, 4])
    assert got == [picks_by_definition(rows, 12, 3), picks_by_definition(rows, 7, 4)]


def test_passes_look_further_ahead_the_more_centers_there_are(spark, monkeypatch):
    rows = np.random.default_rng(5).normal(0, 1, (3000, 4))
    df = frame(spark, rows).repartition(8, "id").cache()
    passes, least = [], S._least
    monkeypatch.setattr(S, "_least", lambda found: passes.append(1) or least(found))
    got = S.seed_centers(df, 200, 3)
    many = len(passes)
    monkeypatch.setattr(S, "MOST_AHEAD", 0)
    assert S.seed_centers(df, 200, 3) == got == picks_by_definition(rows, 200, 3)
    assert 2 * many <= len(passes) - many
    df.unpersist()


def picks_by_definition(rows, k, seed):
    """One race over all rows per turn."""
    ids = [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(len(rows))]
    draw_of = K.draws(np.array(ids, dtype=np.uint64), seed)
    chosen = []
    for turn in range(k):
        times = -np.log(draw_of(turn))
        if chosen:
            with np.errstate(divide="ignore"):
                times = times / brute(rows, rows[chosen])[1]
        chosen.append(int(times.argmin()))
    return [(i, rows[i].tolist()) for i in chosen]


def test_draws_are_uniform_and_unrelated():
    states = np.arange(200_000, dtype=np.uint64)
    one, next_turn, other = (K.draws(states, s)(t) for s, t in ((1, 0), (1, 1), (2, 0)))
    assert one.min() > 0 and one.max() <= 1
    assert one.mean() == pytest.approx(0.5, abs=0.005)
    for pair in ((one, next_turn), (one, other)):
        assert abs(np.corrcoef(*pair)[0, 1]) < 0.01
