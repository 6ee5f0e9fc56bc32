"""Refining centers: assign points to the nearest, move to the weighted mean."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import kernels as K
from murmura.operators.centers import as_matrix, distance_to_given, fit_a_pass, nearest_center
from murmura.operators.seeding import weighted


def _pass(
    points: DataFrame,
    previous: list[np.ndarray | None],
    current: list[np.ndarray],
    numbers: list[int],
) -> DataFrame:
    """``(run, cid, w, x, cost)`` over all points; see ``kernels.refine``.

    A partition's result is itself a set of weighted points, one per run and
    center, so only those are shuffled.  More centers than a task may hold are
    met in blocks, run by run.
    """
    if not fit_a_pass([*current, *(p for p in previous if p is not None)]):
        each = [
            _pass_in_blocks(points, before, now, number).withColumn("run", F.lit(run))
            for run, (before, now, number) in enumerate(zip(previous, current, numbers))
        ]
        return reduce(DataFrame.unionByName, each)
    partial = points.drop("id").mapInArrow(
        K.refine(previous, current, numbers), "run int, cid int, w double, x array<double>, cost double"
    )
    mean = Summarizer.mean(array_to_vector("x"), F.col("w"))
    return partial.groupBy("run", "cid").agg(
        F.sum("w").alias("w"), vector_to_array(mean).alias("x"), F.sum("cost").alias("cost")
    )


def _pass_in_blocks(
    points: DataFrame, previous: np.ndarray | None, current: np.ndarray, number: int
) -> DataFrame:
    """``(cid, w, x, cost)`` of one run, in two stages: each point's nearest center, then means by center."""
    own = points.where(F.col("_run") == number) if "_run" in points.columns else points
    rows, gap = own.select("x", "w"), F.lit(0.0)
    if previous is not None:
        before = nearest_center(rows, previous).select("x", "w", F.col("cid").alias("_before"))
        rows, gap = distance_to_given(before, current, "_before").select("x", "w", "gap"), F.col("gap")
    mean = Summarizer.mean(array_to_vector("x"), F.col("w"))
    return nearest_center(rows, current).groupBy("cid").agg(
        F.sum("w").alias("w"), vector_to_array(mean).alias("x"), F.sum(F.col("w") * gap).alias("cost")
    )


def _move(
    result: DataFrame, before: list[np.ndarray]
) -> tuple[list[np.ndarray], list[float]]:
    """Each run's new centers, those without points staying, and its cost."""
    after, cost = [centers.copy() for centers in before], [0.0 for _ in before]
    for row in result.collect():
        cost[row.run] += row.cost
        after[row.run][row.cid] = row.x
    return after, cost


def lloyd_step(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(cid, x)``: the centers after one move; one without points stays."""
    centers = as_matrix(centers)
    means = _pass(weighted(points), [None], [centers], [0])
    spark = points.sparkSession
    old = spark.createDataFrame(
        [(cid, x) for cid, x in enumerate(centers.tolist())], "cid int, old array<double>"
    )
    return old.join(means, "cid", "left").select(
        "cid", F.when(F.col("w") > 0, F.col("x")).otherwise(F.col("old")).alias("x")
    )


def lloyd_runs(
    points: DataFrame, starts: list[np.ndarray], rounds: list[int]
) -> list[np.ndarray]:
    """Refines each start by at most its number of rounds; runs share every pass.

    A round is kept only if it lowers the sum of weighted distances from the
    points, as assigned before the move, to the moved centers; otherwise the
    run stops with the centers it had.  The pass that measures a move also
    prepares the next one.
    """
    points = weighted(points)
    current = [as_matrix(start) for start in starts]
    best = [np.inf for _ in starts]
    running = [run for run, count in enumerate(rounds) if count > 0]
    if not running:
        return current

    first = [current[run] for run in running]
    moved, _ = _move(_pass(points, [None for _ in running], first, running), first)
    proposal = dict(zip(running, moved))
    turn = 0
    while running:
        turn += 1
        places = [proposal[run] for run in running]
        measured = _pass(points, [current[run] for run in running], places, running)
        going = []
        for run, following, cost in zip(running, *_move(measured, places)):
            if cost < best[run]:
                best[run], current[run], proposal[run] = cost, proposal[run], following
                if turn < rounds[run]:
                    going.append(run)
        running = going
    return current


def run_weights(points: DataFrame, centers: list[np.ndarray]) -> list[np.ndarray]:
    """Per run the weights of the points nearest to each center."""
    runs = list(range(len(centers)))
    weights = [np.zeros(len(c)) for c in centers]
    for row in _pass(weighted(points), [None for _ in runs], centers, runs).collect():
        weights[row.run][row.cid] = row.w
    return weights


def lloyd(points: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    return lloyd_runs(points, [start], [rounds])[0]


def moved_runs(points: DataFrame, starts: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Each start after ``rounds`` moves to the weighted means, whatever the cost; as k-means has it."""
    points = weighted(points)
    current = [as_matrix(start) for start in starts]
    running = list(range(len(current)))
    for _ in range(rounds):
        if not running:
            break
        before = [current[run] for run in running]
        after, _ = _move(_pass(points, [None for _ in running], before, running), before)
        current = [dict(zip(running, after)).get(run, c) for run, c in enumerate(current)]
        # What stays now stays for ever.
        running = [run for run, old in zip(running, before) if not np.array_equal(current[run], old)]
    return current
