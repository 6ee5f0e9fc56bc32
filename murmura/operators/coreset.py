"""k-median in three rounds through a coreset, and repeated k-median trials."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import kernels as K
from murmura.functions.uniform import row_state, salt, uniform
from murmura.operators import centers as C
from murmura.operators.lloyd import lloyd, lloyd_runs, run_weights
from murmura.operators.seeding import coordinates, seed_centers, seed_runs, vectors_held
from murmura.session import cut_lineage, scratch, taken

# Coordinates of one part that a task holds at once, 64 MB.
PART_DOUBLES = 8_000_000
PARTS_PER_TASK = 16
# The list of parts too large for a task is broadcast up to here.
BROADCAST_PARTS = 1_000_000
# Files of a batch of large parts, for each partition of the shuffle that writes it at most.
BATCH_FILES = 64
# Coordinates of the centers and candidates of all runs that share a pass.
RUN_DOUBLES = 1_000_000


def _check(k: int, parts: int = 1, rounds: int = 0) -> None:
    if k < 1 or parts < 1 or rounds < 0:
        raise ValueError("k and parts must be at least 1, rounds at least 0")


def coreset(points: DataFrame, k: int, parts: int, rounds: int, seed: int = 42) -> DataFrame:
    """Weighted centers ``(id, x, w)``, at most ``k`` for each of ``parts`` parts.

    A point's part is a hash of its id.  Each part is seeded, refined and
    weighed by itself; the weights are the numbers of its points nearest to
    each center.  A part that a task can hold is done in one; a larger one is a
    run of the distributed seeding and refinement, with the same draws and
    hence the same centers, at the price of several passes over it.
    """
    _check(k, parts, rounds)
    points = points.select("id", "x")
    state = row_state(F.col("id")).alias("state")
    schema = "id string, x array<double>, w double"
    summarize = K.summarize_part

    first = points.first()
    width = max(1, len(first.x or [])) if first else 1
    part = F.floor(uniform(seed, "part", F.col("id")) * parts).cast("int")
    placed = points.withColumn("part", part)
    large = (
        placed.groupBy("part").count().where(F.col("count") > PART_DOUBLES // width).select("part").collect()
    )
    done = _by_passes(placed, sorted(r.part for r in large), width, k, rounds, seed, schema)
    if large:
        rest = placed.sparkSession.createDataFrame(large, "part int")
        few = len(large) <= BROADCAST_PARTS
        placed = placed.join(F.broadcast(rest) if few else rest, "part", "left_anti")

    def reduce_part(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        yield from summarize(str(key[0].as_py()), batches, k, rounds, seed)

    # About 1 GB per task at most; where the session's own number of shuffle
    # partitions gives that, adaptive execution may still coalesce them.
    tasks = math.ceil(parts / PARTS_PER_TASK)
    usual = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = (tasks,) if tasks > usual else ()
    # Ids are hashed after the shuffle, which moves only points.
    held = (
        placed.repartition(*number, "part")
        .select("part", "x", state)
        .groupBy("part")
        .applyInArrow(reduce_part, schema)
    )
    return reduce(DataFrame.unionByName, done, held)


def stored_by_batch(placed: DataFrame, large: list[int], together: int) -> DataFrame:
    """``(id, x, _run, _batch)`` of the ``large`` parts, written once with a folder for each batch.

    The passes of a batch read its folder, so what is read grows with the part and
    not with the table.
    """
    runs = [(part, at % together, at // together) for at, part in enumerate(large)]
    table = placed.sparkSession.createDataFrame(runs, "part int, _run int, _batch int")
    few = len(large) <= BROADCAST_PARTS
    own = placed.join(F.broadcast(table) if few else table, "part").select("id", "x", "_run", "_batch")
    # A batch lies in several files, so that many tasks read it.
    return cut_lineage(own.repartition("_batch", salt(BATCH_FILES, F.col("id"))), "_batch")


def _by_passes(
    placed: DataFrame, large: list[int], width: int, k: int, rounds: int, seed: int, schema: str
) -> list[DataFrame]:
    """Centers of the ``large`` parts, each a run; as many share their passes as memory allows."""
    spark, done = placed.sparkSession, []
    if not large:
        return done
    together = max(1, RUN_DOUBLES // (vectors_held(k) * width))
    stored = stored_by_batch(placed, large, together)
    for number, start in enumerate(range(0, len(large), together)):
        batch = large[start : start + together]
        own = stored.where(F.col("_batch") == number).select("id", "x", "_run")
        picks = seed_runs(own, [k] * len(batch), [seed] * len(batch))
        centers = lloyd_runs(own, [coordinates(p) for p in picks], [rounds] * len(batch))
        rows = [
            (f"{part}:0:{index}", x, w)
            for part, found, weights in zip(batch, centers, run_weights(own, centers))
            for index, (x, w) in enumerate(zip(found.tolist(), weights.tolist()))
        ]
        done.append(cut_lineage(spark.createDataFrame(rows, schema)))
    return done


def kmedian_coreset(
    points: DataFrame, k: int, parts: int, rounds: int, seed: int = 42
) -> DataFrame:
    """``(coreset_points, centers, objective)`` of a three-round k-median.

    The coreset is drawn once and written; seeding and refinement then run on
    it as on any weighted points, and the objective is taken on all points.
    """
    with scratch():
        core = cut_lineage(coreset(points, k, parts, rounds, seed))
        picks = seed_centers(core, k, seed)
        if not picks:
            return points.sparkSession.createDataFrame(
                [(0, 0, None)], "coreset_points bigint, centers int, objective double"
            )
        centers = lloyd(core, coordinates(picks), rounds)
        size = core.agg(F.count("*").alias("n")).scalar()
        return taken(
            C.objective(points, centers).select(
                size.alias("coreset_points"), F.lit(len(centers)).alias("centers"), "objective"
            )
        )


def kmedian_trials(
    points: DataFrame,
    ks: Sequence[int],
    rounds: Sequence[int],
    trials: int,
    seed: int = 42,
) -> DataFrame:
    """``(k, rounds, trials, lowest, highest, average)`` of the objective.

    Every combination is seeded and refined ``trials`` times with seeds of
    its own.  Runs go through the data together, so the number of passes does
    not depend on the number of trials.
    """
    for k in ks:
        for count in rounds:
            _check(k, 1, count)
    runs = [(k, count, trial) for k in ks for count in rounds for trial in range(trials)]
    points = points.select("id", "x").persist()
    try:
        outcome = _objectives(points, runs, seed)
    finally:
        points.unpersist()
    table = points.sparkSession.createDataFrame(
        outcome, "k int, rounds int, trial int, objective double"
    )
    return table.groupBy("k", "rounds").agg(
        F.count("*").alias("trials"),
        F.min("objective").alias("lowest"),
        F.max("objective").alias("highest"),
        F.avg("objective").alias("average"),
    )


def _objectives(points: DataFrame, runs: list[tuple[int, int, int]], seed: int) -> list[tuple]:
    """``(k, rounds, trial, objective)`` of every run; run ``i`` is drawn by ``seed + i``."""
    first = points.first()
    if first is None:
        return []
    vectors = vectors_held(max(k for k, _, _ in runs))
    together = max(1, RUN_DOUBLES // (vectors * max(1, len(first.x))))
    outcome: list[tuple] = []
    for start in range(0, len(runs), together):
        batch = runs[start : start + together]
        seeds = [seed + start + i for i in range(len(batch))]
        picks = seed_runs(points, [k for k, _, _ in batch], seeds)
        centers = lloyd_runs(points, [coordinates(p) for p in picks], [r for _, r, _ in batch])
        means = {r.run: r.objective for r in C.mean_distance_runs(points, centers).collect()}
        outcome += [(*run, means[i]) for i, run in enumerate(batch)]
    return outcome
