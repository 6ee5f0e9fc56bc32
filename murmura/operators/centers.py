"""Points against a list of centers: nearest center, weights, objective.

Points are rows ``(id, x)``.  Centers are a matrix on the driver, one row per
center and its row number the center's id: they are the state of the
clustering, ``k`` vectors, and do not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import kernels as K
from murmura.functions.vectors import distance_to
from murmura.session import Chain

# Coordinates of centers sent to a task at once, 32 MB.  More centers than
# that take several passes.
BLOCK_DOUBLES = 4_000_000
# Up to that many coordinates of centers are compared by generated code in the
# JVM; more by numpy in Arrow batches, where the transfer of the points pays.
UNROLLED_DOUBLES = 100


def as_matrix(centers: Sequence[Sequence[float]] | np.ndarray) -> np.ndarray:
    rows = np.asarray(centers, dtype=np.float64)
    if rows.ndim != 2 or rows.size == 0:
        raise ValueError("at least one center is needed, all of one length")
    return rows


def first_centers(points: DataFrame, k: int) -> np.ndarray:
    """The ``k`` points of smallest id."""
    return as_matrix([r.x for r in points.select("id", "x").orderBy("id").limit(k).collect()])


def blocks(centers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The centers in blocks of bounded size, each with its first center's id."""
    size = max(1, BLOCK_DOUBLES // centers.shape[1])
    return [(start, centers[start : start + size]) for start in range(0, len(centers), size)]


def fit_a_pass(centers_of_run: Sequence[np.ndarray]) -> bool:
    """Whether all these centers may go to a task at once."""
    return sum(c.size for c in centers_of_run) <= BLOCK_DOUBLES


def _gap_in(start: int, centers: np.ndarray, x: Column, which: Column) -> Column:
    """Distance to the center of a block whose number is given, NULL where that is not in the block."""
    matrix = K.matrix

    @F.arrow_udf("double")
    def distance(column: pa.Array, given: pa.Array) -> pa.Array:
        at = given.to_numpy(zero_copy_only=False) - start
        here = (at >= 0) & (at < len(centers))
        gap = matrix(column, centers.shape[1])[here] - centers[at[here]]
        result = np.full(len(at), np.nan)
        result[here] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return pa.array(result, from_pandas=True)

    return distance(x, which)


def distance_to_given(points: DataFrame, centers: np.ndarray, which: str) -> DataFrame:
    """``points`` with ``gap``: the distance to the center whose number is in the column ``which``."""
    found, chain = points, Chain()
    for number, (start, block) in enumerate(blocks(as_matrix(centers))):
        gap = _gap_in(start, block, F.col("x"), F.col(which))
        found = found.withColumn("gap", gap) if number == 0 else chain.cut(found).withColumn("gap", F.coalesce("gap", gap))
    return found


def _nearest_in(start: int, centers: np.ndarray, x: Column) -> Column:
    """``struct<d, cid>``: the nearest of a block of centers, of equal ones the first."""
    if centers.size <= UNROLLED_DOUBLES:
        candidates = [
            F.struct(distance_to(x, center).alias("d"), F.lit(start + i).alias("cid"))
            for i, center in enumerate(centers.tolist())
        ]
        found = F.least(*candidates) if len(candidates) > 1 else candidates[0]
        # A missing coordinate makes the distance to any center NULL.
        sound = (F.size(x) == centers.shape[1]) & candidates[0]["d"].isNotNull()
        return F.when(sound, found).otherwise(
            F.raise_error(F.lit("a vector or coordinate is missing, or of another length"))
        )

    nearest, matrix, width = K.nearest, K.matrix, centers.shape[1]

    @F.arrow_udf("struct<d double, cid int>")
    def find(column: pa.Array) -> pa.Array:
        which, distance = nearest(matrix(column, width), centers)
        return pa.StructArray.from_arrays(
            [pa.array(distance), pa.array(which + np.int32(start))], names=["d", "cid"]
        )

    return find(x)


def nearest_center(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``points`` with ``cid`` and ``d``: the closest center and the distance to it.

    Of equally close centers the one with the smaller id is taken.
    """
    found, chain = points, Chain()
    for number, (start, block) in enumerate(blocks(as_matrix(centers))):
        candidate = _nearest_in(start, block, F.col("x"))
        if number == 0:
            found = found.withColumn("_near", candidate)
        else:
            # One block of centers per job, so that no task holds them all.
            found = chain.cut(found).withColumn("_near", F.least("_near", candidate))
    return found.select(
        *points.columns, F.col("_near.cid").alias("cid"), F.col("_near.d").alias("d")
    )


def center_weights(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(cid, weight)``: number of points nearest to each center, zeros included."""
    counted = nearest_center(points, centers).groupBy("cid").agg(F.count("*").alias("n"))
    every = points.sparkSession.range(len(centers)).select(F.col("id").cast("int").alias("cid"))
    return every.join(counted, "cid", "left").select(
        "cid", F.coalesce("n", F.lit(0)).cast("bigint").alias("weight")
    )


def mean_distance_runs(points: DataFrame, centers_of_run: list[np.ndarray]) -> DataFrame:
    """``(run, objective)``: mean distance to the nearest center, all runs in one pass.

    Partitions give their means; these are merged weighted by their counts.
    More centers than a task may hold go run by run, in blocks.
    """
    if not fit_a_pass(centers_of_run):
        each = [
            objective(points, centers).select(F.lit(run).alias("run"), "objective")
            for run, centers in enumerate(centers_of_run)
        ]
        return reduce(DataFrame.unionByName, each)
    partial = points.select("x").mapInArrow(
        K.mean_distances(centers_of_run), "run int, n bigint, mean double"
    )
    return partial.groupBy("run").agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("objective")
    )


def objective(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(objective)``: mean distance of the points to their nearest centers."""
    return nearest_center(points.select("x"), centers).agg(F.avg("d").alias("objective"))
