"""Silhouette of a clustering ``(id, x, cluster)``, sampled or exact.

For each point ``a`` is the sum of squared distances to the sample of its own
cluster over ``min(t, |C|)``, the point itself included, ``b`` the least such
value over the other clusters, and the score ``(b - a) / max(a, b)``.  The
sample keeps a point of cluster ``C`` with probability ``min(t / |C|, 1)``.
A score is NULL, and left out of the mean, when the own sample is empty, no
other cluster has one, or both values are 0.  NULL is a cluster like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import kernels as K
from murmura.functions.uniform import uniform
from murmura.operators.centers import BLOCK_DOUBLES
from murmura.operators.per_key import join_per_key
from murmura.session import Chain, cut_lineage, scratch, taken

EVERY_POINT = float("inf")
# Sizes of that many clusters, about 1 MB, are broadcast when the bound is known.
BROADCAST_CLUSTERS = 50_000


def cluster_sizes(points: DataFrame) -> DataFrame:
    """``(cluster, size)``."""
    return points.groupBy("cluster").agg(F.count("*").alias("size"))


def with_sizes(points: DataFrame, clusters: int | None = None) -> DataFrame:
    """``points`` with the ``size`` of their cluster.

    ``clusters`` is the largest possible number of clusters, where known.
    """
    sizes = cluster_sizes(points)
    if clusters is not None and clusters <= BROADCAST_CLUSTERS:
        # NULL is a cluster like any other, as in the join by key.
        known = sizes.withColumnRenamed("cluster", "_cluster")
        same = F.col("cluster").eqNullSafe(F.col("_cluster"))
        return points.join(F.broadcast(known), same).select(*points.columns, "size")
    return join_per_key(points, sizes, "cluster", "size")


def cluster_sample(
    points: DataFrame, t: float, seed: int = 42, clusters: int | None = None
) -> DataFrame:
    """``points`` with ``size``, each kept with probability ``min(t / size, 1)``."""
    if not t > 0:
        raise ValueError("t must be positive")
    chance = F.least(F.lit(float(t)) / F.col("size"), F.lit(1.0))
    return with_sizes(points, clusters).where(uniform(seed, 0, F.col("id")) <= chance)


def sample_moments(sample: DataFrame, t: float) -> DataFrame:
    """``(cluster, n, mean, spread, divisor)`` of a sample.

    ``size`` is the whole cluster's; without it the sample is the cluster.
    ``spread`` is the mean square distance of the sample from its mean.  The
    summarizer updates mean and variance row by row, so clusters far from the
    origin lose no digits, and partial results are combined before the shuffle.
    """
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector("x"))
    size = F.max("size") if "size" in sample.columns else F.count("*")
    moments = sample.groupBy("cluster").agg(
        F.count("*").alias("n"), size.alias("size"), summary.alias("s")
    )
    variance = vector_to_array(F.col("s.variance"))
    # The summarizer divides by n - 1.
    spread = F.aggregate(variance, F.lit(0.0), lambda total, v: total + v)
    return moments.select(
        "cluster",
        "n",
        vector_to_array(F.col("s.mean")).alias("mean"),
        (spread * (F.col("n") - 1) / F.col("n")).alias("spread"),
        F.least(F.lit(float(t)), F.col("size").cast("double")).alias("divisor"),
    )


def _blocks(moments: DataFrame) -> Iterator[list]:
    """Rows of the moments in blocks of bounded size, one at a time."""
    block: list = []
    for row in moments.toLocalIterator():
        block.append(row)
        if len(block) * (len(row.mean) + 4) >= BLOCK_DOUBLES:
            yield block
            block = []
    if block:
        yield block


def _parts(block: list, x: Column, cluster: Column) -> Column:
    clusters = [row.cluster for row in block]
    means = np.array([row.mean for row in block])
    spreads = np.array([row.spread for row in block])
    ratios = np.array([row.n / row.divisor for row in block])
    balls = K.balls(means, spreads, ratios)
    parts, matrix, place_of = K.silhouette_parts, K.matrix, K.place_of

    @F.arrow_udf("struct<a double, b double>")
    def compare(column: pa.Array, own: pa.Array) -> pa.Array:
        places = place_of(own, clusters)
        a, b = parts(matrix(column, means.shape[1]), places, means, spreads, ratios, balls)
        return pa.StructArray.from_arrays(
            [pa.array(a, from_pandas=True), pa.array(b, from_pandas=True)], names=["a", "b"]
        )

    return compare(x, cluster)


def point_scores(points: DataFrame, moments: DataFrame) -> DataFrame:
    """``(id, cluster, a, b, score)`` of each point against the sampled clusters."""
    scored = points.select("id", "x", "cluster")
    no_value = F.lit(None).cast("double")
    previous, chain = None, Chain()
    for block in _blocks(moments):
        found = _parts(block, F.col("x"), F.col("cluster"))
        if previous is not None:
            # One block of clusters per job, so that no task holds them all.
            scored = chain.cut(previous)
            found = F.struct(
                F.coalesce("_ab.a", found["a"]).alias("a"),
                F.least("_ab.b", found["b"]).alias("b"),
            )
        previous = scored.withColumn("_ab", found)
    if previous is None:
        previous = scored.withColumn("_ab", F.struct(no_value.alias("a"), no_value.alias("b")))
    a, b = F.col("_ab.a"), F.col("_ab.b")
    # ``greatest`` skips NULL, so ask for both values.
    score = F.when(a.isNotNull() & b.isNotNull(), F.try_divide(b - a, F.greatest(a, b)))
    return previous.select("id", "cluster", a.alias("a"), b.alias("b"), score.alias("score"))


def mean_silhouette(
    points: DataFrame, t: float = EVERY_POINT, seed: int = 42, clusters: int | None = None
) -> DataFrame:
    """``(silhouette, points)``: mean score, and number of points that have one.

    ``clusters`` is the largest possible number of clusters, where known.
    """
    points = points.select("id", "x", "cluster")
    sample = points if t == EVERY_POINT else cluster_sample(points, t, seed, clusters)
    moments = sample_moments(sample, t)
    return point_scores(points, moments).agg(
        F.avg("score").alias("silhouette"), F.count("score").alias("points")
    )


def sample_silhouette(points: DataFrame, t: float, seed: int = 42) -> DataFrame:
    """``(silhouette, points)`` of the sample against itself, by its own sizes."""
    # Drawn once, then read for the moments and for the scores.
    with scratch():
        sample = cut_lineage(cluster_sample(points, t, seed).drop("size"))
        return taken(mean_silhouette(sample, EVERY_POINT))


def sampled_and_exact(points: DataFrame, t: float, seed: int = 42) -> DataFrame:
    """``(approximate, exact_of_sample)``: all points against one sample, and that sample against itself."""
    points = points.select("id", "x", "cluster")
    with scratch():
        sample = cut_lineage(cluster_sample(points, t, seed))
        approximate = point_scores(points, sample_moments(sample, t)).agg(F.avg("score").alias("s"))
        exact = mean_silhouette(sample.drop("size"), EVERY_POINT)
        return taken(
            exact.select(
                approximate.scalar().alias("approximate"), F.col("silhouette").alias("exact_of_sample")
            )
        )
