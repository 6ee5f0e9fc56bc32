"""k-means, and a sweep over the number of clusters.

Two starts are offered.  ``race`` draws points with chances by squared
distance, in races fixed by ids and seed, and moves centers to their means: it
gives the same clusters however the points are partitioned.  ``parallel`` is
Spark ML's k-means||, whose draws depend on the partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators.centers import nearest_center
from murmura.operators.coreset import RUN_DOUBLES
from murmura.operators.lloyd import moved_runs
from murmura.operators.seeding import coordinates, seed_runs, vectors_held
from murmura.operators.silhouette import mean_silhouette

STARTS = ("race", "parallel")


def _featured(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector("x"))


def kmeans_fit(points: DataFrame, k: int, rounds: int, seed: int = 42) -> KMeansModel:
    """Spark ML's model: k-means|| start and at most ``rounds`` Lloyd rounds; may find fewer than ``k`` centers.

    Spark ML asks for ``k`` of at least 2.
    """
    return KMeans(k=k, maxIter=rounds, seed=seed).fit(_featured(points).select("features"))


def kmeans_runs(
    points: DataFrame, ks: list[int], rounds: int, seed: int = 42
) -> list[np.ndarray | None]:
    """For each ``k`` centers by the ``race`` start and ``rounds`` moves; None without points.

    There are fewer than ``k`` when the points have fewer places.  As many runs
    as memory allows share every pass.
    """
    points = points.select("id", "x")
    first = points.first()
    if first is None:
        return [None for _ in ks]
    together = max(1, RUN_DOUBLES // (vectors_held(max(ks)) * max(1, len(first.x or []))))
    found: list[np.ndarray | None] = []
    for start in range(0, len(ks), together):
        batch = ks[start : start + together]
        picks = seed_runs(points, batch, [seed] * len(batch), power=2)
        found += moved_runs(points, [coordinates(p) for p in picks], rounds)
    return found


def kmeans_centers(points: DataFrame, k: int, rounds: int, seed: int = 42) -> np.ndarray | None:
    """``kmeans_runs`` for one ``k``."""
    return kmeans_runs(points, [k], rounds, seed)[0]


def kmeans_assign(points: DataFrame, model: KMeansModel | np.ndarray) -> DataFrame:
    """``points`` with ``cluster``, the nearest center of the model or of the matrix."""
    if isinstance(model, KMeansModel):
        assigned = model.transform(_featured(points))
        return assigned.select(*points.columns, F.col("prediction").alias("cluster"))
    found = nearest_center(points, model)
    return found.select(*points.columns, F.col("cid").alias("cluster"))


def kmeans_sweep(
    points: DataFrame,
    k_start: int,
    h: int,
    rounds: int,
    sample: float,
    seed: int = 42,
    start: str = "race",
) -> DataFrame:
    """``(k, centers, silhouette)`` for ``k`` from ``k_start`` to ``k_start + h - 1``.

    The silhouette's expected sample per cluster is ``sample / k``; a single
    cluster has no silhouette, so its row is written without a fit.
    """
    if k_start < 1 or h < 1:
        raise ValueError("k_start and h must be at least 1")
    if start not in STARTS:
        raise ValueError(f"start must be one of {STARTS}")
    points = points.select("id", "x").persist()
    ks = [k for k in range(k_start, k_start + h) if k > 1]
    found = [(1, 1, None)] if k_start == 1 else []
    try:
        by_races = dict(zip(ks, kmeans_runs(points, ks, rounds, seed))) if start == "race" and ks else {}
        for k in ks:
            if start == "race":
                model = by_races[k]
                centers = 0 if model is None else len(model)
            else:
                model = kmeans_fit(points, k, rounds, seed)
                centers = len(model.clusterCenters())
            if not centers:
                found.append((k, 0, None))
                continue
            assigned = kmeans_assign(points, model).persist()
            try:
                score = mean_silhouette(assigned, sample / k, seed, clusters=k).first().silhouette
            finally:
                assigned.unpersist()
            found.append((k, centers, score))
    finally:
        points.unpersist()
    return points.sparkSession.createDataFrame(found, "k int, centers int, silhouette double")
