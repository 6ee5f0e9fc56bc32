"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import storage


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in the columns ``a`` and ``b`` of ``links``.

    The component is its smallest id.  Each turn hangs neighbours on the
    smallest id they know of, which halves the depth of what is not yet a star;
    turns grow with the logarithm of the ids.  Nothing is gathered per id but minima.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    stars = storage.written(pairs.distinct())
    state = _state(stars)
    while True:
        stars = storage.written(_small_star(_large_star(stars)))
        last, state = state, _state(stars)
        if state == last:
            return stars


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Larger neighbours of each id go to the smallest among it and its neighbours."""
    there = stars.select(F.col("id").alias("u"), F.col("component").alias("v"))
    both = there.unionAll(stars.select(F.col("component").alias("u"), F.col("id").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component"))
    larger = stars.select(F.col("component").alias("u"), "id")
    return larger.join(least, "u").where("id <> component").select("id", "component").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Smaller neighbours of each id, and itself, go to the smallest of them."""
    least = stars.groupBy("id").agg(F.min("component").alias("_least"))
    moved = stars.join(least, "id").select(F.col("component").alias("id"), F.col("_least").alias("component"))
    own = least.select("id", F.col("_least").alias("component"))
    return moved.where("id <> component").unionAll(own).distinct()
