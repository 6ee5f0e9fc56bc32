"""Joining a table with one row per key to rows whose keys may be skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than 1/HEAVY_SHARE of all rows, so fewer
# than HEAVY_SHARE keys are heavy, whatever the data.
HEAVY_SHARE = 1000


def join_per_key(rows: DataFrame, stats: DataFrame, key: str, rows_of_key: str) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has one row per ``key``.

    ``rows_of_key`` names the column of ``stats`` with the key's row count.
    Heavy keys, fewer than ``HEAVY_SHARE`` by definition, are broadcast, and
    their rows are neither shuffled nor gathered.  The others meet in a
    shuffle join where no key exceeds ``1/HEAVY_SHARE`` of the rows; adaptive
    execution turns it into a broadcast when ``stats`` proves small.
    NULL is a key like any other.
    """
    carried = [c for c in stats.columns if c != key]
    total = stats.agg(F.sum(rows_of_key).alias("total")).scalar()
    # One struct, so that both branches ask for the same columns and share
    # the exchange that computes ``stats``.
    packed = stats.select(
        F.col(key).alias("_key"), rows_of_key, F.struct(*carried).alias("_stats")
    )
    is_heavy = F.col(rows_of_key) * HEAVY_SHARE > total
    heavy = packed.where(is_heavy).select("_key", "_stats")
    light = packed.where(~is_heavy).select("_key", "_stats")

    same = F.col(key).eqNullSafe(F.col("_key"))
    # A match always brings a struct, so a NULL one means none.
    marked = rows.join(F.broadcast(heavy), same, "left")
    of_heavy = marked.where(F.col("_stats").isNotNull())
    of_light = marked.where(F.col("_stats").isNull()).drop("_key", "_stats").join(light, same)
    return of_heavy.unionByName(of_light).select(
        *rows.columns, *[F.col("_stats")[c].alias(c) for c in carried]
    )
