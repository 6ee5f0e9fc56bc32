"""Sums, maxima and histograms over numbers ``(value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import numbers as N


def squares(values: DataFrame) -> DataFrame:
    """``(value, square)``."""
    return values.select("value", (F.col("value") * F.col("value")).alias("square"))


def sum_of_squares(values: DataFrame) -> DataFrame:
    """``(sum_of_squares)``."""
    return squares(values).agg(F.sum("square").alias("sum_of_squares"))


def maximum(values: DataFrame) -> DataFrame:
    """``(by_value, by_order)``: the maximum, and the last value of an explicit order."""
    return values.agg(
        F.max("value").alias("by_value"), F.max_by("value", "value").alias("by_order")
    )


def validated(values: DataFrame) -> DataFrame:
    """``(value)``, failing on NaN, infinite and negative numbers."""
    return values.select(N.checked_nonnegative(F.col("value")).alias("value"))


def scaled(values: DataFrame) -> DataFrame:
    """``(value, share)``: each number over the largest; NULL where that is 0."""
    largest = values.agg(F.max("value").alias("largest")).scalar()
    return values.select("value", F.try_divide(F.col("value"), largest).alias("share"))


def normalized_histogram(values: DataFrame) -> DataFrame:
    """``(hi, n, label)``: numbers over their maximum, in intervals of width 0.1.

    An interval with fewer than a tenth (rounded down) of all numbers is left
    out.  Rows come in the order of ``hi``.
    """
    # One subquery for both, so the numbers are read twice in all.
    whole = values.agg(
        F.struct(F.count("*").alias("total"), F.max("value").alias("largest")).alias("whole")
    ).scalar()
    share = F.try_divide(F.col("value"), whole["largest"])
    counts = (
        validated(values)
        .groupBy(N.upper_bound(share).alias("hi"))
        .agg(F.count("*").alias("n"))
    )
    kept = counts.where(F.col("n") >= F.floor(whole["total"] / N.INTERVALS))
    return kept.select("hi", "n", N.interval_label(F.col("hi")).alias("label")).orderBy("hi")
