"""Distances and sums of vectors held as arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array columns of equal length."""
    gaps = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def distance_to(x: Column, center: Sequence[float]) -> Column:
    """Distance from an array column to fixed coordinates, unrolled for generated code."""
    gaps = [F.get(x, i).cast("double") - F.lit(float(c)) for i, c in enumerate(center)]
    return F.sqrt(reduce(add, [gap * gap for gap in gaps]))


def vector_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def scaled_vector(factor: Column, x: Column) -> Column:
    return F.transform(x, lambda p: factor * p)
