from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from murmura.functions.numbers import decimal_text
from murmura.operators import numbers as N


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "value double")


def test_sum_of_squares_and_maximum(spark):
    values = frame(spark, [1, 2, 3.5])
    assert N.sum_of_squares(values).first()[0] == 17.25
    assert tuple(N.maximum(values).first()) == (3.5, 3.5)


@pytest.mark.parametrize("bad", ["nan", "inf", "-1", "-inf", "-1e-300"])
def test_bad_numbers_fail(spark, bad):
    with pytest.raises(Exception, match="non-negative"):
        N.validated(frame(spark, [1, bad])).collect()
    with pytest.raises(Exception, match="non-negative"):
        N.normalized_histogram(frame(spark, [1, bad])).collect()


def test_negative_zero_is_accepted(spark):
    assert N.validated(frame(spark, [-0.0])).count() == 1
    assert [(r.hi, r.n) for r in N.normalized_histogram(frame(spark, [-0.0, 1.0])).collect()] == [
        (0.1, 1), (1.0, 1)
    ]


def test_histogram_bounds_and_labels(spark):
    values = [0, 1, 10, 10.5, 20, 95, 100]
    rows = N.normalized_histogram(frame(spark, values)).collect()
    assert [(r.hi, r.n, r.label) for r in rows] == [
        (0.1, 3, "[0,0.1]"), (0.2, 2, "(0.1,0.2]"), (1.0, 2, "(0.9,1.0]")
    ]


def test_sparse_intervals_are_dropped(spark):
    values = [100.0] * 30 + [50.0] * 3 + [10.0] * 2
    rows = N.normalized_histogram(frame(spark, values)).collect()
    assert [(r.hi, r.n) for r in rows] == [(0.5, 3), (1.0, 30)]


def test_all_zeros_make_one_interval(spark):
    rows = N.normalized_histogram(frame(spark, [0, 0, 0])).collect()
    assert [(r.hi, r.n) for r in rows] == [(0.1, 3)]


def test_empty_input(spark):
    none = spark.createDataFrame([], "value double")
    assert N.sum_of_squares(none).first()[0] is None
    assert N.normalized_histogram(none).collect() == []


@pytest.mark.parametrize(
    "value, text",
    [(2.0, "2.0"), (1.25, "1.25"), (-0.5, "-0.5"), (1 / 3, "0.3333333"), (0.0, "0.0")],
)
def test_decimal_text(spark, value, text):
    shown = frame(spark, [value]).select(decimal_text(F.col("value")).alias("shown"))
    assert shown.first().shown == text
