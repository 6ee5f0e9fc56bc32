"""Expressions over non-negative numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ten intervals of equal width over [0, 1].
INTERVALS = 10
FIRST_BOUND = 0.1


def checked_nonnegative(value: Column) -> Column:
    """The value itself; NaN, an infinite or a negative number fails the job."""
    bad = F.isnan(value) | (value == F.lit(float("inf"))) | (value < 0)
    message = F.concat(value.cast("string"), F.lit(" is not a finite non-negative number"))
    return F.when(bad, F.raise_error(message)).otherwise(value)


def upper_bound(share: Column) -> Column:
    """Upper end of the interval of width 0.1 that holds ``share``; 0 is in the first.

    A NULL share, the quotient of zeros, counts as 0.
    """
    return F.when(F.coalesce(share, F.lit(0.0)) == 0, F.lit(FIRST_BOUND)).otherwise(
        F.ceil(share * INTERVALS) / F.lit(float(INTERVALS))
    )


def interval_label(bound: Column) -> Column:
    """``[0,0.1]`` for the first interval, ``(a,b]`` for the others."""
    low = F.when(bound == FIRST_BOUND, F.lit("[0")).otherwise(
        F.format_string("(%.1f", bound - F.lit(FIRST_BOUND))
    )
    return F.concat(low, F.format_string(",%.1f]", bound))


def decimal_text(value: Column, digits: int = 7) -> Column:
    """At least one and at most ``digits`` decimals, half-even, no padding zeros."""
    shown = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return F.regexp_replace(shown, r"(\.\d+?)0+$", "$1")
