"""Random draws as a hash of (seed, round, id).

``F.rand`` and ``sampleBy`` change with partitioning and with retries; a hash
of the row's id does not, and another engine can repeat it.  52 bits are kept:
with 32, a set of 1e11 points would hold many equal draws at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
STEPS = float(16**HEX_DIGITS)


def uniform(seed: int, turn: int | str, row_id: Column) -> Column:
    """A number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(turn), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(STEPS)


def row_state(row_id: Column) -> Column:
    """60 bits from which tasks derive any number of draws; see ``kernels.draws``."""
    return F.conv(F.substring(F.md5(row_id.cast("string")), 1, 15), 16, 10).cast("bigint")


def salt(parts: int, *keys: Column) -> Column:
    """A bucket in [0, parts) that depends only on ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts))
