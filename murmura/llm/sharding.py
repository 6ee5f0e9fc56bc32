"""Shards of equal row counts, cut as runs from a Hilbert curve over several metadata columns.

Each column is quantised to ``2 ** bits`` cells of about equal numbers of rows,
in the order of its values (NULL first); rows of one value share a cell.  The cells
of a row are a point of a grid, and its place on the Hilbert curve through the grid
is the order in which rows are cut into runs.  A run is compact in all columns at
once, so filters on any of them pass over most files.

Law ``rows``: numbers of rows in the shards differ by one at most.  Rows of one grid
point are ordered by ``ties``; equal rows are interchangeable.  Copies of one text
with the same metadata are thus consecutive where ``ties`` starts with a hash of it.

Values are counted before they are ranked, and ranks come from range partitions and
their sizes, so no value, however frequent, and no shard is gathered in one task.  The
driver only sees one number per partition.  An empty table has no rows in its shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import storage

SHARDS = 24
BITS = 5
DIMENSIONS = ("lang", "source", "n_chars")
LAW = "rows"


def curve(dimensions: int) -> tuple[list[int], list[int]]:
    """``(next state, digit)`` for each state of the curve and corner of its cell.

    A state is the corner where the curve enters a cell (among ``2**dimensions``) and
    the axis along which it leaves.  Corners are visited in the order of a Gray code
    that is reflected by the entry and rotated by the axis.
    """
    n, corners = dimensions, 1 << dimensions

    def right(x: int, by: int) -> int:
        by %= n
        return (x >> by | x << n - by) & corners - 1

    def gray(x: int) -> int:
        return x ^ x >> 1

    def ones(x: int) -> int:
        """How many low bits of ``x`` are set without a gap."""
        return (~x & x + 1).bit_length() - 1

    place = {gray(x): x for x in range(corners)}
    following, digits = [], []
    for entry in range(corners):
        for axis in range(n):
            for corner in range(corners):
                digit = place[right(corner ^ entry, axis + 1)]
                # Of the child cell: the corner it is entered by, and its axis.
                inner = gray(2 * ((digit - 1) // 2)) if digit else 0
                along = ones(digit if digit % 2 else digit - 1) % n if digit else 0
                digits.append(digit)
                following.append((entry ^ right(inner, n - (axis + 1) % n)) * n + (axis + along + 1) % n)
    return following, digits


def curve_index(cells: Sequence[str], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the grid point whose coordinates are the columns ``cells``."""
    n = len(cells)
    following, digits = (f"array({', '.join(map(str, x))})" for x in curve(n))
    corner = " + ".join(f"(shiftright({c}, b) & 1) * {1 << k}" for k, c in enumerate(cells))
    return F.expr(
        f"""aggregate(sequence({bits - 1}, 0, -1), struct(0 AS state, 0L AS place), (a, b) -> struct(
              get({following}, a.state * {1 << n} + {corner}) AS state,
              shiftleft(a.place, {n}) + get({digits}, a.state * {1 << n} + {corner}) AS place),
            a -> a.place)"""
    )


def _offsets(sums: DataFrame) -> DataFrame:
    """``(_part, _before)`` from ``(_part, n)``, a row per range partition: the sum of those before it."""
    before, rows = 0, []
    for part, n in sorted(tuple(r) for r in sums.collect()):
        rows.append((part, before))
        before += n
    return F.broadcast(sums.sparkSession.createDataFrame(rows, "_part int, _before bigint"))


def cells(rows: DataFrame, column: Column, bits: int = BITS) -> DataFrame:
    """``(value, cell)`` for every value of ``column``: the share of rows with smaller values, in ``2**bits`` steps."""
    counts = rows.select(column.alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    parted = storage.written(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy("_part").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 1
    # The values of one range partition.
    inside = F.expr("sum(n) OVER (PARTITION BY _part ORDER BY value) - n")
    ranked = parted.withColumn("_inside", inside).join(_offsets(sums), "_part")
    return ranked.select("value", F.expr(f"CAST((_before + _inside) * {1 << bits} DIV {total} AS int)").alias("cell"))


def ranked(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """``rows`` with ``_rank``, their places from 0 in ``order``, and how many there are."""
    placed = storage.written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # The partition above bit 33, the place in it below.
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    sums = placed.groupBy("_part").agg(F.count("*").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.join(_offsets(sums), "_part").withColumn("_rank", F.col("_before") + place)
    return found.drop("_at", "_part", "_before"), total


def hilbert_shards(
    docs: DataFrame,
    dimensions: Sequence[str] = DIMENSIONS,
    shards: int = SHARDS,
    bits: int = BITS,
    ties: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``(shard, slot, curve, row)``: ``row`` holds the columns of ``docs``, ``slot`` counts from 0 in the shard."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    names = []
    for k, name in enumerate(dimensions):
        found = cells(rows, F.col("row")[name], bits).select(
            F.col("value").alias(f"_value{k}"), F.col("cell").alias(f"_cell{k}")
        )
        rows = rows.join(found, F.col("row")[name].eqNullSafe(F.col(f"_value{k}"))).drop(f"_value{k}")
        names.append(f"_cell{k}")
    placed = rows.select("row", curve_index(names, bits).alias("curve"))
    order = [F.col("curve"), *[F.col("row")[c] for c in ties]]
    found, total = ranked(placed, order)
    # Shard s holds the ranks from ceil(s * total / shards) on.
    shard = F.expr(f"_rank * {shards} DIV {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) DIV {shards}")
    return found.withColumn("_shard", shard).select(
        F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"), "curve", "row"
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Writes the result of ``hilbert_shards`` as Parquet, a folder ``shard=N`` each, in order.

    A large shard is several files, each a run of its own.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_shards`` wrote; filters on fields of ``row`` reach the files' statistics."""
    return spark.read.parquet(folder).select("shard", "slot", "curve", "row")
