"""Text files, one record per line, parsed by position.

Each format has a parser of lines ``(value)`` and a reader of files.  A line
that does not parse fails the job, under ANSI mode or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """``(value)``, one row per line of a file, folder or pattern.

    With ``min_partitions`` lines that Spark would read in fewer partitions are dealt
    into that many; others stay where they are.  The session's own split settings are
    left alone: they would reach every later read.
    """
    rows = spark.read.text(path)
    if min_partitions is None or rows.rdd.getNumPartitions() >= min_partitions:
        return rows
    return rows.repartition(min_partitions)


def write_lines(rows: DataFrame, path: str) -> None:
    """Text files below ``path`` with a line for each ``value``, a file for each partition."""
    rows.select("value").write.text(path)


def with_ids(rows: DataFrame, name: str = "id") -> DataFrame:
    """``rows`` with a unique id, counted within input partitions: no shuffle.

    It is stable for the same files and split settings.  Rows that carry a key
    of their own should use that instead.
    """
    return rows.select(F.monotonically_increasing_id().alias(name), *rows.columns)


def _number(text: Column, kind: str) -> Column:
    message = F.concat(F.lit(f"not a {kind}: "), F.coalesce(text, F.lit("a missing column")))
    return F.coalesce(text.try_cast(kind), F.raise_error(message).cast(kind))


def _fields(separator: str) -> Column:
    """The pieces between separators; empty ones at the end are dropped."""
    kept = F.rtrim(F.col("value"), F.lit(separator))
    return F.split(kept, separator, -1)


def _coordinates(fields: Column) -> Column:
    return F.transform(fields, lambda field: _number(field, "double"))


def parse_reviews(lines: DataFrame) -> DataFrame:
    """``product,user,rating,time`` to ``(product, user, rating, ts)``; more columns are ignored."""
    rows = lines.select(_fields(",").alias("f"))
    # Every column depends on both numbers, so that pruning cannot skip a check.
    both = F.struct(
        _number(F.get("f", 2), "double").alias("rating"),
        _number(F.get("f", 3), "bigint").alias("ts"),
    )
    checked = rows.select("f", both.alias("n"))
    parsed = checked.where(F.col("n.rating").isNotNull() & F.col("n.ts").isNotNull())
    return parsed.select(
        F.get("f", 0).alias("product"),
        F.get("f", 1).alias("user"),
        F.col("n.rating").alias("rating"),
        F.col("n.ts").alias("ts"),
    )


def parse_labelled_points(lines: DataFrame) -> DataFrame:
    """``x1,...,xd,cluster`` to ``(x, cluster)``, for any ``d``."""
    rows = lines.select(_fields(",").alias("f"))
    return rows.select(
        _coordinates(F.slice("f", 1, F.size("f") - 1)).alias("x"),
        _number(F.element_at("f", -1), "int").alias("cluster"),
    )


def parse_points(lines: DataFrame) -> DataFrame:
    """``x1 x2 ... xd`` to ``(x)``, for any ``d``."""
    return lines.select(_coordinates(_fields(" ")).alias("x"))


def parse_numbers(lines: DataFrame) -> DataFrame:
    """Numbers between white space to ``(value)``; blank lines are skipped."""
    pieces = lines.select(F.explode(F.split("value", r"\s+")).alias("piece"))
    piece = F.col("piece")
    return pieces.where(piece != "").select(_number(piece, "double").alias("value"))


def parse_documents(lines: DataFrame) -> DataFrame:
    """A document per line: ``(text)``."""
    return lines.select(F.col("value").alias("text"))


def _reader(
    parse: Callable[[DataFrame], DataFrame], id_name: str | None
) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
        rows = parse(read_lines(spark, path, min_partitions))
        return with_ids(rows, id_name) if id_name else rows

    read.__doc__ = f"Files of lines, read by ``{parse.__name__}``" + (
        f", with a unique ``{id_name}``." if id_name else "."
    )
    return read


read_reviews = _reader(parse_reviews, None)
read_labelled_points = _reader(parse_labelled_points, "id")
read_points = _reader(parse_points, "id")
read_numbers = _reader(parse_numbers, None)
read_documents = _reader(parse_documents, "doc_id")
