"""Whole programs: files in, report out.

A report is a DataFrame with a ``line`` column, to show or to write; the
tables behind it are the operators' own results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.numbers import decimal_text
from murmura.operators import coreset, kmeans, numbers, ratings, silhouette, words
from murmura.session import taken
from murmura.sources import lines


def _from_parsed(parsed: DataFrame, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report on ``parsed``, which is parsed once however often the report reads it.

    A report has the few rows that were asked for.
    """
    parsed = parsed.persist()
    try:
        return taken(report(parsed))
    finally:
        parsed.unpersist()


def product_lines(best: DataFrame) -> DataFrame:
    """``(product, max_norm, line)`` of ranked products."""
    shown = F.concat(
        F.col("product"), F.lit(": best normalized rating "), decimal_text(F.col("max_norm"))
    )
    return best.withColumn("line", shown)


def top_products(spark: SparkSession, path: str, top: int) -> DataFrame:
    """``(product, max_norm, line)``: the best products of a file of reviews."""
    reviews = lines.read_reviews(spark, path).select("product", "user", "rating")
    best = _from_parsed(reviews, lambda parsed: product_lines(ratings.top_normalized(parsed, top)))
    return best.orderBy(F.desc("max_norm"), "product")


def silhouettes(spark: SparkSession, path: str, t: float, seed: int = 42) -> DataFrame:
    """``(approximate, exact_of_sample)`` of a file of labelled points, with five decimals shown."""
    scores = _from_parsed(
        lines.read_labelled_points(spark, path),
        lambda points: silhouette.sampled_and_exact(points, t, seed),
    )
    return scores.withColumn(
        "line",
        F.format_string(
            "silhouette by the sample %.5f, of the sample %.5f", "approximate", "exact_of_sample"
        ),
    )


def sweep(
    spark: SparkSession, path: str, k_start: int, h: int, rounds: int, sample: float, seed: int = 42
) -> DataFrame:
    """``(k, centers, silhouette)`` for ``h`` numbers of clusters of a file of points."""
    return kmeans.kmeans_sweep(lines.read_points(spark, path), k_start, h, rounds, sample, seed)


def word_statistics(
    spark: SparkSession, path: str, methods: Sequence[str] = tuple(words.METHODS), parts: int = 16
) -> DataFrame:
    """``(method, documents, distinct_words, avg_length, avg_all, avg_distinct)`` per method."""


    def report(docs: DataFrame) -> DataFrame:
        n_docs = docs.agg(F.count("*").alias("documents")).scalar()
        rows = [
            words.statistics(words.word_count(docs, method, parts)).select(
                F.lit(method).alias("method"), n_docs.alias("documents"), "*"
            )
            for method in methods
        ]
        return reduce(DataFrame.unionByName, rows)

    return _from_parsed(lines.read_documents(spark, path), report)


def sum_of_squares(spark: SparkSession, path: str) -> DataFrame:
    """``(sum_of_squares)`` of a file of numbers."""
    return numbers.sum_of_squares(lines.read_numbers(spark, path))


def histogram(spark: SparkSession, path: str) -> DataFrame:
    """``(hi, n, label, line)`` of a file of non-negative numbers."""
    table = _from_parsed(lines.read_numbers(spark, path), numbers.normalized_histogram)
    return table.withColumn(
        "line", F.format_string("%s holds %d", "label", "n")
    ).orderBy("hi")


def kmedian(
    spark: SparkSession, path: str, k: int, parts: int, rounds: int, seed: int = 42
) -> DataFrame:
    """``(coreset_points, centers, objective)`` of a file of points, read in ``parts`` splits."""
    return _from_parsed(
        lines.read_points(spark, path, parts),
        lambda points: coreset.kmedian_coreset(points, k, parts, rounds, seed),
    )


def kmedian_trials(
    spark: SparkSession,
    path: str,
    ks: Sequence[int],
    rounds: Sequence[int],
    trials: int,
    seed: int = 42,
) -> DataFrame:
    """``(k, rounds, trials, lowest, highest, average)`` for a file of points."""
    return coreset.kmedian_trials(lines.read_points(spark, path), ks, rounds, trials, seed)


def print_report(report: DataFrame) -> None:
    """Prints the ``line`` column row by row, without holding the report on the driver."""
    for row in report.select("line").toLocalIterator():
        print(row.line)
