"""Registered queries over the given tables, and SQL that must agree with them.

``queries()`` maps a name to a function of (session, folder of tables);
``oracle_sql()`` holds the same question in SQL.  Doubles are rounded on both
sides, as the order of summation differs.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from murmura.functions import vectors
from murmura.operators import (
    centers,
    coreset,
    kmeans,
    lloyd,
    numbers,
    ratings,
    seeding,
    silhouette,
    words,
)
from murmura.plans import programs
from murmura.session import shared_folder
from murmura.sources import lines, tables

TOP = 20
K = 4
SAMPLE = 20
PARTS = 8
ROUNDS = 3
KEYS = 16
SEED = 42
FILE_PARTITIONS = 16


def entry(spark: SparkSession) -> DataFrame:
    """The products rated best, on the smallest tables."""
    return top_normalized(spark, "/root/testdata/sf0.001")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """``df`` with its doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]
    )


def top_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ratings.top_normalized(tables.reviews(spark, folder), TOP))


def max_norm_rating(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ratings.max_normalized(tables.reviews(spark, folder)))


def normalized_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ratings.normalized_ratings(tables.reviews(spark, folder)))


def normalized_ratings_light(spark: SparkSession, folder: str) -> DataFrame:
    """As above with an order as the user: many users, each with few reviews."""
    by_order = tables.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product"),
        F.col("l_orderkey").alias("user"),
        F.col("l_quantity").alias("rating"),
    )
    return _rounded(ratings.normalized_ratings(by_order))


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The products rated best, as lines of a report."""
    best = ratings.top_normalized(tables.reviews(spark, folder), TOP)
    return programs.product_lines(best).select("product", "line")


def _word_count(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: words.word_count(tables.documents(spark, folder), method, KEYS)


def distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    return words.corpus_size(tables.documents(spark, folder))


def word_length_int(spark: SparkSession, folder: str) -> DataFrame:
    return words.average_length_truncated(words.word_count(tables.documents(spark, folder)))


def word_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(words.average_lengths(words.word_count(tables.documents(spark, folder))))


def doc_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return words.doc_term_counts(tables.documents(spark, folder))


def sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(numbers.sum_of_squares(tables.numbers(spark, folder)), 3)


def max_value(spark: SparkSession, folder: str) -> DataFrame:
    return numbers.maximum(tables.numbers(spark, folder))


def validated_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return numbers.validated(tables.numbers(spark, folder))


def scaled_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(numbers.scaled(tables.numbers(spark, folder)))


def normalized_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return numbers.normalized_histogram(tables.numbers(spark, folder))


def _written_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "lineitem").select(
        F.concat_ws(",", "l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_returnflag")
        .alias("value")
    )


def parsed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return lines.parse_reviews(_written_reviews(spark, folder))


def parsed_numbers(spark: SparkSession, folder: str) -> DataFrame:
    written = tables.table(spark, folder, "events").select(
        F.concat_ws(" ", F.lit(" "), "value", F.lit("\t"), "event_id").alias("value")
    )
    return lines.parse_numbers(written)


def _written_points(spark: SparkSession, folder: str, separator: str) -> DataFrame:
    """Vectors as lines of text, followed by their label when comma-separated."""
    rows = tables.labelled_points(spark, folder)
    pieces = F.col("x").cast("array<double>").cast("array<string>")
    if separator == ",":
        pieces = F.concat(pieces, F.array(F.col("cluster").cast("string")))
    return rows.select(F.array_join(pieces, separator).alias("value"))


def _coordinates(rows: DataFrame) -> DataFrame:
    """A row for each coordinate of the vectors ``x``, beside the other columns."""
    rest = [c for c in rows.columns if c != "x"]
    return rows.select(*rest, F.posexplode("x").alias("axis", "coordinate"))


def parsed_points(spark: SparkSession, folder: str) -> DataFrame:
    parsed = lines.parse_points(_written_points(spark, folder, " "))
    return _coordinates(parsed.select(F.size("x").alias("d"), F.get("x", 0).alias("first"), "x"))


def parsed_labelled_points(spark: SparkSession, folder: str) -> DataFrame:
    parsed = lines.parse_labelled_points(_written_points(spark, folder, ","))
    return _coordinates(
        parsed.select("cluster", F.size("x").alias("d"), F.get("x", 0).alias("first"), "x")
    )


def _through_files(spark: SparkSession, written: DataFrame, read: Callable[..., DataFrame]) -> DataFrame:
    """The lines written to files in the shared folder and read back, in as many partitions at least as asked for."""
    folder = shared_folder(spark)
    lines.write_lines(written, folder)
    return read(spark, folder, FILE_PARTITIONS)


def file_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _through_files(spark, _written_reviews(spark, folder), lines.read_reviews)


def file_points(spark: SparkSession, folder: str) -> DataFrame:
    read = _through_files(spark, _written_points(spark, folder, " "), lines.read_points)
    return _coordinates(read.select(F.size("x").alias("d"), F.get("x", 0).alias("first"), "x"))


def file_labelled_points(spark: SparkSession, folder: str) -> DataFrame:
    read = _through_files(spark, _written_points(spark, folder, ","), lines.read_labelled_points)
    return _coordinates(read.select("cluster", F.size("x").alias("d"), F.get("x", 0).alias("first"), "x"))


def file_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The products rated best, by the program that reads a file of reviews."""
    reviews = tables.reviews(spark, folder).select(
        F.concat_ws(",", "product", "user", "rating", F.lit(0)).alias("value")
    )
    program = lambda spark, path, parts: programs.top_products(spark, path, TOP)
    best = _through_files(spark, reviews, program)
    return _rounded(best.select("product", "max_norm"))


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return silhouette.cluster_sizes(tables.labelled_points(spark, folder))


def points_with_sizes(spark: SparkSession, folder: str) -> DataFrame:
    sized = silhouette.with_sizes(tables.labelled_points(spark, folder))
    return sized.select("id", "cluster", "size")


def cluster_sample(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.labelled_points(spark, folder)
    return silhouette.cluster_sample(points, SAMPLE, SEED).select("id", "cluster", "size")


def silhouette_approx(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(silhouette.mean_silhouette(tables.labelled_points(spark, folder), SAMPLE, SEED))


def silhouette_full(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(silhouette.mean_silhouette(tables.labelled_points(spark, folder)))


def silhouette_sample(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.labelled_points(spark, folder)
    return _rounded(silhouette.sample_silhouette(points, SAMPLE, SEED))


def silhouette_points(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.labelled_points(spark, folder)
    moments = silhouette.sample_moments(
        silhouette.cluster_sample(points, SAMPLE, SEED), SAMPLE
    )
    return _rounded(silhouette.point_scores(points, moments))


def nearest_center(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    found = centers.nearest_center(points, centers.first_centers(points, K))
    return _rounded(found.select("id", "cid", "d"))


def nearest_center_low_dim(spark: SparkSession, folder: str) -> DataFrame:
    """As above in the first three dimensions."""
    points = tables.points(spark, folder).select("id", F.slice("x", 1, 3).alias("x"))
    found = centers.nearest_center(points, centers.first_centers(points, K))
    return _rounded(found.select("id", "cid", "d"))


def vector_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against its own double less the unit vector: ``x`` and ``2x - 1``."""
    points = tables.points(spark, folder).select("id", F.col("x").cast("array<double>").alias("x"))
    ones = F.transform("x", lambda p: F.lit(-1.0))
    other = vectors.vector_sum(vectors.scaled_vector(F.lit(2.0), F.col("x")), ones)
    return _rounded(
        points.select(
            "id",
            vectors.squared_distance(F.col("x"), other).alias("squared"),
            vectors.distance(F.col("x"), other).alias("distance"),
        )
    )


def center_weights(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    return centers.center_weights(points, centers.first_centers(points, K))


def kmedian_objective(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    return _rounded(centers.objective(points, centers.first_centers(points, K)))


def objective_merged(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    first = centers.first_centers(points, K)
    return _rounded(centers.mean_distance_runs(points, [first, first[:2]]))


def _weighted_points(spark: SparkSession, folder: str) -> DataFrame:
    return tables.points(spark, folder).withColumn("w", F.col("id") % 5 + 1)


def lloyd_step(spark: SparkSession, folder: str) -> DataFrame:
    points = _weighted_points(spark, folder)
    return _rounded(_coordinates(lloyd.lloyd_step(points, centers.first_centers(points, K))))


def lloyd_centers(spark: SparkSession, folder: str) -> DataFrame:
    points = _weighted_points(spark, folder)
    refined = lloyd.lloyd(points, centers.first_centers(points, K), ROUNDS)
    rows = spark.createDataFrame(list(enumerate(refined.tolist())), "cid int, x array<double>")
    return _rounded(_coordinates(rows))


def weighted_seeding(spark: SparkSession, folder: str) -> DataFrame:
    picks = seeding.seed_centers(_weighted_points(spark, folder), K, SEED)
    return spark.createDataFrame(
        [(turn, row_id) for turn, (row_id, _) in enumerate(picks)], "pick int, id bigint"
    )


def coreset_weights(spark: SparkSession, folder: str) -> DataFrame:
    core = coreset.coreset(tables.points(spark, folder), K, PARTS, ROUNDS, SEED)
    return _rounded(_coordinates(core.select("id", "w", "x")))


def kmedian_coreset(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        coreset.kmedian_coreset(tables.points(spark, folder), K, PARTS, ROUNDS, SEED)
    )


def kmedian_trials(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    return _rounded(
        coreset.kmedian_trials(
            points, oracles.TRIAL_KS, oracles.TRIAL_ROUNDS, oracles.TRIALS, SEED
        )
    )


def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.points(spark, folder)
    found = kmeans.kmeans_centers(points, K, ROUNDS, SEED)
    return kmeans.kmeans_assign(points, found).select("id", "cluster")


def kmeans_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        kmeans.kmeans_sweep(
            tables.points(spark, folder), oracles.SWEEP_KS[0], len(oracles.SWEEP_KS), ROUNDS, 5 * SAMPLE, SEED
        )
    )


def _optional(*modules: str) -> list:
    """Those of the modules that are part of this checkout, imported."""
    return [importlib.import_module(m) for m in modules if importlib.util.find_spec(m)]


# The corpus operators and their pipeline can be left out of a checkout.
_CORPUS = (
    _optional("murmura.llm.registered", "corpus_pipeline")
    # A folder that only holds compiled files counts as none.
    if importlib.util.find_spec("murmura.llm") and importlib.util.find_spec("murmura.llm.registered")
    else []
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = own_queries()
    for module in _CORPUS:
        found |= module.queries()
    return found


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "top_normalized": top_normalized,
        "max_norm_rating": max_norm_rating,
        "normalized_ratings": normalized_ratings,
        "normalized_ratings_light": normalized_ratings_light,
        "report_lines": report_lines,
        "word_count": _word_count("plain"),
        "word_count_salted": _word_count("salted"),
        "word_count_partitioned": _word_count("partitioned"),
        "word_count_partition_salted": _word_count("partition_salted"),
        "word_count_merged": _word_count("merged"),
        "distinct_words": distinct_words,
        "word_length_int": word_length_int,
        "word_length_stats": word_length_stats,
        "doc_term_counts": doc_term_counts,
        "sum_of_squares": sum_of_squares,
        "max_value": max_value,
        "validated_numbers": validated_numbers,
        "scaled_numbers": scaled_numbers,
        "normalized_histogram": normalized_histogram,
        "parsed_reviews": parsed_reviews,
        "parsed_numbers": parsed_numbers,
        "file_reviews": file_reviews,
        "file_points": file_points,
        "file_labelled_points": file_labelled_points,
        "file_top_products": file_top_products,
        "parsed_points": parsed_points,
        "parsed_labelled_points": parsed_labelled_points,
        "cluster_sizes": cluster_sizes,
        "points_with_sizes": points_with_sizes,
        "cluster_sample": cluster_sample,
        "silhouette_approx": silhouette_approx,
        "silhouette_full": silhouette_full,
        "silhouette_sample": silhouette_sample,
        "silhouette_points": silhouette_points,
        "nearest_center": nearest_center,
        "nearest_center_low_dim": nearest_center_low_dim,
        "vector_arithmetic": vector_arithmetic,
        "center_weights": center_weights,
        "kmedian_objective": kmedian_objective,
        "objective_merged": objective_merged,
        "lloyd_step": lloyd_step,
        "lloyd_centers": lloyd_centers,
        "weighted_seeding": weighted_seeding,
        "coreset_weights": coreset_weights,
        "kmedian_coreset": kmedian_coreset,
        "kmedian_trials": kmedian_trials,
        "kmeans_assign": kmeans_assign,
        "kmeans_sweep": kmeans_sweep,
    }


def oracle_sql() -> dict[str, str]:
    found = oracles.statements(
        top=TOP, k=K, sample=SAMPLE, parts=PARTS, rounds=ROUNDS, keys=KEYS, seed=SEED
    )
    for module in _CORPUS:
        found |= module.oracle_sql()
    return found
