"""Parquet tables of a folder, shaped for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``."""
    return table(spark, folder, "documents").select("doc_id", "text")


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """``(value)`` of the events."""
    return table(spark, folder, "events").select("value")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``(product, user, rating)``: line items as suppliers' ratings of parts."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("user"),
        F.col("l_quantity").alias("rating"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, x)``; coordinates stay as stored and are widened where used."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("x")
    )


def labelled_points(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, x, cluster)``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("x"),
        F.col("label").alias("cluster"),
    )
