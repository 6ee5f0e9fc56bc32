"""Products ranked by ratings corrected for each user's average.

Reviews are rows ``(product, user, rating)``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.operators.per_key import join_per_key


def user_averages(reviews: DataFrame) -> DataFrame:
    """``(user, avg_rating, reviews)``, one row per user."""
    return reviews.groupBy("user").agg(
        F.avg("rating").alias("avg_rating"), F.count("*").alias("reviews")
    )


def normalized_ratings(reviews: DataFrame) -> DataFrame:
    """``(product, user, rating, norm)``: each rating minus its user's average.

    An average and a join instead of a window over the user: a window would
    put all reviews of one user into one task.
    """
    reviews = reviews.select("product", "user", "rating")
    joined = join_per_key(reviews, user_averages(reviews), "user", "reviews")
    return joined.select(
        "product", "user", "rating", (F.col("rating") - F.col("avg_rating")).alias("norm")
    )


def max_normalized(reviews: DataFrame) -> DataFrame:
    """``(product, max_norm)``: each product's best normalized rating."""
    return normalized_ratings(reviews).groupBy("product").agg(F.max("norm").alias("max_norm"))


def top_normalized(reviews: DataFrame, top: int) -> DataFrame:
    """The ``top`` products by best normalized rating; equal ones by product."""
    return max_normalized(reviews).orderBy(F.desc("max_norm"), "product").limit(top)
