"""Looking posts up by id or address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.functions import scalars as X

def requested(references: DataFrame) -> DataFrame:
    """The different ids that rows of ``ref`` ask for, with ``n``, how often."""
    ids = references.select(X.reference_id(F.col("ref")).alias("ref_id"))
    return ids.where(F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.count("*").alias("n"))


def pick(posts: DataFrame, asked: DataFrame) -> DataFrame:
    """The posts that are asked for."""
    return posts.join(asked.select(F.col("ref_id").alias("tweet_id")), "tweet_id", "left_semi")


def resolve(references: DataFrame, found: DataFrame) -> DataFrame:
    """Every reference with ``ref_id``, ``found`` and the columns of its post.

    ``found`` holds each post once.  References without an id never reach the join.
    An id that makes up much of the references is on the left side alone, whose
    partitions AQE splits.
    """
    keyed = references.withColumn("ref_id", X.reference_id(F.col("ref")))
    without_id = keyed.where(F.col("ref_id").isNull())
    with_id = keyed.where(F.col("ref_id").isNotNull())
    hits = with_id.join(found, with_id["ref_id"] == found["tweet_id"], "left")
    return hits.unionByName(without_id, allowMissingColumns=True).withColumn(
        "found", F.col("tweet_id").isNotNull()
    )
