"""Folder membership: sets that grow by partial and are replaced by complete observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _before(observed: DataFrame):
    """The order of archived rows: none, so that any observation comes after it."""
    return F.lit(None).cast(observed.schema["seq"].dataType).alias("seq")


def fold_memberships(memberships: DataFrame, observations: DataFrame) -> DataFrame:
    """Memberships after the given observations (``MEMBERSHIP_OBSERVATIONS``).

    A complete observation replaces the set of its post, a partial one adds to
    it.  So a folder stays when it was seen at or after the post's last complete
    observation.  Both sides are aggregated before they meet: the join sees one
    row per post and one per post and folder, however often they were observed.
    """
    last_complete = (
        observations.where("complete").groupBy("tweet_id").agg(F.max("seq").alias("cut"))
    )
    seen = (
        memberships.select("tweet_id", "folder_id", _before(observations))
        .unionByName(
            observations.select("tweet_id", F.explode("folder_ids").alias("folder_id"), "seq")
        )
        .groupBy("tweet_id", "folder_id")
        .agg(F.max("seq").alias("seq"))
    )
    return (
        seen.join(last_complete, "tweet_id", "left")
        .where(F.col("cut").isNull() | (F.col("seq") >= F.col("cut")))
        .select("tweet_id", "folder_id")
    )


def add_memberships(memberships: DataFrame, added: DataFrame) -> DataFrame:
    """Union of two membership sets."""
    return memberships.unionByName(added).dropDuplicates(["tweet_id", "folder_id"])


def replace_memberships(
    memberships: DataFrame, replaced_posts: DataFrame, replacement: DataFrame
) -> DataFrame:
    """Swap the whole set of the posts in ``replaced_posts``."""
    kept = memberships.join(replaced_posts.select("tweet_id").distinct(), "tweet_id", "left_anti")
    return kept.unionByName(replacement.dropDuplicates(["tweet_id", "folder_id"]))


def folder_ids_by_post(memberships: DataFrame) -> DataFrame:
    """Distinct, sorted folder ids of every post."""
    return memberships.groupBy("tweet_id").agg(
        F.array_sort(F.collect_set("folder_id")).alias("folder_ids")
    )


def upsert_folders(folders: DataFrame, observed: DataFrame) -> DataFrame:
    """Folder table after the observed ``id``, ``name``, ``seq`` rows; last name wins."""
    rows = folders.select("id", "name", _before(observed)).unionByName(
        observed.select("id", "name", "seq")
    )
    archived = F.max(F.when(F.col("seq").isNull(), F.col("name")))
    return rows.groupBy("id").agg(F.coalesce(F.max_by("name", "seq"), archived).alias("name"))
