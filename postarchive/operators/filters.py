"""Predicates of the read queries, as columns and semi joins."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postarchive.functions import scalars as X


def at_least_one(limit: int) -> int:
    """``limit`` as it is; an error for one that asks for nothing."""
    if int(limit) < 1:
        raise ValueError(f"limit must be at least 1: {limit!r}")
    return int(limit)


def by_author(author: str) -> Column:
    """Exact, case-sensitive handle, given with or without leading ``@``."""
    return F.col("author_handle").isin(author.lstrip("@"), author)


def matching_folders(folders: DataFrame, folder: str) -> DataFrame:
    """Folders whose name contains ``folder`` (``%`` and ``_`` are wildcards) or whose id is it."""
    return folders.where(F.col("name").ilike(f"%{folder}%") | (F.col("id") == folder))


def in_folder(
    posts: DataFrame,
    memberships: DataFrame,
    folders: DataFrame,
    folder: str,
    multiplicity: str = "set",
) -> DataFrame:
    """Posts in a matching folder.

    ``multiplicity="bag"`` repeats a post once per matching folder, as an inner
    join does; the default keeps each post once.
    """
    matching = matching_folders(folders, folder).select(F.col("id").alias("folder_id"))
    members = memberships.join(matching, "folder_id", "left_semi").select("tweet_id")
    return posts.join(members, "tweet_id", "inner" if multiplicity == "bag" else "left_semi")


def _utc(value: str) -> datetime:
    parsed = datetime.fromisoformat(value.strip())
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def created_between(since: str | None = None, until: str | None = None) -> Column:
    """Inclusive bounds on the created time; posts without one never pass.

    An ``until`` that is only a date ends before that day.  Bounds are literals,
    so they reach the Parquet scan.
    """
    condition = F.lit(True)
    if since:
        condition = condition & (F.col("created_at") >= F.lit(_utc(since)))
    if until:
        day_only = re.fullmatch(r"\s*\d{4}-\d{2}-\d{2}\s*", until) is not None
        bound = F.lit(_utc(until))
        created = F.col("created_at")
        condition = condition & (created < bound if day_only else created <= bound)
    return condition


def last_days(days: int, as_of: datetime) -> Column:
    """Created on or after the UTC day ``days`` before ``as_of``."""
    start = as_of.astimezone(timezone.utc) if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    midnight = start.replace(hour=0, minute=0, second=0, microsecond=0)
    return F.col("created_at") >= F.lit(midnight - timedelta(days=int(days)))


def split_by_key(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a key, and the rejected ones with a reason."""
    key = X.text(F.col("tweet_id"))
    return (
        observations.where(key.isNotNull()),
        observations.where(key.isNull()).withColumn("reason", F.lit("missing tweet_id")),
    )


def select_posts(
    posts: DataFrame,
    memberships: DataFrame | None = None,
    folders: DataFrame | None = None,
    author: str | None = None,
    folder: str | None = None,
    since: str | None = None,
    until: str | None = None,
    multiplicity: str = "set",
) -> DataFrame:
    """All filters of the read queries; an argument left out does not filter."""
    if author:
        posts = posts.where(by_author(author))
    if since or until:
        posts = posts.where(created_between(since, until))
    if folder:
        posts = in_folder(posts, memberships, folders, folder, multiplicity)
    return posts
