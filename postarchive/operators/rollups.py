"""Counts over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.operators.filters import at_least_one


def counts(posts: DataFrame, folders: DataFrame) -> DataFrame:
    """One row: total, available, unavailable, folders."""
    n_folders = folders.agg(F.count("*")).scalar()
    return posts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == S.AVAILABLE).alias("available"),
    ).select(
        "total",
        "available",
        (F.col("total") - F.col("available")).alias("unavailable"),
        n_folders.alias("folders"),
    )


def by_origin(posts: DataFrame) -> DataFrame:
    return (
        posts.groupBy("origin").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "origin")
    )


def by_month(posts: DataFrame, months: int = S.MONTHS_SHOWN) -> DataFrame:
    """Posts per created month, the newest months first."""
    return (
        posts.where(F.col("created_at").isNotNull())
        .groupBy(X.month(F.col("created_at")).alias("month"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("month"))
        .limit(months)
    )


def top_authors(posts: DataFrame, limit: int = 50, min_posts: int = 2) -> DataFrame:
    """Authors with the most posts; the name is the one seen last."""
    return (
        posts.where(F.col("author_handle").isNotNull())
        .groupBy("author_handle")
        .agg(
            F.max_by("author_name", F.struct("last_seen_at", "tweet_id")).alias("author_name"),
            F.count("*").alias("bookmarks"),
        )
        .where(F.col("bookmarks") >= min_posts)
        .orderBy(F.desc("bookmarks"), "author_handle")
        .limit(at_least_one(limit))
    )


def folder_counts(memberships: DataFrame, folders: DataFrame) -> DataFrame:
    """Posts per folder, folders without posts included.

    Memberships are counted by folder first, so a folder that holds most of
    them is one row per task when it meets the folder table.
    """
    sizes = memberships.groupBy(F.col("folder_id").alias("id")).agg(
        F.count("tweet_id").alias("bookmarks")
    )
    return (
        folders.join(sizes, "id", "left")
        .select("id", "name", F.coalesce("bookmarks", F.lit(0)).cast("bigint").alias("bookmarks"))
        .orderBy(F.desc("bookmarks"), F.asc_nulls_first("name"), "id")
    )


def newest(posts: DataFrame) -> DataFrame:
    return posts.agg(F.max(X.shown_at(posts)).alias("newest"))


def latest_values(runs: DataFrame) -> DataFrame:
    """The current value of every run-state key."""
    return runs.groupBy("key").agg(
        F.max_by("value", F.struct("ts", "value")).alias("value")
    )


# Counts by group that add up: of all posts, by origin, by month and by author.
TALLIES = "section string, key string, n bigint, available bigint, newest timestamp, gone timestamp"
ALL = "all"


def tallies(posts: DataFrame, sign: int = 1) -> DataFrame:
    """``section``, ``key``, ``n``, ``available``, ``newest``, ``gone`` of all groups of the report.

    One scan of the posts: the grouping sets are the whole archive, the origins, the
    months and the authors.  With ``sign`` -1 the counts are negative, and the newest
    time is one that goes.
    """
    facts = posts.select(
        "origin",
        X.month(F.col("created_at")).alias("month"),
        "author_handle",
        "status",
        X.shown_at(posts).alias("shown"),
    )
    grouped = facts.groupingSets(
        [[], ["origin"], ["month"], ["author_handle"]], "origin", "month", "author_handle"
    ).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.count_if(F.col("status") == S.AVAILABLE).alias("available"),
        F.max("shown").alias("shown"),
    )
    # grouping_id sets a bit for every column that is not part of the set.
    section = (
        F.when(F.col("gid") == 0b011, "by_origin")
        .when(F.col("gid") == 0b101, "by_month")
        .when(F.col("gid") == 0b110, "top_authors")
        .otherwise(ALL)
    )
    nothing = F.lit(None).cast("timestamp")
    return grouped.select(
        section.alias("section"), F.coalesce("origin", "month", "author_handle").alias("key"),
        (F.col("n") * sign).alias("n"), (F.col("available") * sign).alias("available"),
        (F.col("shown") if sign > 0 else nothing).alias("newest"),
        (F.col("shown") if sign < 0 else nothing).alias("gone"),
    )


def tally_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed tallies of posts that were ``before`` and are ``after``."""
    return added(tallies(after).unionByName(tallies(before, -1)))


def added(rows: DataFrame) -> DataFrame:
    """Tallies added up; groups without posts are gone, but for the whole archive."""
    total = rows.groupBy("section", "key").agg(
        F.sum("n").alias("n"), F.sum("available").alias("available"), F.max("newest").alias("newest"),
        F.max("gone").alias("gone"),
    )
    return total.where((F.col("n") != 0) | (F.col("available") != 0) | (F.col("section") == ALL))


def archive_status(posts: DataFrame, folders: DataFrame, runs: DataFrame) -> DataFrame:
    """The status report as rows of ``section``, ``key``, ``value``, from one scan of the posts."""
    return status_report(tallies(posts), folders, runs)


def status_report(
    tallied: DataFrame, folders: DataFrame, runs: DataFrame, months: int = S.MONTHS_SHOWN, authors: int = S.AUTHORS_SHOWN
) -> DataFrame:
    """The status report of added tallies; only the largest groups of a section are shown."""
    groups = tallied.where(
        (F.col("section") != ALL) & (F.col("key").isNotNull() | (F.col("section") == "by_origin"))
    )
    order = Window.partitionBy("section").orderBy(
        F.when(F.col("section") == "by_month", F.col("key")).desc_nulls_last(),
        F.desc("n"),
        "key",
    )
    shown = (
        groups.where(F.col("section") != "by_origin")
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= max(months, authors))
        .where(F.col("nth") <= F.when(F.col("section") == "top_authors", authors).otherwise(months))
        .drop("nth")
        .unionByName(groups.where(F.col("section") == "by_origin"))
        .select("section", "key", F.col("n").cast("string").alias("value"))
    )
    n_folders = folders.agg(F.count("*")).scalar()
    totals = tallied.where(F.col("section") == ALL).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(section).alias("section"), F.lit(key).alias("key"),
                        value.cast("string").alias("value"),
                    )
                    for section, key, value in [
                        ("counts", "total", F.col("n")),
                        ("counts", "available", F.col("available")),
                        ("counts", "unavailable", F.col("n") - F.col("available")),
                        ("counts", "folders", n_folders),
                        ("newest", "newest", X.iso_text(F.col("newest"))),
                    ]
                ]
            )
        ).alias("r")
    ).select("r.*")
    state = latest_values(runs).select(F.lit("state").alias("section"), "key", "value")
    return totals.unionByName(shown).unionByName(state)
