"""Incremental sync: cut newest-first feeds at the first run of known posts.

A feed stops at the post that completes ``boundary`` known posts in a row.  A
post is known when the archive holds it or the same feed showed it earlier.  One
feed may be most of the data, so no step gathers a feed in one task: runs are
counted inside blocks of positions, and only one summary row per block is
ordered along the feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postarchive import schema as S

BLOCK = 65_536

# The reasons a sync reports.
EXHAUSTED = "exhausted"
AT_BOUNDARY = "reached known boundary"
ENDED = "pagination ended"


def mark_known(feed: DataFrame, archive_keys: DataFrame) -> DataFrame:
    """Add ``known`` to rows of ``feed_id``, ``pos``, ``tweet_id``.

    The only unknown row of a post is its first one, so the posts are reduced to
    their first positions before they meet the archive, and the flag comes back
    by position, a key without hot values, which is unique in a feed (see
    :func:`postarchive.sources.feed.split_valid`).  The archive's keys are cut to those
    of the feed.
    """
    firsts = feed.groupBy("feed_id", "tweet_id").agg(F.min("pos").alias("pos"))
    asked = firsts.select("tweet_id").distinct()
    held = archive_keys.select("tweet_id").join(asked, "tweet_id", "left_semi")
    fresh = firsts.join(held, "tweet_id", "left_anti").select(
        "feed_id", "pos", F.lit(False).alias("known")
    )
    return feed.join(fresh, ["feed_id", "pos"], "left").withColumn(
        "known", F.coalesce("known", F.lit(True))
    )


def known_streaks(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``block`` and ``streak``, the length of the run of known rows that ends at a row."""
    placed = marked.withColumn("block", F.floor(F.col("pos") / block))
    inside = Window.partitionBy("feed_id", "block").orderBy("pos")
    local = placed.withColumn("nth", F.row_number().over(inside)).withColumn(
        "broken_at",
        F.max(F.when(~F.col("known"), F.col("nth"))).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    # One row per block: the run at its end, and whether all of it is one run.
    tails = (
        local.groupBy("feed_id", "block")
        .agg(F.max("nth").alias("size"), F.max("broken_at").alias("broken_at"))
        .select(
            "feed_id", "block",
            (F.col("size") - F.coalesce("broken_at", F.lit(0))).alias("tail"),
            F.col("broken_at").isNotNull().cast("int").alias("broken"),
        )
    )
    along = Window.partitionBy("feed_id").orderBy("block")
    carried = (
        tails.withColumn("run", F.sum("broken").over(along))
        .withColumn(
            "run_length",
            F.sum("tail").over(Window.partitionBy("feed_id", "run").orderBy("block")),
        )
        .select(
            "feed_id", "block",
            F.coalesce(F.lag("run_length").over(along), F.lit(0)).alias("carried"),
        )
    )
    unbroken = F.col("broken_at").isNull()
    return (
        local.join(carried, ["feed_id", "block"])
        .withColumn(
            "streak",
            F.when(unbroken, F.col("nth") + F.col("carried")).otherwise(
                F.col("nth") - F.col("broken_at")
            ),
        )
        .drop("nth", "broken_at", "carried")
    )


def quick_cut(
    feed: DataFrame,
    archive_keys: DataFrame,
    boundary: int = S.QUICK_BOUNDARY,
    block: int = BLOCK,
) -> DataFrame:
    """The part of each feed a quick sync reads, with ``known`` and ``stopped_reason``.

    The stop of a feed is found among its blocks and comes back to the rows by
    block, so no join is keyed by the feed alone.
    """
    keys = feed.select("feed_id", "pos", "tweet_id")
    streaks = known_streaks(mark_known(keys, archive_keys), block)
    stops = (
        streaks.groupBy("feed_id", "block")
        .agg(F.min(F.when(F.col("streak") >= boundary, F.col("pos"))).alias("stop"))
        .withColumn("stop", F.min("stop").over(Window.partitionBy("feed_id")))
    )
    return (
        streaks.join(stops, ["feed_id", "block"])
        .where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop")))
        .select(
            "feed_id", "pos", "tweet_id", "known",
            F.when(F.col("stop").isNull(), EXHAUSTED).otherwise(AT_BOUNDARY).alias(
                "stopped_reason"
            ),
        )
    )


def full_cut(feed: DataFrame, archive_keys: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows of each feed up to an optional cap, in the shape of :func:`quick_cut`."""
    capped = limit is not None and limit > 0
    keys = feed.select("feed_id", "pos", "tweet_id")
    marked = mark_known(keys.where(F.col("pos") < limit) if capped else keys, archive_keys)
    reason = f"{ENDED} (limit {limit} requested)" if capped else ENDED
    return marked.select(
        "feed_id", "pos", "tweet_id", "known", F.lit(reason).alias("stopped_reason")
    )


def sync_counters(cut: DataFrame) -> DataFrame:
    """Per feed: rows seen, of them known and new, and why reading stopped."""
    return cut.groupBy("feed_id").agg(
        F.count("*").alias("seen"),
        F.count_if("known").alias("known"),
        F.count_if(~F.col("known")).alias("added"),
        F.max("stopped_reason").alias("stopped_reason"),
    )
