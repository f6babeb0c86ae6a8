"""The live feed: landed JSON lines, newest post first."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.sources.exports import entities, observation


# One landing of one feed: the same positions may come back in another landing.
PLACE = ["landing", "feed_id", "pos"]
# What tells whether a record is valid, and its post.
KEYED = [*PLACE, "id_str", "id", "_malformed"]


def _landed(records: DataFrame) -> DataFrame:
    """Names the landing of each record: the one it states, or its file by time and path.

    Landings arrive in the order of their names, which makes a later one win.
    """
    file = F.concat(
        F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS"),
        F.lit(" "), F.col("_metadata.file_path"),
    )
    return records.withColumn("landing", F.coalesce(X.text(F.col("landing")), file))


def read_feed(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Landed feed records; ``limit`` keeps the newest ``limit`` of every feed."""
    feed = spark.read.schema(S.FEED).option("columnNameOfCorruptRecord", "_malformed").json(path)
    return cap(_landed(feed), limit)


MANIFEST = "landing string, feed_id string, first_pos bigint, last_pos bigint, file string"


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What each landed file holds of each feed: first and last position.

    Files of records without a feed or position are listed with NULL and are always read.
    """
    records = _landed(spark.read.schema(S.FEED).option("columnNameOfCorruptRecord", "_malformed").json(path))
    rows = records.select("landing", "feed_id", "pos", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("landing", "feed_id", "file").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    ).select("landing", "feed_id", "first_pos", "last_pos", "file")


def write_manifest(spark: SparkSession, path: str) -> None:
    """Store the manifest of a landing beside its files, for whoever lands it."""
    manifest(spark, path).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of a landing, None without one."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_feed(spark: SparkSession, path: str) -> DataFrame:
    return _landed(
        spark.readStream.schema(S.FEED)
        .option("columnNameOfCorruptRecord", "_malformed")
        .json(path)
    )


def cap(feed: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` positions of each feed; no limit for None or <= 0."""
    return feed.where(F.col("pos").isNull() | (F.col("pos") < limit)) if limit and limit > 0 else feed


def record_id() -> Column:
    return X.first_text(F.col("id_str"), F.col("id"))


REJECTED = "landing string, feed_id string, pos bigint, reason string, raw string"


def repeated_places(feed: DataFrame) -> DataFrame:
    """The places that more than one record has."""
    return feed.groupBy(*PLACE).agg(F.count("*").alias("_n")).where("_n > 1").select(
        *(F.col(c).alias(f"_{c}") for c in PLACE), F.lit(True).alias("_repeated")
    )


def split_valid(feed: DataFrame, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Well-formed records with an id and a place of their own, and the others with a reason.

    A place (landing, feed, position) orders the observations, so it must be there and
    be one record's alone; all records of a repeated place are set aside.  ``taken``, the
    :func:`repeated_places` as they were written, saves shuffling whole records to find few.
    """
    taken = repeated_places(feed) if taken is None else taken
    reason = (
        F.when(F.col("_malformed").isNotNull(), "malformed record")
        .when(record_id().isNull(), "missing id")
        .when(X.text(F.col("feed_id")).isNull(), "missing feed_id")
        .when(F.col("pos").isNull(), "missing position")
        .when(F.col("_repeated"), "repeated position")
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE])
    marked = (
        feed.join(taken, same, "left").withColumn("reason", reason)
        .drop("_repeated", *(f"_{c}" for c in PLACE))
    )
    return (
        marked.where(F.col("reason").isNull()).drop("reason"),
        marked.where(F.col("reason").isNotNull()).select(
            *PLACE, "reason",
            F.coalesce("_malformed", F.to_json(F.struct(*feed.columns))).alias("raw"),
        ),
    )


def _best_variant(variants: Column) -> Column:
    """Address of the variant with the highest bit rate, the first of equals."""
    rated = F.transform(
        F.filter(variants, lambda v: X.text(v["url"]).isNotNull()),
        lambda v, i: F.struct(
            F.coalesce(v["bitrate"], F.lit(0)).alias("rate"), (-i).alias("place"), v["url"]
        ),
    )
    return F.array_max(rated)["url"]


def _item(kind: str, url: Column, thumbnail: Column, duration=None, variants=None) -> Column:
    missing = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        url.alias("url"),
        thumbnail.alias("thumbnail_url"),
        (missing if duration is None else duration).cast("bigint").alias("duration_ms"),
        (missing if variants is None else variants).cast(S.VARIANTS).alias("variants"),
        missing.cast("string").alias("alt_text"),
    )


def _media(media: Column) -> Column:
    """Photos, then videos, then animations, each in source order."""
    none = F.array().cast(S.MEDIA)
    photos = F.transform(
        F.filter(media["photos"], lambda p: X.text(p["url"]).isNotNull()),
        lambda p: _item("photo", p["url"], p["url"]),
    )
    videos = F.transform(
        media["videos"],
        lambda v: _item(
            "video",
            F.coalesce(_best_variant(v["variants"]), v["thumbnailUrl"]),
            v["thumbnailUrl"],
            v["duration"],
            v["variants"],
        ),
    )
    animations = F.transform(
        media["animated"], lambda g: _item("gif", g["videoUrl"], g["thumbnailUrl"])
    )
    return X.or_null(
        F.concat(
            F.coalesce(photos, none), F.coalesce(videos, none), F.coalesce(animations, none)
        )
    )


def _links(links: Column) -> Column:
    shown = F.transform(links, lambda u: X.first_text(u["url"], u["tcourl"]))
    return X.or_null(F.filter(shown, lambda u: u.isNotNull()))


def _mentions(users: Column) -> Column:
    return F.transform(
        users,
        lambda u: F.struct(
            u["username"].alias("screen_name"),
            F.coalesce(X.first_text(u["id_str"], u["id"]), F.lit("")).alias("user_id"),
        ),
    )


def normalise_feed(feed: DataFrame, as_of: datetime) -> DataFrame:
    """Feed records as observations, in feed order; a live post is available."""
    c, user, quoted = F.col, F.col("user"), F.col("quotedTweet")
    key = record_id()
    return feed.select(
        *observation(
            {
                "tweet_id": key,
                "url": F.coalesce(X.text(c("url")), X.post_url(key, user["username"])),
                "full_text": X.text(c("rawContent")),
                "lang": c("lang"),
                "created_at": X.instant(c("date")),
                "created_at_raw": X.text(c("date")),
                "source": c("sourceUrl"),
                "source_label": c("sourceLabel"),
                "conversation_id": X.first_text(c("conversationIdStr"), c("conversationId")),
                "in_reply_to_tweet_id": X.first_text(
                    c("inReplyToTweetIdStr"), c("inReplyToTweetId")
                ),
                "in_reply_to_screen_name": c("inReplyToScreenName"),
                "author_id": X.first_text(user["id_str"], user["id"]),
                "author_name": user["displayname"],
                "author_handle": user["username"],
                "author_followers": X.whole_number(user["followersCount"]),
                "author_profile_image": user["profileImageUrl"],
                "likes": X.whole_number(c("likeCount")),
                "retweets": X.whole_number(c("retweetCount")),
                "replies": X.whole_number(c("replyCount")),
                "quotes": X.whole_number(c("quoteCount")),
                "bookmarks": X.whole_number(c("bookmarkedCount")),
                "views": X.whole_number(c("viewCount")),
                "quoted_tweet_id": X.first_text(quoted["id_str"], quoted["id"]),
                "quoted_full_text": X.text(quoted["rawContent"]),
                "quoted_author_handle": quoted["user"]["username"],
                "quoted_author_name": quoted["user"]["displayname"],
                "card_type": c("card._type"),
                "card_title": c("card.title"),
                "card_url": c("card.url"),
                "article_title": c("article.title"),
                "article_summary": X.first_text(
                    c("article.summaryText"), c("article.preview_text")
                ),
                "media": _media(c("media")),
                "entities": entities(
                    c("hashtags"), c("cashtags"), _mentions(c("mentionedUsers"))
                ),
                "hashtags": X.or_null(c("hashtags")),
                "links": _links(c("links")),
                "status": F.lit(S.AVAILABLE),
                "origin": F.lit(S.ORIGIN_LIVE),
                "last_seen_at": F.coalesce(X.instant(c("observed_at")), F.lit(as_of)),
                "seq": F.struct(*PLACE),
            }
        )
    )
