"""Archive inputs derived from the given tables.

Everything is a row-wise rule over a whole table, stated twice: here, and as SQL
in :mod:`postarchive.plans.oracles`.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.operators.index import Index, build_index
from postarchive.plans.archive import Archive
from postarchive.sources.exports import observation

EPOCH_2024 = 1704067200
FIRST_ID = 1900000000000000000
AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
PRIOR_UNTIL = datetime(2024, 1, 16, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, over all cores if its scan has fewer splits.

    The small test tables are one row group each; a large table is read as it is.
    """
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if name == "documents" and scan.rdd.getNumPartitions() < cores else scan


def post_id(n: Column) -> Column:
    return (F.lit(FIRST_ID) + n).cast("string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document."""
    d, source = F.col("doc_id"), F.col("source")
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + d * 37 * 60)
    gone = d % 11 == 0
    columns = {
        "tweet_id": post_id(d),
        "url": F.concat(F.lit("https://x.com/"), source, F.lit("/status/"), post_id(d)),
        "full_text": F.col("text"),
        "lang": F.col("lang"),
        "created_at": F.when(d % 13 != 0, created),
        "author_name": F.concat(F.lit("Author "), source),
        "author_handle": source,
        "likes": F.col("n_chars") % 1000,
        "retweets": F.when(d % 3 == 0, d % 50),
        "views": F.col("n_chars") * 10,
        "article_title": F.when(d % 7 == 0, F.concat(F.lit("Report "), F.col("lang"))),
        "links": F.when(
            d % 4 == 0,
            F.array(F.concat(F.lit("https://example.org/"), source, F.lit("/"), d.cast("string"))),
        ),
        "status": F.when(gone, S.UNAVAILABLE).otherwise(S.AVAILABLE),
        "unavailable_reason": F.when(gone, "Post deleted"),
        "origin": F.when(d % 3 == 0, "export").when(d % 3 == 1, "live").otherwise("export+live"),
        "first_seen_at": F.timestamp_seconds(F.lit(EPOCH_2024 + 3600) + d * 37 * 60),
        "last_seen_at": F.timestamp_seconds(F.lit(EPOCH_2024 + 7200) + d * 37 * 60),
    }
    return table(spark, sf_dir, "documents").select(*observation(columns)).drop("seq")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("f-"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("name"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per post, a second one for even ids; id 26 is in no folder table."""
    d = F.col("doc_id")
    second = F.when(d % 2 == 0, F.array(d * 7 % 25, d * 3 % 27)).otherwise(F.array(d * 7 % 25))
    return table(spark, sf_dir, "documents").select(
        post_id(d).alias("tweet_id"),
        F.explode(F.array_distinct(second)).alias("n"),
    ).select("tweet_id", F.concat(F.lit("f-"), F.col("n").cast("string")).alias("folder_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-state history: one key per event type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("last_"), "event_type", F.lit("_at")).alias("key"),
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync times from signups, and modes from views."""
    kind, n = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").where(kind.isin("signup", "view")).select(
        F.when(kind == "signup", "last_sync_at").otherwise("last_sync_mode").alias("key"),
        F.when(kind == "signup", F.concat(F.lit("run-"), n.cast("string")))
        .when(n % 2 == 0, "quick").otherwise("full").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def index(spark: SparkSession, sf_dir: str, stem: bool = False) -> Index:
    return build_index(posts(spark, sf_dir), stem)


def archive(spark: SparkSession, sf_dir: str, stem: bool = False) -> Archive:
    rows = posts(spark, sf_dir)
    return Archive(
        posts=rows,
        memberships=memberships(spark, sf_dir),
        folders=folders(spark, sf_dir),
        runs=runs(spark, sf_dir),
        index=build_index(rows, stem),
    )


def observations(events: DataFrame) -> DataFrame:
    """One observation per event, of the post named by the user id."""
    kind, n = F.col("event_type"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    label = n.cast("string")
    key = F.col("user_id").cast("string")
    live = kind == "click"
    handle = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    columns = {
        "tweet_id": key,
        "url": F.when(
            kind == "view", F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), key)
        ).otherwise(F.concat(F.lit(S.URL_WITHOUT_HANDLE), key)),
        "full_text": F.when(kind == "signup", "").when(~live, F.concat(kind, F.lit("-"), label)),
        "author_handle": F.when(kind == "view", handle),
        "likes": F.get_json_object("props", "$.k").try_cast("bigint"),
        "views": F.when(n % 3 == 0, n),
        "hashtags": F.when(kind == "purchase", F.array(F.concat(F.lit("tag"), label))).when(
            kind == "error", F.array().cast("array<string>")
        ),
        "status": F.when(kind == "error", S.UNAVAILABLE).when(kind != "view", S.AVAILABLE),
        "unavailable_reason": F.when(kind == "error", F.concat(F.lit("r"), label)),
        "origin": F.when(live, "live").otherwise("export"),
        "first_seen_at": F.when(~live, F.timestamp_seconds(F.unix_seconds(ts) - n % 48 * 3600)),
        "last_seen_at": F.date_trunc("second", ts),
        "content_updated_at": F.when(kind == "purchase", F.date_trunc("second", ts)),
        "seq": n,
    }
    return events.select(*observation(columns))


def split_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations of the first half of the month, and the later ones."""
    events = table(spark, sf_dir, "events")
    early = F.col("ts").cast("timestamp") < F.lit(PRIOR_UNTIL)
    return observations(events.where(early)), observations(events.where(~early))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five feeds; a quarter of the users stand for posts not seen before."""
    new_post = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("feed_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("user_id") % 4 == 0, new_post)
        .otherwise(F.col("user_id").cast("string"))
        .alias("tweet_id"),
    )


def archived_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.where(F.col("user_id") % 3 != 0).select(
        F.col("user_id").cast("string").alias("tweet_id")
    )


def membership_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are complete observations, some of them empty; errors name no folder."""
    n, kind = F.col("event_id"), F.col("event_type")
    folder = F.concat(F.lit("f-"), (n % 25).cast("string"))
    none = F.array().cast("array<string>")
    empty = (kind == "error") | ((kind == "purchase") & (n % 10 == 0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("tweet_id"),
        n.alias("seq"),
        (kind == "purchase").alias("complete"),
        F.when(empty, none).otherwise(F.array(folder)).alias("folder_ids"),
    )


def prior_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("tweet_id"),
        F.concat(F.lit("f-"), (F.col("user_id") * 7 % 25).cast("string")).alias("folder_id"),
    )


def folder_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f-"), (n % 30).cast("string")).alias("id"),
        F.concat(F.lit("name-"), n.cast("string")).alias("name"),
        n.alias("seq"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference per page: its address, mostly with a post id at the end."""
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        n.alias("ref_no"),
        F.when(n % 5 == 0, F.col("url"))
        .otherwise(F.concat("url", F.lit("/status/"), post_id(n * 5)))
        .alias("ref"),
    )


def _words(pattern: str) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's whole text as a query."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )


def fallback_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second query gets a word that no post has."""
    missing = F.when(F.col("query_id").cast("bigint") % 2 == 0, " zzqx9").otherwise("")
    return search_queries(spark, sf_dir).withColumn("query", F.concat("query", missing))


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of an item, two by two as phrases, each second word cut to two letters."""
    words = F.array_append(_words(r"\p{L}+"), F.lit(""))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 2) / 2), F.lit(0)).cast("int")),
        lambda i: F.concat(
            F.get(words, 2 * i), F.lit("-"),
            F.substring(F.coalesce(F.get(words, 2 * i + 1), F.lit("")), 1, 2),
        ),
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.array_join(pairs, " ").alias("query")
    )


def export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export text per document, among them rejected files and malformed posts."""
    c, d = F.col, F.col("doc_id")
    label = d.cast("string")
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + d * 37 * 60)
    meta = F.to_json(
        F.struct(
            F.when(d % 17 == 0, 3).otherwise(2).alias("schema_version"),
            F.lit("someone").alias("screen_name"),
            F.lit("2024-01-31T10:00:00.000Z").alias("exported_at"),
            F.struct(F.when(d % 2 == 0, "complete").otherwise("partial").alias("folders")).alias(
                "collection"
            ),
        )
    )
    written = (
        F.when(d % 5 == 0, F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(d % 5 == 1, F.date_format(created, "yyyy-MM-dd HH:mm:ss'+0000'"))
        .when(d % 5 == 2, F.unix_seconds(created).cast("string"))
        .when(d % 5 == 3, F.concat(F.lit("Mon "), F.date_format(created, "MMM dd HH:mm:ss '+0000' yyyy")))
        .otherwise("not a date")
    )
    photo, clip = (
        F.struct(F.lit(kind).alias("type"), url.alias("url"), F.concat(F.lit("https://t.co/"), label).alias("thumbnail_url"))
        for kind, url in (("photo", F.lit(None).cast("string")), ("video", F.concat(F.lit("https://v.co/"), label)))
    )
    post = F.to_json(
        F.struct(
            F.when(d % 19 != 0, post_id(d)).alias("tweet_id"),
            F.when(d % 3 == 0, S.AVAILABLE).when(d % 3 == 1, S.UNAVAILABLE).alias("status"),
            written.alias("created_at"),
            F.when(d % 7 != 0, c("text")).alias("full_text"),
            c("lang"),
            F.struct(
                F.when(d % 4 != 0, c("source")).alias("screen_name"), c("source").alias("name")
            ).alias("author"),
            F.struct(
                F.when(d % 6 == 0, "12.5").otherwise(c("n_chars").cast("string")).alias("likes"),
                c("n_chars").alias("views"),
            ).alias("metrics"),
            F.struct(
                F.when(d % 2 == 0, F.array("lang", "source")).otherwise(F.array()).alias("hashtags"),
                F.array(
                    F.struct(
                        F.when(d % 3 == 0, F.concat(F.lit("https://e.org/"), label)).alias(
                            "expanded_url"
                        ),
                        F.concat(F.lit("https://s.co/"), label).alias("url"),
                    )
                ).alias("urls"),
                F.when(
                    d % 4 == 1,
                    F.array(F.struct(c("source").alias("screen_name"), F.concat(F.lit("u"), label).alias("user_id"))),
                ).alias("mentions"),
            ).alias("entities"),
            F.when(d % 16 == 0, F.array(photo, clip)).when(d % 8 == 0, F.array(photo)).alias("media"),
            F.when(
                d % 9 == 0,
                F.struct(
                    F.lit("summary").alias("type"), F.concat(F.lit("https://c.co/"), label).alias("url"),
                    F.concat(F.lit("Card "), c("lang")).alias("title"),
                ),
            ).alias("card"),
            F.when(
                d % 12 == 0,
                F.struct(
                    post_id(d + 1).alias("tweet_id"), F.concat(F.lit("quoted "), c("lang")).alias("full_text"),
                    F.struct(c("source").alias("screen_name"), c("lang").alias("name")).alias("author"),
                ),
            ).alias("quoted_tweet"),
            F.array(F.concat(F.lit("Folder "), (d % 9).cast("string"))).alias("folders"),
            F.when(d % 2 == 0, F.array(F.concat(F.lit("f-"), (d % 25).cast("string")))).alias(
                "folder_ids"
            ),
        )
    )
    broken = F.when(d % 10 == 0, ',"oops"').otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("file-"), label).alias("file_path"),
        d.alias("file_no"),
        F.concat(
            F.lit('{"export_metadata":'), meta, F.lit(',"bookmarks":['), post, broken, F.lit("]}")
        ).alias("value"),
    )


def feed_texts(documents: DataFrame) -> DataFrame:
    """One landed feed line per document."""
    c, d = F.col, F.col("doc_id")
    label = d.cast("string")
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + d * 37 * 60)
    variant = lambda rate, name: F.struct(
        F.concat(F.lit(f"https://v.co/{name}/"), label).alias("url"),
        F.lit(rate).alias("bitrate"),
        F.lit("video/mp4").alias("contentType"),
    )
    record = F.struct(
        F.lit("main").alias("feed_id"),
        d.alias("pos"),
        F.lit("2024-01-31T10:00:00Z").alias("observed_at"),
        F.when(d % 19 != 0, post_id(d)).alias("id_str"),
        F.when(d % 19 != 0, d).alias("id"),
        F.when(d % 5 == 0, F.concat(F.lit("https://x.com/a/status/"), post_id(d))).alias("url"),
        c("text").alias("rawContent"),
        c("lang"),
        F.date_format(created, "yyyy-MM-dd HH:mm:ss'+00:00'").alias("date"),
        F.when(d % 2 == 0, "").otherwise(label).alias("conversationIdStr"),
        (d * 3).alias("conversationId"),
        F.struct(
            F.when(d % 4 != 0, c("source")).alias("username"), c("source").alias("displayname"),
            c("n_chars").alias("followersCount"),
        ).alias("user"),
        c("n_chars").alias("likeCount"),
        F.struct(
            F.when(d % 6 == 0, F.array(F.struct(F.concat(F.lit("https://p.co/"), label).alias("url"))))
            .alias("photos"),
            F.when(
                d % 3 == 0,
                F.array(
                    F.struct(
                        F.lit("https://t.co/v").alias("thumbnailUrl"),
                        F.lit(1500).alias("duration"),
                        F.when(
                            d % 2 == 0, F.array(variant(10, "low"), variant(90, "high"), variant(90, "same"))
                        ).alias("variants"),
                    )
                ),
            ).alias("videos"),
        ).alias("media"),
        F.when(d % 2 == 0, F.array("lang")).otherwise(F.array()).alias("hashtags"),
        F.when(d % 6 == 0, F.array(F.lit("usd"), c("lang"))).alias("cashtags"),
        F.when(
            d % 4 == 1, F.array(F.struct(c("source").alias("username"), d.alias("id")))
        ).alias("mentionedUsers"),
        F.when(
            d % 9 == 0,
            F.struct(
                F.lit("summary").alias("_type"), F.concat(F.lit("https://c.co/"), label).alias("url"),
                F.concat(F.lit("Card "), c("lang")).alias("title"),
            ),
        ).alias("card"),
        F.when(
            d % 12 == 0,
            F.struct(
                post_id(d + 1).alias("id_str"), F.concat(F.lit("quoted "), c("lang")).alias("rawContent"),
                F.struct(c("source").alias("username"), c("lang").alias("displayname")).alias("user"),
            ),
        ).alias("quotedTweet"),
        F.when(
            d % 7 == 0, F.struct(F.concat(F.lit("Report "), c("lang")).alias("title"), c("source").alias("preview_text"))
        ).alias("article"),
        F.array(
            F.struct(F.lit("").alias("url"), F.concat(F.lit("https://s.co/"), label).alias("tcourl")),
            F.struct(F.lit("").alias("url"), F.lit(None).cast("string").alias("tcourl")),
        ).alias("links"),
    )
    return documents.select(F.to_json(record).alias("value"))
