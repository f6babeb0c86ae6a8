"""Export files: JSON documents with metadata, folders and posts.

Every file is one row until its posts are exploded, so parallelism comes from
many files; after the explode the posts are spread over all cores again by the
merge's shuffle.  Nothing is inferred and nothing aborts the job: rejected files
and malformed posts are returned as quarantine rows with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X

FILE, POST, FOLDER = "file", "post", "folder"


@dataclass
class Export:
    """The parts of a set of export files.

    ``seq``, the arrival order of posts and folders, is the path of the file, then the
    position in it.
    """

    files: DataFrame  # file_path, account columns, counts; one row per accepted file
    entries: DataFrame  # one row per well-formed post: file columns, pos, seq, post
    folders: DataFrame  # id, name, seq
    quarantine: DataFrame  # file_path, pos, reason, raw


def read_export_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: ``file_path``, ``value`` (the whole text)."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), "value")
    )


def stream_export_files(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Export files as they land, so many in a micro-batch."""
    stream = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files)
    return stream.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")


def digests(files: DataFrame) -> DataFrame:
    """``digest``, ``file_path``: what tells files apart, whatever their names."""
    return files.select(F.sha2(F.col("value").cast("binary"), 256).alias("digest"), "file_path")


def once(**columns: Column) -> Column:
    """Columns behind a generator, so that a filter above it does not compute them again."""
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))


def read_parts(files: DataFrame, as_of: datetime) -> DataFrame:
    """Export texts (``file_path``, ``value``) as rows tagged file, post or folder.

    One pass parses a file once and each of its posts and folders once; ``reason``
    marks what is to be set aside.  A job writes these rows before it splits them.
    """
    corrupt = {"columnNameOfCorruptRecord": "_malformed"}
    parsed = files.select(
        "file_path", "value", once(doc=F.from_json("value", S.EXPORT + ", _malformed string", corrupt))
    )
    doc, meta = F.col("doc"), F.col("doc.export_metadata")
    # Only a number counts as a version; as text it is any other label.
    numbered = F.col("value").rlike(r'"schema_version"\s*:\s*[0-9]')
    broken = doc["_malformed"].isNotNull() & F.get_json_object("value", "$").isNull()
    refused = (
        F.when(~F.col("value").rlike(r"^\s*\{"), "not a JSON object")
        .when(doc.isNull() | broken, "invalid JSON")
        .when(doc["bookmarks"].isNull(), "no bookmarks array")
        .when(
            (meta["schema_version"].try_cast("double") > S.MAX_EXPORT_VERSION) & numbered,
            "unsupported schema version",
        )
    )

    def tagged(part: str, raws: Column) -> Column:
        rows = F.transform(
            raws, lambda raw, i: F.struct(F.lit(part).alias("part"), i.alias("pos"), raw.alias("raw"))
        )
        return F.coalesce(rows, F.array().cast("array<struct<part:string,pos:int,raw:string>>"))

    one_file = F.array(
        F.struct(F.lit(FILE).alias("part"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("raw"))
    )
    whole = F.array(
        F.struct(F.lit(FILE).alias("part"), F.lit(None).cast("int").alias("pos"), F.col("value").alias("raw"))
    )
    parts = F.when(F.col("refused").isNotNull(), whole).otherwise(
        F.concat(one_file, tagged(POST, doc["bookmarks"]), tagged(FOLDER, doc["folders"]))
    )
    rows = parsed.withColumn("refused", refused).select(
        "file_path",
        "refused",
        meta["screen_name"].alias("account"),
        meta["user_id"].alias("user_id"),
        meta["kind"].alias("kind"),
        F.coalesce(X.instant(meta["exported_at"]), F.lit(as_of)).alias("exported_at"),
        F.coalesce(meta["collection"]["folders"] == "complete", F.lit(False)).alias("folders_complete"),
        F.inline(parts),
    )
    is_post = F.col("part") == POST
    read = rows.select(
        "*",
        once(
            post=F.from_json(F.when(is_post, F.col("raw")), S.EXPORT_ENTRY, corrupt),
            folder=F.from_json(F.when(F.col("part") == FOLDER, F.col("raw")), S.EXPORT_FOLDER),
        ),
    )
    reason = F.coalesce(
        "refused",
        F.when(
            is_post & (F.col("post").isNull() | F.col("post._malformed").isNotNull()), "malformed post"
        ).when(is_post & X.text(F.col("post.tweet_id")).isNull(), "missing tweet_id"),
    )
    return read.withColumn("reason", reason).withColumn(
        "raw", F.when(F.col("reason").isNotNull(), F.col("raw"))
    ).drop("refused")


def split_parts(parts: DataFrame) -> Export:
    """The rows of :func:`read_parts` by what they are."""
    fine = parts.where(F.col("reason").isNull())
    seq = F.struct(F.col("file_path").alias("file"), "pos").alias("seq")
    named = X.text(F.col("folder.id")).isNotNull() & X.text(F.col("folder.name")).isNotNull()
    counts = parts.groupBy("file_path").agg(
        *(
            F.max(F.when(F.col("part") == FILE, F.col(c))).alias(c)
            for c in ("account", "user_id", "kind", "exported_at", "folders_complete")
        ),
        F.count_if((F.col("part") == POST) & F.col("reason").isNull()).alias("posts"),
        F.count_if((F.col("part") == FOLDER) & named).alias("folders"),
        F.count_if(F.col("reason").isNotNull()).alias("errors"),
        F.count_if((F.col("part") == FILE) & F.col("reason").isNull()).alias("accepted"),
    )
    return Export(
        files=counts.where("accepted > 0").drop("accepted"),
        entries=fine.where(F.col("part") == POST).select(
            "file_path", "exported_at", "folders_complete", "pos", "post", seq
        ),
        folders=fine.where((F.col("part") == FOLDER) & named).select("folder.id", "folder.name", seq),
        quarantine=parts.where(F.col("reason").isNotNull()).select("file_path", "pos", "reason", "raw"),
    )


def parse_exports(files: DataFrame, as_of: datetime) -> Export:
    """Split export texts (``file_path``, ``value``) into their parts."""
    return split_parts(read_parts(files, as_of))


def _media(media: Column) -> Column:
    """Media items; the address falls back to the thumbnail."""
    return X.or_null(
        F.transform(
            F.filter(media, lambda m: m.isNotNull()),
            lambda m: F.struct(
                m["type"].alias("type"),
                X.first_text(m["url"], m["thumbnail_url"]).alias("url"),
                m["thumbnail_url"].alias("thumbnail_url"),
                m["duration_ms"].alias("duration_ms"),
                m["variants"].alias("variants"),
                m["alt_text"].alias("alt_text"),
            ),
        )
    )


def _links(urls: Column) -> Column:
    """Link texts; an entry is a bare string or an object with two addresses."""
    link = F.transform(
        urls,
        lambda u: F.when(
            u.startswith("{"),
            X.first_text(
                F.get_json_object(u, "$.expanded_url"), F.get_json_object(u, "$.url")
            ),
        ).otherwise(X.text(u)),
    )
    return X.or_null(F.filter(link, lambda u: u.isNotNull()))


def entities(hashtags: Column, cashtags: Column, mentions: Column) -> Column:
    """The entities struct, missing when all its lists are empty.

    A record without entities must not overwrite the entities already stored,
    which an all-empty struct would do.
    """
    no_mentions = F.array().cast("array<struct<screen_name:string,user_id:string>>")
    value = F.struct(
        X.items(hashtags).alias("hashtags"),
        X.items(cashtags).alias("cashtags"),
        F.coalesce(mentions, no_mentions).alias("mentions"),
    )
    filled = (
        (F.coalesce(F.size(hashtags), F.lit(0)) > 0)
        | (F.coalesce(F.size(cashtags), F.lit(0)) > 0)
        | (F.coalesce(F.size(mentions), F.lit(0)) > 0)
    )
    return F.when(filled, value)


def observation(columns: dict[str, Column]) -> list[Column]:
    """Select list of a full observation; columns not given are NULL.

    ``seq``, the arrival order, may have any type that can be compared.
    """
    return [
        columns[name].cast(kind).alias(name)
        if name in columns
        else F.expr(f"CAST(NULL AS {kind}) AS {name}")
        for name, kind in S.POST_TYPES.items()
    ] + [columns["seq"].alias("seq") if "seq" in columns else F.expr("CAST(NULL AS bigint) AS seq")]


def normalise_entries(entries: DataFrame) -> DataFrame:
    """Export posts as observations."""
    return entries.select(*post_columns())


def post_columns() -> list[Column]:
    """The observation columns of an export post."""
    p = F.col("post")
    author, metrics, quoted, card, seen = (
        p["author"], p["metrics"], p["quoted_tweet"], p["card"], p["_archive"],
    )
    status = F.when(
        p["status"].isin(S.AVAILABLE, S.UNAVAILABLE), p["status"]
    ).otherwise(
        F.when(X.text(p["full_text"]).isNotNull(), S.AVAILABLE).otherwise(S.UNAVAILABLE)
    )
    no_tags = F.array().cast("array<string>")
    return observation(
        {
            "tweet_id": p["tweet_id"],
            "url": X.post_url(p["tweet_id"], author["screen_name"]),
            "full_text": X.text(p["full_text"]),
            "lang": p["lang"],
            "created_at": X.instant(p["created_at"]),
            "created_at_raw": X.text(p["created_at"]),
            "source": p["source"],
            "conversation_id": X.text(p["conversation_id"]),
            "in_reply_to_tweet_id": X.text(p["in_reply_to_tweet_id"]),
            "author_id": X.text(author["user_id"]),
            "author_name": author["name"],
            "author_handle": author["screen_name"],
            "author_followers": X.whole_number(author["followers_count"]),
            "author_profile_image": author["profile_image_url"],
            "likes": X.whole_number(metrics["likes"]),
            "retweets": X.whole_number(metrics["retweets"]),
            "replies": X.whole_number(metrics["replies"]),
            "quotes": X.whole_number(metrics["quotes"]),
            "bookmarks": X.whole_number(metrics["bookmarks"]),
            "views": X.whole_number(metrics["views"]),
            "quoted_tweet_id": X.text(quoted["tweet_id"]),
            "quoted_full_text": X.text(quoted["full_text"]),
            "quoted_author_handle": quoted["author"]["screen_name"],
            "quoted_author_name": quoted["author"]["name"],
            "card_type": card["type"],
            "card_title": card["title"],
            "card_url": card["url"],
            "media": _media(p["media"]),
            "entities": entities(
                p["entities"]["hashtags"], no_tags, p["entities"]["mentions"]
            ),
            "hashtags": X.or_null(p["entities"]["hashtags"]),
            "links": _links(p["entities"]["urls"]),
            "sort_index": X.whole_number(p["sort_index"]),
            "status": status,
            "unavailable_reason": p["unavailable_reason"],
            "origin": F.lit(S.ORIGIN_EXPORT),
            "first_seen_at": F.coalesce(
                X.instant(seen["first_seen_at"]), F.col("exported_at")
            ),
            "last_seen_at": F.coalesce(
                X.instant(seen["last_seen_at"]), F.col("exported_at")
            ),
            "content_updated_at": X.instant(seen["content_updated_at"]),
            "seq": F.col("seq"),
        }
    )


def membership_entries(entries: DataFrame) -> DataFrame:
    """Folder observations of export posts (``MEMBERSHIP_OBSERVATIONS``)."""
    return entries.select(F.col("post.tweet_id"), "seq", *membership_columns())


def membership_columns() -> list[Column]:
    """``complete`` and ``folder_ids`` of an export post.

    Folder ids win over folder names; a name stands for the id ``legacy:<name>``.
    The post's own completeness flag wins over that of the file.
    """
    p = F.col("post")
    given = lambda a: F.filter(a, lambda x: X.text(x).isNotNull())
    ids = F.when(F.size(p["folder_ids"]) > 0, given(p["folder_ids"])).otherwise(
        F.transform(given(p["folders"]), lambda n: F.concat(F.lit(S.LEGACY_FOLDER), n))
    )
    return [
        F.coalesce(p["_archive"]["folders_complete"], F.col("folders_complete")).alias("complete"),
        X.items(ids).alias("folder_ids"),
    ]


def legacy_folders(membership_observations: DataFrame) -> DataFrame:
    """Folder rows implied by ``legacy:<name>`` ids: ``id``, ``name``, ``seq``."""
    return (
        membership_observations.select(F.explode("folder_ids").alias("id"), "seq")
        .where(F.col("id").startswith(S.LEGACY_FOLDER))
        .select("id", F.substring("id", len(S.LEGACY_FOLDER) + 1, 2**31 - 1).alias("name"), "seq")
    )
