"""Result shapes: summaries, single posts, folder names, rendered text, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X


def summary(posts: DataFrame, *extra: str) -> DataFrame:
    return posts.select(*S.SUMMARY, *extra)


def single_post(posts: DataFrame) -> DataFrame:
    """Every column but the raw record and the lists repeated elsewhere."""
    return posts.drop("entities", "hashtags", "raw_json", "created_at_raw")


def folder_names(memberships: DataFrame, folders: DataFrame) -> DataFrame:
    """Sorted folder names per post; memberships of unknown folders are left out."""
    named = memberships.join(folders, memberships["folder_id"] == folders["id"])
    return named.groupBy("tweet_id").agg(
        F.array_sort(F.collect_list("name")).alias("folders")
    )


def attach_folders(
    results: DataFrame,
    keys: DataFrame,
    memberships: DataFrame,
    folders: DataFrame,
) -> DataFrame:
    """Add ``folders``, empty where a post is in none.

    ``keys`` holds the posts of ``results``; memberships are cut to them before
    names are gathered.
    """
    wanted = keys.select("tweet_id").distinct()
    names = folder_names(memberships.join(wanted, "tweet_id", "left_semi"), folders)
    return results.join(names, "tweet_id", "left").withColumn(
        "folders", X.items(F.col("folders"))
    )


def parse_json_lists(rows: DataFrame) -> DataFrame:
    """``media_json``/``links_json`` text to arrays; bad or missing text is an empty list."""
    media = F.coalesce(F.from_json("media_json", S.MEDIA), F.array().cast(S.MEDIA))
    links = X.items(F.from_json("links_json", "array<string>"))
    return rows.withColumns({"media": media, "links": links}).drop("media_json", "links_json")


def json_columns(posts: DataFrame) -> DataFrame:
    """Nested columns as JSON text and times as ISO text, the shape of the archive on export."""
    nested = {
        f"{name}_json": X.json_text(F.col(name), F.size(name) == 0)
        for name in ("media", "hashtags", "links")
    }
    nested["entities_json"] = X.json_text(F.col("entities"), F.col("entities").isNull())
    times = {
        name: X.iso_text(F.col(name)) for name, kind in S.POST_TYPES.items() if kind == "timestamp"
    }
    times["created_at"] = F.coalesce(times["created_at"], F.col("created_at_raw"))
    return (
        posts.withColumns({**nested, **times})
        .drop("media", "hashtags", "links", "entities", "created_at_raw")
    )


def json_rows(results: DataFrame) -> DataFrame:
    """Every row as one JSON object in column ``json``."""
    return results.select(
        F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json")
    )


def rendered(results: DataFrame, indent: str = "  ") -> DataFrame:
    """Readable text of each post: ``tweet_id``, ``text``."""
    c = F.col
    have = set(results.columns)
    seen = c("first_seen_at") if "first_seen_at" in have else F.lit(None).cast("timestamp")
    stamp = F.coalesce(F.date_format(F.coalesce("created_at", seen), "yyyy-MM-dd"), F.lit(""))
    status = F.coalesce(X.text(c("status")), F.lit(S.AVAILABLE))
    header = F.concat(
        stamp, F.lit("  @"), F.coalesce(X.text(c("author_handle")), F.lit("?")),
        F.lit(" ("), F.coalesce("author_name", F.lit("")), F.lit(")"),
        F.when(status == S.AVAILABLE, "").otherwise(F.concat(F.lit("  ["), status, F.lit("]"))),
    )
    body = X.text(F.regexp_replace("full_text", r"^\s+|\s+$", ""))
    quote = F.when(
        X.text(c("quoted_full_text")).isNotNull(),
        F.concat(
            F.lit("quoted @"), F.coalesce(X.text(c("quoted_author_handle")), F.lit("?")),
            F.lit(": "), "quoted_full_text",
        ),
    )
    counters = F.concat_ws(
        " ", *[F.concat(F.lit(f"{name}="), c(name)) for name in ("likes", "retweets", "replies", "views")]
    )
    lines = [body, quote, X.text(counters)]
    if "folders" in have:
        lines.append(
            F.when(
                F.size("folders") > 0,
                F.concat(F.lit("folders: "), F.array_join("folders", ", ")),
            )
        )
    lines.append(X.text(c("url")))
    return results.select(
        "tweet_id",
        F.concat_ws("\n", header, *[F.concat(F.lit(indent), line) for line in lines]).alias("text"),
    )
