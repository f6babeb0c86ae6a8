"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.functions import text as T
from postarchive.operators import (
    boundary, filters, index as ix, membership, merge, projections, registers, rollups, search, selftest,
)
from postarchive.plans import bindings as B
from postarchive.plans.ingest import FULL, QUICK, sync
from postarchive.session import configure, shared_dir
from postarchive.sources import exports, feed as feeds
from postarchive.sources.store import ArchiveStore
from postarchive.streaming.cut import run_cut
from postarchive.streaming.ingest import StreamIngest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


MERGED = [
    "tweet_id", "url", "full_text", "author_handle", "likes", "views", "hashtags", "status",
    "unavailable_reason", "origin", "first_seen_at", "last_seen_at", "content_updated_at",
]
QUOTED = [
    "quoted_tweet_id", "quoted_full_text", "quoted_author_handle", "quoted_author_name", "card_type", "card_title",
    "card_url",
]


def nested() -> dict:
    """All media and entities of a post, as joined text."""
    mention = lambda m: F.concat_ws("/", m["screen_name"], m["user_id"])
    return {
        "media_types": F.array_join("media.type", "|"),
        "media_urls": F.array_join("media.url", "|"),
        "media_thumbnails": F.array_join("media.thumbnail_url", "|"),
        "tags": F.array_join("entities.hashtags", "|"),
        "cashtags": F.array_join("entities.cashtags", "|"),
        "mentions": F.array_join(F.transform("entities.mentions", mention), "|"),
    }


SEARCH_RESULT = ["query_id", "rank", "tweet_id", "score", "match_mode"]


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Times as ISO text and arrays as joined text, for comparison."""
    kinds = dict(df.dtypes)

    def plain(name: str):
        if kinds[name] == "timestamp":
            return X.iso_text(F.col(name)).alias(name)
        if kinds[name] == "array<string>":
            return F.array_join(name, "|").alias(name)
        return F.col(name)

    return df.select(*[plain(name) for name in columns])


# --- merge ------------------------------------------------------------------


@query
def merge_observations(spark, sf_dir):
    """The archive after merging the later half of the month into the earlier one."""
    early, late = B.split_observations(spark, sf_dir)
    prior = merge.fold(early, B.AS_OF).select(*S.POST_COLUMNS)
    merged = merge.merge_observations(prior, late, B.AS_OF)
    return flat(merge.apply_merge(prior, merged), MERGED)


@query
def merge_outcomes(spark, sf_dir):
    early, late = B.split_observations(spark, sf_dir)
    prior = merge.fold(early, B.AS_OF).select(*S.POST_COLUMNS)
    merged = merge.merge_observations(prior, late, B.AS_OF)
    return merged.groupBy("outcome", "content_changed").agg(
        F.count("*").alias("posts"), F.sum("n_observations").alias("observations")
    )


@query
def merge_by_time(spark, sf_dir):
    """Merged by observed time, the later half of the month first."""
    early, late = B.split_observations(spark, sf_dir)
    nothing = late.limit(0).select(*S.POST_COLUMNS)
    none = spark.createDataFrame([], registers.REGISTERS)
    states, rows = registers.merge_states(nothing, none, late, B.AS_OF)
    after, _ = registers.merge_states(rows.select(*S.POST_COLUMNS), states, early, B.AS_OF)
    untouched = states.join(after.select(S.KEY), S.KEY, "left_anti")
    return flat(registers.post_rows(after.unionByName(untouched)), MERGED)


@query
def membership_fold(spark, sf_dir):
    return membership.fold_memberships(
        B.prior_memberships(spark, sf_dir), B.membership_observations(spark, sf_dir)
    )


@query
def membership_add(spark, sf_dir):
    seen = B.membership_observations(spark, sf_dir).select(
        "tweet_id", F.explode("folder_ids").alias("folder_id")
    )
    return membership.add_memberships(B.prior_memberships(spark, sf_dir), seen)


@query
def membership_replace(spark, sf_dir):
    complete = B.membership_observations(spark, sf_dir).where("complete")
    seen = complete.select("tweet_id", F.explode("folder_ids").alias("folder_id"))
    return membership.replace_memberships(B.prior_memberships(spark, sf_dir), complete, seen)


@query
def folder_ids_by_post(spark, sf_dir):
    return flat(
        membership.folder_ids_by_post(B.memberships(spark, sf_dir)), ["tweet_id", "folder_ids"]
    )


@query
def folder_upsert(spark, sf_dir):
    return membership.upsert_folders(
        B.folders(spark, sf_dir), B.folder_observations(spark, sf_dir)
    )


@query
def stream_merge(spark, sf_dir):
    """All observations through the streaming ingest, read back from its store."""
    root = shared_dir(spark, "stream-merge")
    store = ArchiveStore(spark, f"{root}/archive")
    shape = B.table(spark, sf_dir, "events").schema
    # A pattern, because a stream reads a single file only through one.
    events = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")
    StreamIngest(store, "merge", f"{root}/checkpoint", indexed=False, as_of=B.AS_OF).run(
        B.observations(events)
    )
    return flat(store.posts(), MERGED)


@query
def stream_quick_cut(spark, sf_dir):
    """The cut of all feeds over a stream that lands in parts, going on after each of them."""
    root, parts = shared_dir(spark, "stream-cut"), 4
    rows, keys = B.feed(spark, sf_dir), B.archived_keys(spark, sf_dir)
    first, last = rows.agg(F.min("pos"), F.max("pos")).first()
    part = F.floor((F.col("pos") - first) * parts / (last - first + 1))
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema(rows.schema).parquet(f"{root}/feed")
        taken = run_cut(feed, keys, f"{root}/taken", f"{root}/checkpoint")
    ends = taken.groupBy("feed_id").agg(F.max("stops").alias("stopped"))
    reason = F.when(F.col("stopped"), boundary.AT_BOUNDARY).otherwise(boundary.EXHAUSTED)
    kept = taken.where("NOT late").join(ends, "feed_id")
    return kept.select("feed_id", "pos", "tweet_id", "known", reason.alias("stopped_reason"))


# Documents of a landed file.
DOCUMENTS_A_FILE = 8192


@query
def sync_landings(spark, sf_dir):
    """A full sync of the older half of a feed, then a quick one of all of it by its manifest."""
    root = shared_dir(spark, "sync")
    store = ArchiveStore(spark, f"{root}/archive")
    documents, pos = B.table(spark, sf_dir, "documents"), F.col("doc_id")
    n, half = documents.agg(F.count("*"), F.floor(F.max(pos) / 2)).first()
    files = -(-n // DOCUMENTS_A_FILE)

    def land(rows: DataFrame, files: int) -> DataFrame:
        """Lines of documents by position; these are dealt out as they are and then written as lines."""
        return B.feed_texts(rows.repartitionByRange(files, pos))

    land(documents.where(pos >= half), max(1, files // 2)).write.text(f"{root}/older")
    # Several files of one landing, which its records state.
    stated = F.concat(F.lit('{"landing":"all",'), F.col("value").substr(F.lit(2), F.length("value")))
    land(documents, max(16, files)).select(stated).write.text(f"{root}/all")
    feeds.write_manifest(spark, f"{root}/all")
    sync(store, f"{root}/older", FULL, as_of=B.AS_OF)
    report = sync(store, f"{root}/all", QUICK, as_of=B.AS_OF)
    reason = report.summary.first()["stopped_reason"]
    return report.outcomes.select("tweet_id", "outcome", "n_observations", F.lit(reason).alias("stopped_reason"))


# --- ingest -----------------------------------------------------------------


@query
def normalize_export(spark, sf_dir):
    """Export texts to observations, with their folder observations."""
    parsed = exports.parse_exports(B.export_texts(spark, sf_dir), B.AS_OF)
    both = parsed.entries.select(*exports.post_columns(), *exports.membership_columns())
    shown = both.withColumns(
        {
            "file_path": F.col("seq.file"),
            **nested(),
        }
    )
    return flat(
        shown,
        ["tweet_id", "file_path", "url", "full_text", "lang", "created_at", "author_name",
         "author_handle", "likes", "views", "status", "hashtags", "links", "origin", "first_seen_at",
         "last_seen_at", "complete", "folder_ids", *nested(), *QUOTED],
    )


@query
def export_quarantine(spark, sf_dir):
    """Rejected files and malformed posts by reason."""
    parsed = exports.parse_exports(B.export_texts(spark, sf_dir), B.AS_OF)
    return parsed.quarantine.groupBy("reason").agg(
        F.count("*").alias("n"), F.count("pos").alias("in_file")
    )


@query
def legacy_folders(spark, sf_dir):
    """Folders that exports name without an id."""
    parsed = exports.parse_exports(B.export_texts(spark, sf_dir), B.AS_OF)
    named = exports.legacy_folders(exports.membership_entries(parsed.entries))
    return membership.upsert_folders(B.folders(spark, sf_dir), named)


@query
def normalize_feed(spark, sf_dir):
    """Landed feed lines to observations."""
    lines = B.feed_texts(B.table(spark, sf_dir, "documents"))
    records = lines.select(
        F.from_json("value", S.FEED, {"columnNameOfCorruptRecord": "_malformed"}).alias("r")
    ).select("r.*")
    good, _ = feeds.split_valid(records)
    shown = feeds.normalise_feed(good, B.AS_OF).withColumns(
        {
            "pos": F.col("seq.pos"),
            **nested(),
        }
    )
    return flat(
        shown,
        ["tweet_id", "pos", "url", "full_text", "lang", "created_at", "conversation_id",
         "author_name", "author_handle", "author_followers", "likes", "status", "hashtags",
         "links", "article_title", "article_summary", "origin", "last_seen_at", *nested(), *QUOTED],
    )


# --- incremental sync -------------------------------------------------------


@query
def quick_cut(spark, sf_dir):
    return boundary.quick_cut(B.feed(spark, sf_dir), B.archived_keys(spark, sf_dir))


@query
def full_cut(spark, sf_dir):
    return boundary.full_cut(B.feed(spark, sf_dir), B.archived_keys(spark, sf_dir))


@query
def sync_counters(spark, sf_dir):
    return boundary.sync_counters(
        boundary.quick_cut(B.feed(spark, sf_dir), B.archived_keys(spark, sf_dir))
    )


@query
def known_streaks(spark, sf_dir):
    marked = boundary.mark_known(B.feed(spark, sf_dir), B.archived_keys(spark, sf_dir))
    return boundary.known_streaks(marked, block=128).drop("block")


# --- index ------------------------------------------------------------------


@query
def build_postings(spark, sf_dir):
    """Rows per term and column with a position checksum: the whole index, aggregated."""
    return ix.tokenise(B.posts(spark, sf_dir), stem=False).groupBy("term", "col").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.max("pos").alias("pos_max")
    )


@query
def doc_lengths(spark, sf_dir):
    return ix.doc_lengths(B.posts(spark, sf_dir))


@query
def doc_freq(spark, sf_dir):
    return ix.document_frequency(ix.tokenise(B.posts(spark, sf_dir), stem=False))


@query
def incremental_index(spark, sf_dir):
    """Index of the archive without links and titles, refreshed with the real posts."""
    posts = B.posts(spark, sf_dir)
    old = posts.withColumns(
        {"links": F.lit(None).cast("array<string>"), "article_title": F.lit(None).cast("string")}
    )
    changed = posts.where(F.col("links").isNotNull() | F.col("article_title").isNotNull())
    fresh = ix.refresh(ix.build_index(old, stem=False), changed)
    return fresh.postings.groupBy("term", "col").agg(
        F.count("*").alias("n"), F.sum("dl").alias("dl_sum")
    )


@query
def index_integrity(spark, sf_dir):
    """Posts against an index that lacks the unavailable ones."""
    posts = B.posts(spark, sf_dir)
    indexed = posts.where(F.col("status") == S.AVAILABLE)
    return ix.integrity(posts, ix.doc_lengths(indexed))


# --- search -----------------------------------------------------------------


@query
def search_bm25_batch(spark, sf_dir):
    index = B.index(spark, sf_dir)
    return search.rank(B.search_queries(spark, sf_dir), index, 10)


@query
def search_and_or_fallback(spark, sf_dir):
    index = B.index(spark, sf_dir)
    return search.rank(B.fallback_queries(spark, sf_dir), index, 10)


@query
def search_phrase_prefix(spark, sf_dir):
    index = B.index(spark, sf_dir)
    return search.rank(B.phrase_queries(spark, sf_dir), index, 10)


@query
def search_filtered(spark, sf_dir):
    """Author, folder and date restrictions, with summaries and folder names."""
    found = B.archive(spark, sf_dir).search(
        B.search_queries(spark, sf_dir), 10, author="@src3", folder="NATION_1",
        since="2024-01-02", until="2024-06-30",
    )
    return flat(found, [*SEARCH_RESULT, "author_handle", "created_at", "folders"])


@query
def search_per_author(spark, sf_dir):
    """Each query restricted to an author of its own."""
    queries = B.search_queries(spark, sf_dir).withColumn(
        "author", F.concat(F.lit("@src"), (F.col("query_id").cast("bigint") % 20).cast("string"))
    )
    return search.rank(queries, B.index(spark, sf_dir), 10, B.posts(spark, sf_dir))


@query
def search_stemmed(spark, sf_dir):
    archive = B.archive(spark, sf_dir, stem=True)
    found = archive.search(B.search_queries(spark, sf_dir), 10)
    return flat(found, [*SEARCH_RESULT, "author_handle", "created_at", "folders"])


@query
def stemmed_terms(spark, sf_dir):
    """Every different term of the posts and its stem."""
    return ix.stem_table(B.index(spark, sf_dir).postings)


@query
def stemmed_vocabulary(spark, sf_dir):
    """The vocabulary of the stemmed index: posts by term and by leading part."""
    return B.index(spark, sf_dir, stem=True).vocabulary


@query
def search_terms(spark, sf_dir):
    """Terms and phrases of every query."""
    return search.query_phrases(B.phrase_queries(spark, sf_dir), stem=False)


@query
def unique_tokens(spark, sf_dir):
    tested = selftest.sample(B.posts(spark, sf_dir), size=None)
    return selftest.unique_tokens(tested, B.index(spark, sf_dir))


@query
def distinctive_tokens(spark, sf_dir):
    return B.posts(spark, sf_dir).select(
        "tweet_id", T.distinctive_word(F.col("full_text")).alias("token")
    )


@query
def self_test(spark, sf_dir):
    return B.archive(spark, sf_dir).self_test(size=None)


# --- reads ------------------------------------------------------------------


@query
def recent(spark, sf_dir):
    found = B.archive(spark, sf_dir).recent(limit=50, author="src3")
    return flat(found, ["tweet_id", "author_handle", "created_at", "folders", "url"])


@query
def recent_days(spark, sf_dir):
    found = B.archive(spark, sf_dir).recent(limit=200, days=20, folder="nation_2", as_of=B.AS_OF)
    return flat(found, ["tweet_id", "created_at", "status", "folders"])


@query
def recent_days_bag(spark, sf_dir):
    found = B.archive(spark, sf_dir).recent(
        limit=200, days=20, folder="nation_2", as_of=B.AS_OF, multiplicity="bag"
    )
    return found.groupBy("tweet_id").agg(F.count("*").alias("n"))


@query
def get_by_reference(spark, sf_dir):
    found = B.archive(spark, sf_dir).get(B.references(spark, sf_dir))
    return flat(
        found,
        ["ref_no", "ref", "ref_id", "found", "url", "author_handle", "created_at", "folders"],
    )


@query
def folder_counts(spark, sf_dir):
    return rollups.folder_counts(B.memberships(spark, sf_dir), B.folders(spark, sf_dir))


@query
def attach_folders(spark, sf_dir):
    posts = B.posts(spark, sf_dir).select("tweet_id", "author_handle")
    found = projections.attach_folders(
        posts, posts, B.memberships(spark, sf_dir), B.folders(spark, sf_dir)
    )
    return flat(found, ["tweet_id", "author_handle", "folders"])


@query
def top_authors(spark, sf_dir):
    return rollups.top_authors(B.posts(spark, sf_dir), limit=15, min_posts=2)


@query
def counts(spark, sf_dir):
    return rollups.counts(B.posts(spark, sf_dir), B.folders(spark, sf_dir))


@query
def by_origin(spark, sf_dir):
    return rollups.by_origin(B.posts(spark, sf_dir))


@query
def by_month(spark, sf_dir):
    return rollups.by_month(B.posts(spark, sf_dir))


@query
def newest(spark, sf_dir):
    return flat(rollups.newest(B.posts(spark, sf_dir)), ["newest"])


@query
def run_state_latest(spark, sf_dir):
    return rollups.latest_values(B.runs(spark, sf_dir))


@query
def archive_status(spark, sf_dir):
    return B.archive(spark, sf_dir).status()


@query
def adhoc_sql(spark, sf_dir):
    return B.archive(spark, sf_dir).sql(
        """
        SELECT f.name, b.lang, count(*) AS posts, max(b.likes) AS most_likes
        FROM bookmarks b
        JOIN bookmark_folders m ON m.tweet_id = b.tweet_id
        JOIN folders f ON f.id = m.folder_id
        WHERE b.status = 'available'
        GROUP BY f.name, b.lang
        """,
        limit=1000,
    )


@query
def validate_quarantine(spark, sf_dir):
    """Records without a key are set aside with a reason."""
    events = B.table(spark, sf_dir, "events")
    rows = B.observations(events).withColumn(
        "tweet_id", F.when(F.col("seq") % 7 > 1, F.col("tweet_id")).otherwise(
            F.when(F.col("seq") % 7 == 0, "")
        )
    )
    good, bad = filters.split_by_key(rows)
    accepted = good.groupBy(F.lit("accepted").alias("reason")).agg(
        F.count("*").alias("n"), F.sum("seq").alias("seq_sum")
    )
    return accepted.unionByName(
        bad.groupBy("reason").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))
    )


@query
def render_text(spark, sf_dir):
    posts = B.posts(spark, sf_dir)
    found = projections.attach_folders(
        posts, posts, B.memberships(spark, sf_dir), B.folders(spark, sf_dir)
    )
    return projections.rendered(found)


@query
def to_json_rows(spark, sf_dir):
    posts = projections.json_columns(B.posts(spark, sf_dir))
    return projections.json_rows(
        posts.select(
            "tweet_id", "url", "full_text", "created_at", "status", "lang", "author_name",
            "author_handle", "likes", "retweets", "views", "links_json", "origin", "last_seen_at",
        )
    )


@query
def health_report(spark, sf_dir):
    archive = B.archive(spark, sf_dir)
    synced = replace(archive, runs=archive.runs.unionByName(B.sync_runs(spark, sf_dir)))
    return synced.health(size=None)
