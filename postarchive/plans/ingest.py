"""Import and sync jobs: observations in, one new delta version out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.operators import boundary, membership, merge, registers, rollups
from postarchive.session import held
from postarchive.sources import exports, feed as feeds
from postarchive.sources.store import DELTA, ArchiveStore, Run

QUICK, FULL = "quick", "full"
# What decides between observations of a post: the order they come in, or their own times.
ARRIVAL, OBSERVED_AT = "arrival", "observed_at"
# Input of a run as it was read, kept beside the versions.
STAGING = "staging"
# Export files that a run has read.
IMPORTED = "imported"
# Records of a landed feed as they were read.
RECORDS = "records"
# Records and files a run has set aside, with reasons.
REJECTED = "rejected"


@dataclass
class RunReport:
    """What a run did.  ``summary`` is one row; the rest may be large."""

    version: int
    summary: DataFrame
    outcomes: DataFrame  # per post: outcome, content_changed, n_observations
    rejected: DataFrame  # records or files set aside, with reasons
    files: DataFrame | None = None  # of an import: the accepted files, with their counts


def _now(as_of: datetime | None) -> datetime:
    return as_of or datetime.now(timezone.utc)


@dataclass
class Merged:
    """The rows of a delta, and the run's counters as they were written."""

    rows: DataFrame
    counts: dict[str, int]


def write_merged(
    store: ArchiveStore,
    run: Run,
    observations: DataFrame,
    as_of: datetime,
    indexed: bool = True,
    order_by: str = ARRIVAL,
) -> Merged:
    """Merge observations into the stored posts as a delta.

    They are merged as they arrive, or by the time they were observed, which gives one
    archive for any order of arrival.  The counters are observed while the rows are
    written.  The index follows for the posts whose content changed.
    """
    if order_by not in (ARRIVAL, OBSERVED_AT):
        raise ValueError(f"unknown order: {order_by!r}")
    before, counted = store.snapshot(), Observation("merge")
    # Which stored posts are observed is told by keys, so that the rows of the others are not moved.
    seen = before.keys().join(observations.select(S.KEY), S.KEY, "left_semi").distinct()
    stored = before.posts(held(seen, "keys-seen"))
    if order_by == OBSERVED_AT:
        states, rows = registers.merge_states(stored, before.registers(), observations, as_of)
        store.write("registers", run, states)
    else:
        rows = merge.merge_observations(stored, observations, as_of)
    merged = store.write("posts", run, rows.observe(counted, *counters()).sortWithinPartitions(S.KEY))
    replaced = stored.join(merged.select(S.KEY), S.KEY, "left_semi")
    store.write("tallies", run, rollups.tally_change(replaced, merged.select(*S.POST_COLUMNS)))
    if indexed:
        changed = merged.where("content_changed")
        before_change = stored.join(changed.select(S.KEY), S.KEY, "left_semi")
        store.write_index(run, changed.select(*S.POST_COLUMNS), before_change)
    return Merged(merged, counted.get)


def counters() -> list:
    return [
        F.count_if(F.col("outcome") == name).alias(name)
        for name in ("added", "updated", "unchanged")
    ] + [F.coalesce(F.sum("n_observations"), F.lit(0)).alias("seen")]


COUNTERS = "added bigint, updated bigint, unchanged bigint, seen bigint"


def import_exports(
    store: ArchiveStore, paths: str | list[str], as_of: datetime | None = None
) -> RunReport:
    """Import export files, in path order, as one version.

    Files to be applied in another order are imported one call after the other.
    """
    files = exports.read_export_files(store.spark, paths)
    run = store.begin()
    listed = store.write(IMPORTED, run, exports.digests(files))
    return import_files(store, run, files.join(listed.select("file_path"), "file_path", "left_semi"), _now(as_of))


def import_new_exports(
    store: ArchiveStore, files: DataFrame, as_of: datetime, source: str | None = None
) -> RunReport | None:
    """Import the ``files`` (file_path, value) whose content no run has imported yet, each once."""
    run = store.begin()
    fresh = exports.digests(files).join(store.snapshot().imported(), "digest", "left_anti")
    listed = store.write(IMPORTED, run, fresh.groupBy("digest").agg(F.min("file_path").alias("file_path")))
    if listed.isEmpty():
        return None
    new = files.join(listed.select("file_path"), "file_path", "left_semi")
    return import_files(store, run, new, as_of, source)


def import_files(
    store: ArchiveStore, run: Run, files: DataFrame, as_of: datetime, source: str | None = None
) -> RunReport:
    """Import export texts (``file_path``, ``value``) as the version of ``run``."""
    spark, before = store.spark, store.snapshot()
    # One pass parses the files; everything after reads the staged rows.
    staged = store.write(STAGING, run, exports.read_parts(files, as_of))
    parsed = exports.split_parts(staged)
    set_aside = Observation("rejected")
    quarantine = parsed.quarantine.observe(set_aside, F.count("*").alias("errors"))
    rejected = store.write(REJECTED, run, quarantine)
    merged = write_merged(store, run, exports.normalise_entries(parsed.entries), as_of)

    observed = exports.membership_entries(parsed.entries)
    # A partial observation without folders says nothing.
    telling = observed.where(F.col("complete") | (F.size("folder_ids") > 0))
    keys = telling.select("tweet_id").distinct()
    prior = before.memberships().join(keys, "tweet_id", "left_semi")
    sets = membership.folder_ids_by_post(membership.fold_memberships(prior, telling))
    empty = F.array().cast("array<string>")
    store.write(
        "membership_sets", run,
        keys.join(sets, "tweet_id", "left").withColumn(
            "folder_ids", F.coalesce("folder_ids", empty)
        ),
    )
    named = parsed.folders.unionByName(exports.legacy_folders(observed))
    store.write(
        "folders", run,
        membership.upsert_folders(
            before.folders().join(named.select("id").distinct(), "id", "left_semi"), named
        ),
    )
    last = parsed.files.agg(
        F.max_by("account", F.when(F.col("account") != "", F.col("file_path"))).alias("account"),
        F.max_by("user_id", F.when(F.col("user_id") != "", F.col("file_path"))).alias("user_id"),
        F.count("*").alias("files"),
    ).first()
    store.add_runs(
        run,
        {
            "last_export_import_at": as_of.isoformat(),
            "account_screen_name": last["account"],
            "account_user_id": last["user_id"],
        },
        as_of,
    )
    store.commit(run, DELTA, source)
    counts = merged.counts | {
        "files": last["files"], "folders": parsed.folders.count(), "errors": set_aside.get["errors"]
    }
    summary = spark.createDataFrame(
        [tuple(counts.values())], f"{COUNTERS}, files bigint, folders bigint, errors bigint"
    )
    return RunReport(run.version, summary, _outcomes(merged.rows), rejected, parsed.files)


def sync(
    store: ArchiveStore,
    path: str | list[str],
    mode: str = QUICK,
    limit: int | None = None,
    stop_after: int = S.QUICK_BOUNDARY,
    as_of: datetime | None = None,
    order_by: str = ARRIVAL,
) -> RunReport:
    """Merge landed feeds: up to the known boundary, or all of them."""
    if mode not in (QUICK, FULL):
        raise ValueError(f"unknown sync mode: {mode!r}")
    as_of = _now(as_of)
    run, known = store.begin(), store.snapshot().keys()
    listed = feeds.read_manifest(store.spark, path) if mode == QUICK and isinstance(path, str) else None
    # The records are read once; everything after reads them as staged.
    if listed is None:
        records = store.write(RECORDS, run, feeds.read_feed(store.spark, path, limit))
    else:
        records = read_frontier(store, run, listed, known, stop_after, limit)
    places = held(feeds.repeated_places(records), "places-repeated")
    good, bad = feeds.split_valid(records, places)
    set_aside = Observation("rejected")
    rejected = store.write(REJECTED, run, bad.observe(set_aside, F.count("*").alias("rejected")))
    keyed = _placed(records)
    cut = (
        boundary.quick_cut(keyed, known, stop_after)
        if mode == QUICK
        else boundary.full_cut(keyed, known, limit)
    )
    # A cut is a feed's records up to a last one: a row a feed meets the whole records, not a row a record.
    last = cut.groupBy("feed_id").agg(F.max("pos").alias("last"), F.max("stopped_reason").alias("stopped_reason"))
    last = held(last.select("feed_id.*", "last", "stopped_reason"), "feed-cut")
    reasons, reached = Observation("reasons"), F.collect_set("stopped_reason").alias("reasons")
    kept = good.join(last, ["landing", "feed_id"]).where("pos <= last").drop("last")
    taken = store.write(STAGING, run, kept.observe(reasons, reached))
    merged = write_merged(store, run, feeds.normalise_feed(taken, as_of), as_of, order_by=order_by)
    counts, stopped = merged.counts, "; ".join(sorted(reasons.get["reasons"]))
    text = (
        f"mode={mode} scanned={counts['seen']} added={counts['added']} updated={counts['updated']} "
        f"unchanged={counts['unchanged']} stopped={stopped}"
    )
    store.add_runs(
        run,
        {
            "last_sync_at": as_of.isoformat(),
            "last_sync_mode": mode,
            "last_sync_summary": text,
            "last_sync_rejected": str(set_aside.get["rejected"]),
            "last_full_sync_at": as_of.isoformat() if mode == FULL else None,
        },
        as_of,
    )
    store.commit(run, DELTA)
    result = store.spark.createDataFrame(
        [(*counts.values(), mode, stopped)], f"{COUNTERS}, mode string, stopped_reason string"
    )
    return RunReport(run.version, result, _outcomes(merged.rows), rejected)


def _placed(records: DataFrame, end: int | None = None) -> DataFrame:
    """Keys of the valid records before ``end`` by feed; a feed is cut within a landing.

    The archive alone makes posts of other landings known.  The keys are written, because
    a cut reads them many times: planned from the records each time, its plans alone take
    hundreds of MB of the driver's memory.
    """
    good, _ = feeds.split_valid(records.select(*feeds.KEYED))
    place = F.struct("landing", "feed_id")
    keys = good.select(place.alias("feed_id"), "pos", feeds.record_id().alias("tweet_id"))
    return held(keys if end is None else keys.where(F.col("pos") < end), "feed-keys")


def read_frontier(
    store: ArchiveStore,
    run: Run,
    listed: DataFrame,
    known: DataFrame,
    stop_after: int = S.QUICK_BOUNDARY,
    limit: int | None = None,
    first: int = 8,
) -> DataFrame:
    """The records of a quick sync, staged; of a landing's files only those it needs.

    ``listed`` is the manifest.  A round reads the files that begin before a position, of
    the feeds that have not met the known boundary; the position grows fourfold from
    ``first`` boundaries on, so all rounds together cut little more than the last one does.
    Up to that position a feed is complete, hence its stop is that of the whole feed.
    """
    spark, path = store.spark, store.path(RECORDS, run)
    end, feed = first * stop_after, ["landing", "feed_id"]
    waiting = listed.where(F.col("first_pos").isNull() | (F.col("first_pos") < limit)) if limit and limit > 0 else listed
    store.write(RECORDS, run, spark.createDataFrame([], S.FEED))
    read: set[str] = set()
    while True:
        wave = waiting.where(F.col("first_pos").isNull() | (F.col("first_pos") < end)).select("file").distinct()
        files = {r["file"] for r in wave.collect()} - read
        if files:
            feeds.read_feed(spark, sorted(files), limit).write.mode("append").parquet(path)
            read |= files
        records = spark.read.schema(S.FEED).parquet(path)
        cut = boundary.quick_cut(_placed(records, end), known, stop_after)
        stopped = cut.where(F.col("stopped_reason") == boundary.AT_BOUNDARY).select("feed_id.*").distinct()
        further = waiting.where(F.col("first_pos") >= end)
        waiting = held(further.join(held(stopped, "feeds-stopped"), feed, "left_anti"), "feeds-waiting")
        nearest = waiting.agg(F.min("first_pos")).first()[0]
        if nearest is None:
            return records
        # Feeds whose next file lies further on go on from there.
        end = max(4 * end, nearest + 1)


def _outcomes(merged: DataFrame) -> DataFrame:
    return merged.select(S.KEY, "outcome", "content_changed", "n_observations")
