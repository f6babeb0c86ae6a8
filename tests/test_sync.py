"""Sync of landed feeds: what it reads, how a stream is cut, and two runs at once."""

import json
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.operators import boundary, index as ix
from postarchive.plans.ingest import import_exports, sync
from postarchive.sources import feed as feeds
from postarchive.sources.store import ArchiveStore, ConcurrentRun
from postarchive.streaming.cut import run_cut

AS_OF = datetime(2026, 1, 1, tzinfo=timezone.utc)


def record(landing, pos, key, feed="main", **more):
    return {"landing": landing, "feed_id": feed, "pos": pos, "observed_at": "2025-12-31T10:00:00Z", "id_str": key,
            "rawContent": f"text of {key}", "user": {"username": "jo", "displayname": "Jo"}} | more


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in records))


def post_rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "tweet_id string").select(
        *[F.col(c) if c == "tweet_id" else F.lit(None).cast(k).alias(c) for c, k in S.POST_TYPES.items()]
    )


def test_second_of_two_runs_fails(spark, tmp_path):
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    one, two = store.begin(), store.begin()
    assert one.version == two.version
    store.write("posts", one, post_rows(spark, ["1", "2"]))
    store.write("posts", two, post_rows(spark, ["3"]))
    store.add_runs(one, {"who": "one"}, AS_OF)
    store.add_runs(two, {"who": "two"}, AS_OF)
    store.commit(one, "delta")
    with pytest.raises(ConcurrentRun):
        store.commit(two, "delta")
    assert sorted(r["tweet_id"] for r in store.posts().collect()) == ["1", "2"]
    assert [r["value"] for r in store.runs().collect()] == ["one"]
    again = store.begin()  # the second run, repeated
    store.write("posts", again, post_rows(spark, ["3"]))
    store.commit(again, "delta")
    assert store.posts().count() == 3 and [c["version"] for c in sorted(store.commits())] == [0, 1]


def test_files_behind_the_stop_are_not_opened(spark, tmp_path):
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    old, new = tmp_path / "old", tmp_path / "new"
    land(old, "a", [record("1", i, f"{1000 + i}") for i in range(15, 200)])
    sync(store, str(old), "full", as_of=AS_OF)
    for n in range(12):
        land(new, f"{n:02d}", [record("2", i, f"{1000 + i}") for i in range(10 * n, 10 * n + 10)])
    land(new, "side", [record("2", i, f"{9000 + i}", "side") for i in range(30)])
    feeds.write_manifest(spark, str(new))
    # The main feed stops at 19, so the first round, up to 40, has it; later files are spoilt.
    for n in range(4, 12):
        land(new, f"{n:02d}", [record("2", 10 * n, None, id=None)])
    report = sync(store, str(new), "quick", stop_after=5, as_of=AS_OF)
    row = report.summary.first()
    assert (row["seen"], row["added"], row["unchanged"] + row["updated"]) == (20 + 30, 15 + 30, 5)
    assert row["stopped_reason"] == "exhausted; reached known boundary"
    assert report.rejected.count() == 0
    read = spark.read.json(str(new)).select("id_str").where("id_str IS NULL").count()
    assert read == 8  # they are there, and were not opened


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_equals_reading_everything(spark, tmp_path, seed):
    rng = random.Random(seed)
    stores = [ArchiveStore(spark, f"{tmp_path}/{name}") for name in ("listed", "whole")]
    keys = [f"{1000 + i}" for i in range(400)]
    known = rng.sample(keys, 250)
    for store in stores:
        run = store.begin()
        store.write("posts", run, post_rows(spark, known))
        store.commit(run, "delta")
    rows = [record("l", i, rng.choice(keys[: 40 + 90 * f]), f"f{f}") for f in range(4) for i in range(rng.choice([9, 60, 300]))]
    listed, whole = tmp_path / "a", tmp_path / "b"
    rows.sort(key=lambda r: (r["pos"], r["feed_id"]))
    for n in range(0, len(rows), 37):
        land(listed, f"{n:04d}", rows[n : n + 37])
        land(whole, f"{n:04d}", rows[n : n + 37])
    feeds.write_manifest(spark, str(listed))
    reports = [sync(s, str(p), "quick", stop_after=3, as_of=AS_OF) for s, p in zip(stores, (listed, whole), strict=True)]
    first, second = (r.summary.first() for r in reports)
    assert first == second
    outcomes = [sorted(map(str, r.outcomes.collect())) for r in reports]
    assert outcomes[0] == outcomes[1]


def test_rounds_cut_written_keys(spark, tmp_path, monkeypatch):
    """No cut plans reading records or folding stored posts again, so a round's plans stay small on the driver."""
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    for name, first in (("one", 30), ("two", 20)):
        land(tmp_path / name, "a", [record(name, i, f"{1000 + i}") for i in range(first, 60)])
        sync(store, str(tmp_path / name), "full", as_of=AS_OF)
    keys = sorted(r["tweet_id"] for r in store.snapshot().keys().distinct().collect())
    assert keys == sorted(r["tweet_id"] for r in store.posts().select(S.KEY).collect()) == [f"{1000 + i}" for i in range(20, 60)]
    for n in range(6):
        land(tmp_path / "new", f"{n}", [record("new", i, f"{1000 + i}") for i in range(10 * n, 10 * n + 10)])
    feeds.write_manifest(spark, str(tmp_path / "new"))
    given, cut = [], boundary.quick_cut
    monkeypatch.setattr(boundary, "quick_cut", lambda feed, known, *a: given.append((feed, known)) or cut(feed, known, *a))
    row = sync(store, str(tmp_path / "new"), "quick", stop_after=2, as_of=AS_OF).summary.first()
    assert (row["added"], row["unchanged"] + row["updated"], row["stopped_reason"]) == (20, 2, "reached known boundary")
    assert len(given) == 3  # rounds up to 16 and 64, and the cut of all
    for frame in (f for pair in given for f in pair):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "full_text" not in plan and "rawContent" not in plan


def test_whole_records_meet_small_tables(spark, tmp_path, monkeypatch):
    """Repeated places and ends of feeds are written, so no shuffle is planned to set records aside or to keep them."""
    store, plans, write = ArchiveStore(spark, f"{tmp_path}/archive"), {}, ArchiveStore.write

    def noted(self, table, run, rows):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        return write(self, table, run, rows)

    monkeypatch.setattr(ArchiveStore, "write", noted)
    rows = [record("1", i, f"{1000 + i}") for i in range(20)] + [record("1", 7, "1007"), record("1", 30, None, id=None)]
    land(tmp_path / "in", "a", rows + [record("1", i, f"{2000 + i}", "side") for i in range(5)])
    for mode, seen in (("quick", 19 + 5), ("full", 19 + 5)):
        report = sync(store, str(tmp_path / "in"), mode, as_of=AS_OF)
        assert report.summary.first()["seen"] == seen
        assert sorted(r["reason"] for r in report.rejected.collect()) == ["missing id"] + ["repeated position"] * 2
        for table in ("rejected", "staging"):
            assert "BroadcastHashJoin" in plans[table]
            assert "Aggregate" not in plans[table] and "hashpartitioning" not in plans[table]


def test_stored_posts_are_told_by_keys(spark, tmp_path):
    """Of base and deltas, the newest rows of asked keys, told apart before rows are folded."""
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    for n, ids in enumerate((range(100, 106), range(103, 110), range(105, 112))):
        land(tmp_path / f"{n}", "a", [record(f"{n}", i, f"{k}", rawContent=f"text {n}") for i, k in enumerate(ids)])
        sync(store, str(tmp_path / f"{n}"), "full", as_of=AS_OF)
        if n == 0:
            store.compact()
    keys = spark.createDataFrame([(k,) for k in ("101", "104", "105", "111", "999", None)], "tweet_id string")
    rows = store.snapshot().posts(keys)
    want = {"101": "text 0", "104": "text 1", "105": "text 2", "111": "text 2"}
    assert {r["tweet_id"]: r["full_text"] for r in rows.collect()} == want and rows.count() == 4
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("max_by") < plan.rindex("LeftSemi")


def test_an_index_is_made_in_one_pass(spark, tmp_path, monkeypatch):
    calls, tokenised = [], ix._tokenised
    monkeypatch.setattr(ix, "_tokenised", lambda *a: calls.append(a) or tokenised(*a))
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    land(tmp_path / "in", "a", [record("1", i, f"{100 + i}", rawContent=f"runner{i} running runs") for i in range(5)])
    sync(store, str(tmp_path / "in"), "full", as_of=AS_OF)
    assert len(calls) == 2  # the posts, and what they were before
    store.compact()
    assert len(calls) == 3
    index = store.index()
    assert index.postings.where("term = 'run'").count() == 10 and index.docs.where("dl = 5").count() == 5
    work = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not list(Path(work).glob("index-rows-*"))


def test_landed_documents_are_dealt_out(spark, tmp_path, monkeypatch):
    """Neither half of the feed is written by one task; ids that repeat or are missing are still set aside."""
    from postarchive.plans import catalogue

    monkeypatch.setattr(catalogue, "DOCUMENTS_A_FILE", 20)
    ids = [*range(1, 121), 90, 30, None, None]
    rows = [(i, f"text of {i}", "en", "web", 9) for i in ids]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{tmp_path}/work"
    monkeypatch.setattr(catalogue, "shared_dir", lambda *a: folder)
    got = {r["tweet_id"]: r["outcome"] for r in catalogue.REGISTRY["sync_landings"](spark, str(tmp_path)).collect()}
    assert len(list(Path(folder, "older").glob("part-*"))) == 3 and len(list(Path(folder, "all").glob("part-*"))) == 16
    alone = [i for i in range(1, 121) if i % 19 and i not in (30, 90)]
    older = [i for i in alone if i >= 60][:25]
    base = 1900000000000000000
    want = {str(base + i): "added" for i in alone if i < 60} | {str(base + i): "unchanged" for i in older}
    assert got == want


def test_vocabulary_after_deltas_equals_rebuild(spark, tmp_path):
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    for n, (texts, landing) in enumerate([
        (["durable objects", "durable agents run", "a " + "x" * 40], "1"),
        (["durable objects changed", "gone", "new agentic text"], "2"),
        (["objects once more", "a " + "x" * 41], "3"),
    ]):
        folder = tmp_path / landing
        land(folder, "a", [record(landing, i, f"{100 + i + n % 2}", rawContent=t) for i, t in enumerate(texts)])
        sync(store, str(folder), "full", as_of=AS_OF)
    index, rebuilt = store.index(), ix.vocabulary(store.posts(), True)
    assert sorted(index.vocabulary.collect()) == sorted(rebuilt.collect())
    pairs = index.postings.select("term", "tweet_id").distinct().groupBy("term").count().collect()
    by_term = {r["part"]: r["term_posts"] for r in index.vocabulary.where("term_posts > 0").collect()}
    assert by_term == {r["term"]: r["count"] for r in pairs}
    store.compact()
    assert sorted(store.index().vocabulary.collect()) == sorted(rebuilt.collect())


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    land(tmp_path / "in", "a", [record("1", i, f"{100 + i}", rawContent=f"word{i} zebra qu{i}") for i in range(30)])
    sync(store, str(tmp_path / "in"), "full", as_of=AS_OF)
    index = store.index()
    terms = index.terms().where("term LIKE 'qu%'")
    plan = index.rows_of(terms)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin [bucket" in plan
    assert sorted(r["term"] for r in index.rows_of(terms).collect()) == sorted(f"qu{i}" for i in range(30))


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_cut_equals_batch_cut(spark, tmp_path, seed):
    """Any split into micro-batches, and a restart in the middle."""
    rng = random.Random(seed)
    known = [str(i) for i in range(0, 60, 2)]
    rows = [(f"f{f}", i, str(rng.randrange(20 + 20 * f))) for f in range(4) for i in range(60)]
    rows.sort(key=lambda r: (r[1], r[0]))
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    schema = "feed_id string, pos bigint, tweet_id string"
    keys = spark.createDataFrame([(k,) for k in known], "tweet_id string")
    source = f"{tmp_path}/feed"
    for part in parts[:3], parts[3:]:
        for p in part:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        taken = run_cut(stream, keys, f"{tmp_path}/taken", f"{tmp_path}/checkpoint", 4)
    want = boundary.quick_cut(spark.createDataFrame(rows, schema), keys, 4)
    got = taken.where("NOT late").select("feed_id", "pos", "tweet_id", "known")
    assert sorted(got.collect()) == sorted(want.select("feed_id", "pos", "tweet_id", "known").collect())
    stopped = {r["feed_id"] for r in taken.where("stops").collect()}
    assert stopped == {r["feed_id"] for r in want.where(F.col("stopped_reason") == boundary.AT_BOUNDARY).collect()}
    assert stopped and taken.where("late").count() == 0


def test_late_records_are_told(spark, tmp_path):
    schema = "feed_id string, pos bigint, tweet_id string"
    for rows in [[("f", 5, "a")], [("f", 3, "b"), ("f", 6, "c")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    none = spark.createDataFrame([], "tweet_id string")
    taken = run_cut(stream, none, f"{tmp_path}/taken", f"{tmp_path}/checkpoint")
    assert sorted((r["pos"], r["late"]) for r in taken.collect()) == [(3, True), (5, False), (6, False)]


def test_counters_are_those_of_the_rows(spark, tmp_path):
    """Observed while written, equal to a count over the rows."""
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    export = {"export_metadata": {"schema_version": 2}, "bookmarks": [
        {"tweet_id": "1", "full_text": "a"}, {"tweet_id": "1", "full_text": "b"}, {"tweet_id": "2", "full_text": "c"}, "oops"]}
    (tmp_path / "x.json").write_text(json.dumps(export))
    report = import_exports(store, f"{tmp_path}/x.json", AS_OF)
    row = report.summary.first()
    assert (row["added"], row["seen"], row["files"], row["errors"]) == (2, 3, 1, report.rejected.count())
    assert report.outcomes.groupBy("outcome").count().collect()[0]["count"] == row["added"]


def export(folder, name, posts, **meta):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"export_metadata": {"schema_version": 2} | meta, "bookmarks": posts}))


def test_exports_as_they_land(spark, tmp_path):
    """File by file, each content once, repeated runs and batches included; as the batch import does it."""
    from postarchive.streaming.ingest import StreamIngest

    folder, stores = tmp_path / "in", [ArchiveStore(spark, f"{tmp_path}/{n}") for n in ("stream", "batch")]
    stream = StreamIngest(stores[0], "exports", f"{tmp_path}/checkpoint", as_of=AS_OF)
    post = lambda i, text, **more: {"tweet_id": str(i), "full_text": text, "folders": ["Reading"]} | more
    export(folder, "a.json", [post(1, "one"), post(2, "two")], screen_name="me")
    stream.run_exports(str(folder))
    export(folder, "b.json", [post(2, "two again"), post(3, "three")])
    export(folder, "a-copy.json", [post(1, "one"), post(2, "two")], screen_name="me")  # nothing new
    stream.run_exports(str(folder))
    stream.run_exports(str(folder))
    assert len(stores[0].commits()) == 2
    # The batch that was the last before a crash, again.
    files = spark.createDataFrame([("elsewhere.json", (folder / "b.json").read_text())], "file_path string, value string")
    stream.process_exports(files, 1)
    stream.process_exports(files, 7)
    assert len(stores[0].commits()) == 2
    for name in ("a.json", "b.json"):
        import_exports(stores[1], str(folder / name), AS_OF)
    drop = ["raw_json"]
    one, two = (sorted(map(str, s.posts().drop(*drop).collect())) for s in stores)
    assert one == two and len(one) == 3
    assert sorted(stores[0].memberships().collect()) == sorted(stores[1].memberships().collect())


def test_status_is_kept_up_to_date(spark, tmp_path):
    """Tallies after merges equal a scan, also when the newest post changes; no posts are read."""
    from postarchive.operators import rollups

    rng = random.Random(1)
    store = ArchiveStore(spark, f"{tmp_path}/archive")
    for n in range(3):
        rows = [record(str(n), i, f"{100 + rng.randrange(12)}", date=f"2025-{rng.randrange(1, 12):02d}-03T00:00:00+00:00",
                       user={"username": rng.choice("abc"), "displayname": "x"}) for i in range(8)]
        if n == 2:  # what was newest is no longer
            newest = max(store.posts().collect(), key=lambda p: (p["created_at"], p["tweet_id"]))
            rows.append(record("2", 99, newest["tweet_id"], date="2024-01-01T00:00:00+00:00"))
        land(tmp_path / str(n), "a", rows)
        sync(store, str(tmp_path / str(n)), "full", as_of=AS_OF)
        archive = store.archive()
        want = rollups.archive_status(archive.posts, archive.folders, archive.runs)
        assert sorted(map(str, archive.status().collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the plan shows whole paths
    plan = store.archive().status()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "/tallies" in plan and "/posts" not in plan
    store.compact()
    assert sorted(map(str, store.archive().status().collect())) == sorted(map(str, want.collect()))


def test_any_order_gives_one_state(spark, tmp_path):
    """Merged by observed time: landings in any order, in parts and repeated."""
    from postarchive.operators import registers

    rng = random.Random(2)
    states = []
    for n in range(3):
        rows = [record(f"l{n}", i, f"{100 + i % 5}", rawContent=rng.choice(["", f"text {n} {i}"]), likeCount=rng.choice([None, n]),
                       observed_at=f"2025-12-{rng.randrange(1, 9):02d}T00:00:00Z", hashtags=rng.choice([[], [f"t{n}"]]))
                for i in range(9)]
        land(tmp_path / str(n), "a", rows)
        seen = feeds.normalise_feed(feeds.read_feed(spark, str(tmp_path / str(n))), AS_OF)
        states.append(spark.createDataFrame(registers.registers(seen, AS_OF).collect(), registers.REGISTERS))
    results = []
    for order in ([0, 1, 2], [2, 0, 1, 0], [1, 2, 0]):
        state = spark.createDataFrame([], registers.REGISTERS)
        for n in order:
            state = registers.merged(state.unionByName(states[n]))
        results.append(sorted(map(str, registers.post_rows(state).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 5
