import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.operators import filters, lookup, projections, rollups
from postarchive.operators import guard
from postarchive.operators.guard import read_only
from postarchive.plans.ingest import sync
from postarchive.sources import feed as feeds
from postarchive.sources.store import ArchiveStore
from postarchive.streaming.ingest import StreamIngest, batch_counters

AS_OF = datetime(2026, 1, 1, tzinfo=timezone.utc)


def record(pos, key, **more):
    return {"feed_id": "main", "pos": pos, "observed_at": "2025-12-31T10:00:00Z", "id_str": key,
            "rawContent": f"text of {key}", "user": {"username": "jo", "displayname": "Jo"}} | more


def land(folder, name, records):
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-09-15", "2026-09-15T00:00:00"), ("20260915", "2026-09-15T00:00:00"),
        ("2026-09-15T10:00:00.000Z", "2026-09-15T10:00:00"),
        ("2026-09-15 10:00:00+0530", "2026-09-15T04:30:00"), ("2026-09-15T10:00", "2026-09-15T10:00:00"),
        ("2026-09-15T10+02:00", "2026-09-15T08:00:00"), ("1726650000", "2024-09-18T09:00:00"),
        ("Wed Jan 06 18:40:40 +0000 2021", "2021-01-06T18:40:40"), ("10:00", None), ("soon", None),
        ("2026-02-30", None), ("", None), (None, None),
    ],
)
def test_instant(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.date_format(X.instant(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss").alias("v")
    ).first()
    assert row["v"] == expected


def test_feed_normalisation(spark, folder):
    variants = [{"url": "low", "bitrate": 1}, {"url": "high", "bitrate": 9}, {"url": "same", "bitrate": 9},
                {"bitrate": 99}]
    land(folder, "a", [
        record(0, "123456", conversationIdStr="", conversationId=5, likeCount="12.5", viewCount=7,
               date="2025-01-02T03:04:05+00:00", hashtags=["x"], cashtags=["y"],
               mentionedUsers=[{"username": "m", "id": 4}],
               links=[{"tcourl": "t"}, {"url": "u", "tcourl": "t"}, {}],
               article={"title": "T", "preview_text": "P"},
               media={"photos": [{"url": "p"}, {}],
                      "videos": [{"thumbnailUrl": "tv", "duration": 5, "variants": variants}, {"thumbnailUrl": "t2"}],
                      "animated": [{"videoUrl": "g", "thumbnailUrl": "tg"}]}),
        record(1, None, id=77), record(2, None), "{ broken", record(3, "88", user=None, rawContent=""),
    ])
    good, bad = feeds.split_valid(feeds.read_feed(spark, folder))
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed record", "missing id"]
    assert {r["pos"] for r in bad.where("reason = 'missing id'").collect()} == {2}
    rows = {r["tweet_id"]: r for r in feeds.normalise_feed(good, AS_OF).collect()}
    assert sorted(rows) == ["123456", "77", "88"]
    r = rows["123456"]
    assert [(m["type"], m["url"]) for m in r["media"]] == [
        ("photo", "p"), ("video", "high"), ("video", "t2"), ("gif", "g"),
    ]
    assert r["links"] == ["t", "u"] and r["conversation_id"] == "5"
    assert r["likes"] is None and r["views"] == 7
    assert r["entities"]["cashtags"] == ["y"] and r["entities"]["mentions"][0]["user_id"] == "4"
    assert r["article_summary"] == "P" and r["url"] == "https://x.com/jo/status/123456"
    assert rows["88"]["url"] == "https://x.com/i/status/88" and rows["88"]["full_text"] is None
    assert rows["77"]["entities"] is None and rows["77"]["hashtags"] is None
    # A record without a position is kept for the quarantine.
    assert feeds.read_feed(spark, folder, 2).count() == 3
    assert feeds.read_feed(spark, folder, 0).count() == 5


def test_sync_modes(spark, folder, tmp_path_factory):
    store = ArchiveStore(spark, f"{tmp_path_factory.mktemp('s')}/archive")
    land(folder, "1", [record(i, f"{1000 + i}") for i in range(20, 40)])
    first = sync(store, folder, "full", as_of=AS_OF).summary.first()
    assert (first["added"], first["stopped_reason"]) == (20, "pagination ended")
    second = tmp_path_factory.mktemp("f2")
    land(second, "2", [record(i, f"{1000 + i}") for i in range(15, 40)])
    quick = sync(store, str(second), "quick", stop_after=6, as_of=AS_OF)
    row = quick.summary.first()
    assert (row["seen"], row["added"], row["unchanged"]) == (11, 5, 6)
    assert row["stopped_reason"] == "reached known boundary"
    assert store.posts().count() == 25
    state = {r["key"]: r["value"] for r in rollups.latest_values(store.runs()).collect()}
    assert state["last_sync_mode"] == "quick" and "added=5" in state["last_sync_summary"]
    assert state["last_full_sync_at"] == AS_OF.isoformat()
    with pytest.raises(ValueError):
        sync(store, folder, "other")


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path_factory):
    landing, root = tmp_path_factory.mktemp("land"), tmp_path_factory.mktemp("store")
    store = ArchiveStore(spark, f"{root}/archive")
    stream = StreamIngest(store, "feed", f"{root}/checkpoint", as_of=AS_OF)
    batches = [
        [record(i, f"{100000 + i % 7}", likeCount=i, rawContent="" if i % 3 else f"text {i} b{b}",
                observed_at=f"2025-12-{10 + (i * 7 + b) % 20}T00:00:00Z") for i in range(12)]
        for b in range(3)
    ]
    for b, records in enumerate(batches):
        land(landing, f"b{b}", records)
        stream.run_feed(str(landing))
    stream.run_feed(str(landing))  # nothing new
    assert len(store.snapshot().deltas) == 3

    once = ArchiveStore(spark, f"{root}/once")
    flat = tmp_path_factory.mktemp("flat")
    land(flat, "all", [dict(r, pos=b * 100 + r["pos"]) for b, rs in enumerate(batches) for r in rs])
    good, _ = feeds.split_valid(feeds.read_feed(spark, str(flat)))
    StreamIngest(once, "x", f"{root}/unused", as_of=AS_OF).process(feeds.normalise_feed(good, AS_OF), 0)
    drop = ["raw_json"]
    assert sorted(map(str, store.posts().drop(*drop).collect())) == sorted(
        map(str, once.posts().drop(*drop).collect())
    )
    assert sorted(store.index().postings.collect()) == sorted(once.index().postings.collect())

    before = store.begin().version
    stream.process(feeds.normalise_feed(good, AS_OF), 0)  # batch 0 again
    assert store.begin().version == before
    lines = [r["value"] for r in batch_counters(store).collect()]
    assert len(lines) == 3 and any("batch=0 seen=12 added=7" in line for line in lines)


def test_later_landing_wins(spark, tmp_path_factory):
    """A post at a high position in January and a low one in February ends as in February."""
    folder, root = tmp_path_factory.mktemp("two"), tmp_path_factory.mktemp("store")
    land(folder, "jan", [record(i, f"{500000 + i}", rawContent=f"january {i}", landing="2026-01") for i in range(4)])
    land(folder, "feb", [record(1, "500003", rawContent="february", landing="2026-02"),
                         record(3, "500001", rawContent="february too", landing="2026-02")])
    stores = [ArchiveStore(spark, f"{root}/{name}") for name in ("sync", "stream")]
    report = sync(stores[0], str(folder), "full", as_of=AS_OF)
    assert report.summary.first()["seen"] == 6  # positions that two landings share are not multiplied
    StreamIngest(stores[1], "feed", f"{root}/checkpoint", as_of=AS_OF).run_feed(str(folder))
    for store in stores:
        texts = {r["tweet_id"]: r["full_text"] for r in store.posts().collect()}
        assert texts == {"500000": "january 0", "500001": "february too", "500002": "january 2", "500003": "february"}


def test_records_without_a_place_are_kept_apart(spark, tmp_path_factory):
    folder, root = tmp_path_factory.mktemp("bad"), tmp_path_factory.mktemp("store")
    rows = [record(0, "600000"), record(1, "600001"), record(1, "600002"), record(2, None, id=None), "{ broken"]
    no_pos, no_feed = record(9, "600003"), record(9, "600004")
    del no_pos["pos"], no_feed["feed_id"]
    land(folder, "a", [*rows, no_pos, no_feed])
    reasons = ["malformed record", "missing feed_id", "missing id", "missing position", "repeated position", "repeated position"]
    batch, stream = ArchiveStore(spark, f"{root}/batch"), ArchiveStore(spark, f"{root}/stream")
    report = sync(batch, str(folder), "quick", as_of=AS_OF)
    assert sorted(r["reason"] for r in report.rejected.collect()) == reasons
    StreamIngest(stream, "feed", f"{root}/checkpoint", as_of=AS_OF).run_feed(str(folder))
    for store in (batch, stream):
        assert [r["tweet_id"] for r in store.posts().collect()] == ["600000"]
        assert sorted(r["reason"] for r in store.rejected(feeds.REJECTED).collect()) == reasons


def test_unfinished_version_is_invisible_and_replaced(spark, tmp_path_factory):
    store = ArchiveStore(spark, f"{tmp_path_factory.mktemp('u')}/archive")
    posts = spark.createDataFrame([("1",)], "tweet_id string").select(
        *[F.col(c) if c == "tweet_id" else F.lit(None).cast(k).alias(c) for c, k in S.POST_TYPES.items()]
    )
    store.write("posts", store.begin(), posts)
    assert store.posts().count() == 0 and store.begin().version == 0
    run = store.begin()
    store.write("posts", run, posts.unionByName(posts.withColumn("tweet_id", F.lit("2"))))
    store.commit(run, "delta")
    assert store.posts().count() == 2


def test_filters(spark):
    rows = spark.createDataFrame(
        [("1", "jo", "2026-09-15 00:00:00"), ("2", "Jo", "2026-09-14 23:59:59"), ("3", "@odd", None)],
        "tweet_id string, author_handle string, created string",
    ).withColumn("created_at", F.col("created").cast("timestamp"))

    def ids(condition):
        return sorted(r["tweet_id"] for r in rows.where(condition).collect())

    assert ids(filters.by_author("@jo")) == ["1"] and ids(filters.by_author("@odd")) == ["3"]
    assert ids(filters.created_between(until="2026-09-15")) == ["2"]
    assert ids(filters.created_between(until="2026-09-15T00:00:00Z")) == ["1", "2"]
    assert ids(filters.created_between(since="2026-09-15")) == ["1"]
    assert ids(filters.created_between()) == ["1", "2", "3"]
    now = datetime(2026, 9, 16, 12, tzinfo=timezone.utc)
    assert ids(filters.last_days(1, now)) == ["1"] and ids(filters.last_days(2, now)) == ["1", "2"]
    assert [filters.at_least_one(n) for n in (1, 7, 500)] == [1, 7, 500]
    for n in (0, -1):
        with pytest.raises(ValueError):
            filters.at_least_one(n)


def test_folder_filter_multiplicity(spark):
    posts = spark.createDataFrame([("1",), ("2",)], "tweet_id string")
    members = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "gone")], S.MEMBERSHIPS)
    folders = spark.createDataFrame([("a", "Dev Tools"), ("b", "tools")], S.FOLDERS)
    args = (posts, members, folders)
    assert filters.in_folder(*args, "TOOL").count() == 1
    assert filters.in_folder(*args, "TOOL", "bag").count() == 2
    assert filters.in_folder(*args, "d_v%").count() == 1
    assert filters.in_folder(*args, "b").count() == 1
    assert filters.in_folder(*args, "gone").count() == 0


def test_hot_reference(spark):
    posts = spark.createDataFrame([(str(900000 + i),) for i in range(20)], "tweet_id string")
    refs = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "https://x.com/u/status/900007").when(F.col("id") % 3 == 1, "none")
        .otherwise(F.concat(F.lit("id "), (F.col("id") + 899000).cast("string"))).alias("ref")
    )
    asked = lookup.requested(refs)
    found = lookup.resolve(refs, lookup.pick(posts, asked))
    assert found.count() == 5000
    assert found.where("found").count() == sum(i % 3 == 0 for i in range(5000)) + sum(
        1 for i in range(5000) if i % 3 == 2 and 900000 <= i + 899000 < 900020
    )
    assert found.where("ref_id IS NULL").count() == sum(i % 3 == 1 for i in range(5000))


@pytest.mark.parametrize("sql", [
    "select 1", "  WITH a AS (SELECT 1 AS x) SELECT x FROM a; ", "explain select 1",
    "select replace(name, 'a', 'b') from folders", "select '; drop table x' as s", "describe folders",
    "select 1 -- insert into x",
])
def test_guard_allows(sql):
    assert read_only(sql)


@pytest.mark.parametrize("sql", [
    "", ";", "insert into x values (1)", "drop table x", "with a as (select 1) insert into x select * from a",
    "select 1; drop table x", "explain insert into x select 1", "create table x as select 1",
    "with a as (select 1) -- '\n insert into x select '", "set spark.x=1", "from x insert into y select 1",
    "/* select */ delete from x",
])
def test_guard_rejects(sql):
    with pytest.raises(ValueError):
        read_only(sql)


@pytest.fixture
def views(spark):
    return {
        "bookmarks": spark.createDataFrame([("1", 2)], "tweet_id string, x int"),
        "folders": spark.createDataFrame([("f", "F")], "id string, name string"),
        "bookmark_folders": spark.createDataFrame([("1", "f")], "tweet_id string, folder_id string"),
        "meta": spark.createDataFrame([("k", "v")], "key string, value string"),
    }


@pytest.mark.parametrize(("sql", "rows"), [
    ("select 1", 1), ("with a as (select 1 as x) select a.x from a join bookmarks on true", 1),
    ("select name from folders where id in (select folder_id from bookmark_folders)", 1), ("describe folders", None),
    ("select sum(id) from range(4)", 1), ("values (1), (2)", None), ("explain select * from meta", None),
    ("show columns in folders", 2), ("select (select max(x) from bookmarks) as m, f.* from Folders f", 1),
    ("describe query select * from meta", 2), ("select upper(name), count(*) over () from folders", 1),
    ("select * from bookmarks lateral view explode(array(1, 2)) as y", 2), ("select 'text.`/etc/hostname`'", 1),
])
def test_query_guard_allows(spark, views, sql, rows):
    if sql.startswith("values"):
        with pytest.raises(ValueError):
            guard.query(spark, sql, views)
        return
    found = guard.query(spark, sql, views).collect()
    assert rows is None or len(found) == rows


COLUMNS = ", ".join(f"{i} as c{i}" for i in range(40))


@pytest.mark.parametrize("sql", [
    "select * from text.`/etc/hostname`", "select reflect('java.lang.System', 'currentTimeMillis')",
    "select * from bookmarks where JAVA_METHOD('a.B', 'c') = 1", "select * from elsewhere",
    "select (select max(x) from other.t) from meta", "describe elsewhere",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "select * from identifier('elsewhere')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis')",
    f"select {COLUMNS}, reflect('java.lang.System', 'currentTimeMillis')",
    "select try_reflect('java.lang.System', 'currentTimeMillis')", "select own_python(1)", "select * from theirs",
    "select transform(x) using 'cat' from bookmarks", "with t as (select * from theirs) select * from t",
    "select * from bookmarks where exists (select 1 from theirs)", "explain select * from theirs",
    "explain extended select reflect('java.lang.System', 'currentTimeMillis')",
    "describe query select reflect('java.lang.System', 'currentTimeMillis') as x",
    "select * from folders union all select * from json.`/tmp`", "select * from bookmarks, lateral (select * from theirs)",
    "describe text.`/etc/hostname`", "show columns in theirs", "select nonsense from folders",
])
def test_query_guard_rejects(spark, views, sql):
    spark.range(3).createOrReplaceTempView("theirs")
    spark.udf.register("own_python", lambda x: x)
    with pytest.raises(ValueError):
        guard.query(spark, sql, views)


def test_query_leaves_the_callers_views(spark, views):
    spark.range(7).createOrReplaceTempView("folders")
    assert guard.query(spark, "select * from folders", views).count() == 1
    assert spark.table("folders").count() == 7
    spark.catalog.dropTempView("folders")


def test_json_columns_and_back(spark):
    post = spark.createDataFrame([("1", ["a", "b"])], "tweet_id string, links array<string>").select(
        *[F.col(c) if c in ("tweet_id", "links") else F.lit(None).cast(k).alias(c) for c, k in S.POST_TYPES.items()]
    ).withColumn("created_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    row = projections.json_columns(post)
    got = row.first()
    assert got["links_json"] == '["a","b"]' and got["media_json"] is None
    assert got["created_at"] == "2026-01-02T03:04:05+00:00"
    back = projections.parse_json_lists(row).first()
    assert back["links"] == ["a", "b"] and back["media"] == []
    broken = row.withColumns({"links_json": F.lit("{"), "media_json": F.lit("[{")})
    assert projections.parse_json_lists(broken).first()["links"] == []


def test_rendering(spark):
    row = spark.createDataFrame(
        [("1", "jo", None, " hi ", "unavailable", 3, "quote", ["A", "B"], "u")],
        "tweet_id string, author_handle string, author_name string, full_text string, status string,"
        "likes bigint, quoted_full_text string, folders array<string>, url string",
    ).select("*", *[F.lit(None).cast(k).alias(c) for c, k in S.POST_TYPES.items()
                    if c in ("created_at", "quoted_author_handle", "retweets", "replies", "views")])
    assert projections.rendered(row).first()["text"] == (
        "  @jo ()  [unavailable]\n  hi\n  quoted @?: quote\n  likes=3\n  folders: A, B\n  u"
    )
