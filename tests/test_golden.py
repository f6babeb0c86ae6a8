from datetime import datetime, timezone

import pytest

import golden as G
from postarchive.operators.merge import apply_merge
from postarchive.plans.ingest import import_exports
from postarchive.sources.store import ArchiveStore, write_json

AS_OF = datetime(2026, 5, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("golden"))
    store = ArchiveStore(spark, f"{folder}/archive")
    reports = [import_exports(store, G.write(folder, m, G.export(m)), AS_OF) for m in G.MONTHS]
    return store, [r.summary.first().asDict() for r in reports]


def iso(value):
    return value.strftime("%Y-%m-%d") if value else None


def number(tweet_id):
    return int(tweet_id[-2:])


def test_run_summaries(imported):
    shown = [tuple(s[k] for k in ("added", "updated", "unchanged", "folders", "errors")) for s in imported[1]]
    assert shown == [(3, 0, 0, 3, 0), (2, 1, 0, 2, 0), (1, 2, 0, 3, 0), (0, 1, 0, 0, 0)]


def check_state(archive):
    posts = {number(r["tweet_id"]): r for r in archive.posts.collect()}
    state = {
        n: (r["status"], r["unavailable_reason"], iso(r["first_seen_at"]), iso(r["last_seen_at"]))
        for n, r in posts.items()
    }
    assert state == {
        11: ("available", None, "2025-12-24", "2026-03-31"),
        12: ("available", None, "2026-01-31", "2026-04-30"),
        13: ("unavailable", "account gone", "2026-01-31", "2026-03-31"),
        14: ("available", None, "2026-02-28", "2026-02-28"),
        15: ("available", None, "2026-02-28", "2026-02-28"),
        16: ("available", None, "2026-03-31", "2026-03-31"),
    }
    assert {n: r["full_text"] for n, r in posts.items()} == {n: p[1] for n, p in G.POSTS.items()}
    assert posts[11]["entities"]["mentions"][0]["screen_name"] == "seedbank"
    assert posts[11]["links"] == ["https://bare.example/soil", "https://long.example/s"]
    assert [posts[n]["likes"] for n in sorted(posts)] == [31, 640, 77, None, 5, 0]
    assert posts[13]["media"][0]["url"] == "https://img.example/fjord.jpg"
    assert posts[13]["quoted_full_text"] == "Sleeper timetable"
    assert iso(posts[15]["created_at"]) == "2026-02-11"


def test_final_state(imported):
    check_state(imported[0].archive())


def test_folders(imported):
    archive = imported[0].archive()
    # March is complete: it takes post 13 out of its folder and leaves those it does not name alone.
    assert sorted((r["name"], r["bookmarks"]) for r in archive.list_folders().collect()) == [
        ("Garden", 2), ("Kitchen", 3), ("Travel", 1),
    ]
    got = sorted((number(r["tweet_id"]), r["folder_id"]) for r in archive.memberships.collect())
    assert got == [(11, "k-1"), (11, "k-2"), (12, "k-2"), (14, "k-1"), (15, "k-2"), (16, "k-3")]


def test_status(imported):
    rows = {(r["section"], r["key"]): r["value"] for r in imported[0].archive().status().collect()}
    want = {("counts", "total"): "6", ("counts", "available"): "5", ("counts", "unavailable"): "1",
            ("counts", "folders"): "3", ("by_month", "2026-01"): "3", ("by_origin", "export"): "6",
            ("newest", "newest"): "2026-03-02T12:00:00+00:00", ("state", "account_screen_name"): "keeper"}
    assert {k: rows.get(k) for k in want} == want
    assert sum(section == "top_authors" for section, _ in rows) == 5


def test_reads(imported, spark):
    archive = imported[0].archive()
    recent = [number(r["tweet_id"]) for r in archive.recent(as_of=AS_OF).collect()]
    assert recent == [16, 14, 15, 13, 12, 11]  # without a created time, by the first sight
    assert [number(r["tweet_id"]) for r in archive.recent(days=61, as_of=AS_OF).collect()] == [16]
    assert {r["author_handle"]: r["bookmarks"] for r in archive.top_authors(min_posts=2).collect()} == {"orla": 2}
    asked = [f"https://x.com/idris/status/{G.ID(15)}#top", G.ID(99), "nothing here", f"  {G.ID(11)} "]
    found = archive.get(spark.createDataFrame([(a,) for a in asked], "ref string")).collect()
    got = {r["ref"]: (r["found"], r["author_handle"], r["folders"]) for r in found}
    assert got[asked[0]] == (True, "idris", ["Kitchen"])
    assert got[asked[1]][0] is False and got[asked[2]][0] is False


def test_search(imported):
    archive = imported[0].archive()

    def ids(query, **options):
        return sorted(number(r["tweet_id"]) for r in archive.search_one(query, **options).collect())

    assert ids("sourdough starter") == [12, 15]
    assert ids("sourdough", author="@tomas") == [12] and ids("sourdough", author="mei") == []
    assert ids("feed") == ids("feeding") == [12]  # stems
    assert ids("compost") == [14]
    assert ids("warm-nig") == [11]  # a phrase with a cut last word
    assert ids("timetable") == [13]  # in the quote
    assert ids("worms fjords") == [13, 14]  # no post has both
    assert ids("tomatoes", folder="travel") == [16]
    assert ids("worms", since="2026-01-01") == []  # no created time
    assert ids("crackers", until="2026-02-11") == []
    assert ids("crackers", since="2026-02-11", until="2026-02-12") == [15]
    with pytest.raises(ValueError):
        archive.search_one("?!")
    first = archive.search_one("fjords").first()
    assert first["folders"] == [] and first["match_mode"] == "all"


def test_sql(imported):
    archive = imported[0].archive()
    rows = archive.sql("SELECT count(*) AS n FROM bookmarks WHERE status = 'unavailable';").collect()
    assert rows[0]["n"] == 1
    joined = "SELECT f.name FROM bookmark_folders b JOIN folders f ON f.id = b.folder_id"
    assert len(archive.sql(joined, limit=4).collect()) == 4
    assert archive.sql("SELECT value FROM meta WHERE key = 'account_user_id'").first()[0] == "42"


def test_health(imported):
    archive = imported[0].archive()
    state = {r["check"]: r["state"] for r in archive.health().collect()}
    assert state["search index"] == "pass" and state["freshness"] == "warn"
    assert archive.integrity().first()["in_sync"]


def test_replay_changes_nothing(imported, folder):
    store, _ = imported
    report = import_exports(store, G.write(folder, "april", G.export("april")), AS_OF)
    assert report.summary.first()["unchanged"] == 1
    check_state(store.archive())


def test_compaction_keeps_everything(imported):
    store, _ = imported
    before = sorted(map(str, store.posts().collect()))
    postings = store.index().postings.count()
    assert store.reindex() == 6
    assert store.snapshot().deltas == []
    assert sorted(map(str, store.posts().collect())) == before
    assert store.index().postings.count() == postings
    archive = store.archive()
    check_state(archive)
    assert [number(r["tweet_id"]) for r in archive.search_one("fjords").collect()] == [13]
    assert archive.list_folders().count() == 3


def test_bad_files_are_quarantined(spark, folder):
    good = G.export("january")
    contents = {
        "a": good,
        "b": "{ broken",
        "c": "[1, 2]",
        "d": '{"bookmarks": {"a": 1}}',
        "e": G.export("february", export_metadata={"schema_version": 3}),
        "f": {"bookmarks": ["text", 5, {"tweet_id": ""}, {"tweet_id": "123456", "author": "not an object"},
                            {"tweet_id": "777777", "folders": ["Reading"]}]},
        "g": "\r\n\t" + G.json.dumps({"bookmarks": [{"tweet_id": "888888"}]}),
        "h": G.json.dumps(G.export("march"))[:-40],
        "i": {"export_metadata": {"schema_version": "three"}, "bookmarks": []},
        "j": {"export_metadata": {"schema_version": "9"}, "bookmarks": [{"tweet_id": "999999"}]},
    }
    for name, content in contents.items():
        G.write(folder, name, content)
    store = ArchiveStore(spark, f"{folder}/archive")
    report = import_exports(store, f"{folder}/*.json", AS_OF)
    reasons = sorted(
        (r["file_path"][-6], r["reason"]) for r in report.rejected.select("file_path", "reason").collect()
    )
    assert reasons == [
        ("b", "invalid JSON"), ("c", "not a JSON object"), ("d", "no bookmarks array"),
        ("e", "unsupported schema version"), ("f", "malformed post"), ("f", "malformed post"),
        ("f", "malformed post"), ("f", "missing tweet_id"), ("h", "invalid JSON"),
    ]
    assert report.summary.first()["added"] == 6
    posts = {r["tweet_id"]: r for r in store.posts().collect()}
    assert {"777777", "888888", "999999"} <= set(posts)
    assert posts["777777"]["status"] == "unavailable"
    assert posts["777777"]["url"] == "https://x.com/i/status/777777"
    assert ("legacy:Reading", "Reading") in [tuple(r) for r in store.folders().collect()]
    files = {r["file_path"][-6]: r for r in report.files.collect()}
    assert sorted(files) == ["a", "f", "g", "i", "j"]
    assert (files["a"]["account"], files["a"]["kind"], files["a"]["posts"], files["a"]["folders"], files["a"]["errors"]) == ("keeper", "bookmarks", 3, 3, 0)
    assert (files["f"]["posts"], files["f"]["errors"]) == (1, 4)


def test_json_sink(imported, spark, folder):
    posts = imported[0].posts()
    write_json(posts, f"{folder}/out")
    back = spark.read.json(f"{folder}/out")
    assert back.count() == 6 and "unavailable_reason" in back.columns


def test_apply_merge_keeps_untouched(imported):
    posts = imported[0].posts()
    assert apply_merge(posts, posts.where("tweet_id like '%1'")).count() == 6
