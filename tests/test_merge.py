"""The fold against a plain sequential loop, and its laws."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.operators import membership, merge

AS_OF = datetime(2026, 1, 1, tzinfo=timezone.utc)
T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
USED = [
    "tweet_id", "url", "full_text", "created_at", "author_handle", "likes", "hashtags",
    "status", "unavailable_reason", "origin", "first_seen_at", "last_seen_at",
    "content_updated_at",
]
TEXTS = ["url", "full_text", "author_handle"]


def random_observations(n, keys, seed):
    rng = random.Random(seed)

    def moment(p):
        return T0 + timedelta(seconds=rng.randrange(10**6)) if rng.random() < p else None

    rows = []
    for seq in range(n):
        key = str(rng.randrange(keys))
        rows.append(
            {
                "tweet_id": key, "seq": seq,
                "url": rng.choice([None, "", f"https://x.com/i/status/{key}", f"https://x.com/a{seq}/status/{key}"]),
                "full_text": rng.choice([None, "", f"text {seq}"]),
                "created_at": moment(0.3),
                "author_handle": rng.choice([None, "", f"h{seq % 5}"]),
                "likes": rng.choice([None, 0, seq]),
                "hashtags": rng.choice([None, [], [f"t{seq}"]]),
                "status": rng.choice([None, "", "available", "unavailable"]),
                "unavailable_reason": rng.choice([None, "", f"r{seq}"]),
                "origin": rng.choice([None, "live", "export", "export+live"]),
                "first_seen_at": moment(0.4), "last_seen_at": moment(0.6),
                "content_updated_at": moment(0.1),
            }
        )
    return rows


def frame(spark, rows):
    kinds = {**S.POST_TYPES, "seq": "bigint"}
    part = spark.createDataFrame(
        [tuple(r.get(c) for c in [*USED, "seq"]) for r in rows],
        ", ".join(f"{c} {kinds[c]}" for c in [*USED, "seq"]),
    )
    return part.select(
        *[F.col(c) if c in part.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    )


def later(a, b):
    return max([x for x in (a, b) if x], default=None)


def earlier(a, b):
    return min([x for x in (a, b) if x], default=None)


def one_by_one(rows):
    """The same rules, one observation after the other."""
    state = {}
    for r in rows:
        seen = r["last_seen_at"] or AS_OF
        origins = set(r["origin"].split("+")) if r["origin"] else set()
        p = state.get(r["tweet_id"])
        if p is None:
            p = {c: None for c in USED} | {"tweet_id": r["tweet_id"], "status": "available", "origins": set()}
            origins = origins or {"unknown"}
            p["first_seen_at"] = r["first_seen_at"] or seen
            state[r["tweet_id"]] = p
        for c in [*TEXTS, "created_at", "likes", "hashtags"]:
            value = r[c]
            if value is None or value == "" or value == []:
                continue
            if c == "url" and "/i/status/" in value and p["url"] and "/i/status/" not in p["url"]:
                continue
            p[c] = value
        if r["status"]:
            p["status"] = r["status"]
        if r["status"] == "unavailable" and r["unavailable_reason"]:
            p["unavailable_reason"] = r["unavailable_reason"]
        if r["status"] == "available":
            p["unavailable_reason"] = None
        p["origins"] |= origins
        p["first_seen_at"] = earlier(p["first_seen_at"], r["first_seen_at"])
        p["last_seen_at"] = later(p["last_seen_at"], seen)
        p["content_updated_at"] = later(p["content_updated_at"], r["content_updated_at"])
        if p["content_updated_at"] is None and p["full_text"]:
            p["content_updated_at"] = seen
    for p in state.values():
        p["origin"] = "+".join(sorted(p.pop("origins")))
    return state


def comparable(rows):
    out = {}
    for r in rows:
        d = {c: r[c] for c in USED}
        for c, v in d.items():
            if isinstance(v, datetime):
                d[c] = v.replace(tzinfo=None) if v.tzinfo is None else v.astimezone(timezone.utc).replace(tzinfo=None)
        out[d["tweet_id"]] = d
    return out


@pytest.fixture(scope="module")
def no_posts(spark):
    return spark.createDataFrame([], S.POSTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_loop(spark, seed):
    rows = random_observations(4000, 300, seed)
    got = comparable(merge.fold(frame(spark, rows), AS_OF).collect())
    assert got == comparable(one_by_one(rows).values())


def test_two_merges_equal_one(spark, no_posts):
    rows = random_observations(2000, 200, 3)
    first = merge.merge_observations(no_posts, frame(spark, rows[:900]), AS_OF)
    archive = merge.apply_merge(no_posts, first)
    second = merge.merge_observations(archive, frame(spark, rows[900:]), AS_OF)
    both = comparable(merge.apply_merge(archive, second).collect())
    assert both == comparable(one_by_one(rows).values())


def test_replay_changes_nothing_and_nothing_is_lost(spark, no_posts):
    rows = random_observations(1500, 150, 4)
    observed = frame(spark, rows)
    archive = merge.apply_merge(no_posts, merge.merge_observations(no_posts, observed, AS_OF))
    final = [r for r in rows[-400:]]
    again = merge.merge_observations(archive, frame(spark, final), AS_OF)
    kept = merge.apply_merge(archive, again)
    for c in ["full_text", "likes", "hashtags", "author_handle", "url"]:
        lost = archive.alias("a").join(kept.alias("b"), "tweet_id").where(
            f"a.{c} IS NOT NULL AND b.{c} IS NULL"
        )
        assert lost.count() == 0
    # The last observation of every post, seen again, changes nothing.
    last = list({r["tweet_id"]: r for r in rows}.values())
    quiet = merge.merge_observations(archive, frame(spark, last), AS_OF)
    assert {r["content_changed"] for r in quiet.collect()} <= {False, True}
    replay = merge.merge_observations(
        archive, archive.withColumn("seq", F.lit(0).cast("bigint")), AS_OF
    )
    assert [r["outcome"] for r in merge.outcome_counts(replay).collect()] == ["unchanged"]


def test_rules(spark, no_posts):
    def merged(*rows):
        full = [{c: None for c in USED} | {"tweet_id": "1", "seq": i} | r for i, r in enumerate(rows)]
        return merge.fold(frame(spark, full), AS_OF).first()

    row = merged(
        {"status": "available", "full_text": "kept", "likes": 5, "origin": "live"},
        {"status": "unavailable", "unavailable_reason": "gone", "full_text": "", "likes": 0, "origin": "export"},
    )
    assert (row["full_text"], row["likes"], row["status"], row["unavailable_reason"]) == (
        "kept", 0, "unavailable", "gone",
    )
    assert row["origin"] == "export+live" and row["n_observations"] == 2
    assert merged({"status": "unavailable", "unavailable_reason": "gone"}, {"status": "available"})[
        "unavailable_reason"
    ] is None
    assert merged({"unavailable_reason": "stray"})["unavailable_reason"] is None
    assert merged({})["origin"] == "unknown"
    assert merged({"origin": "live"}, {})["origin"] == "live"


def test_hot_key_is_preaggregated(spark):
    """Rows of one key leave a map task as one row."""
    plan = merge.fold(frame(spark, random_observations(10, 2, 5)), AS_OF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("partial_max_by") > 0 and text.count("Exchange hashpartitioning(tweet_id") == 1


def test_membership_fold_equals_loop(spark):
    rng = random.Random(6)
    prior = sorted({(str(rng.randrange(60)), f"f{rng.randrange(8)}") for _ in range(150)})
    observed = [
        (str(rng.randrange(80)), seq, rng.random() < 0.2,
         [f"f{rng.randrange(8)}" for _ in range(rng.randrange(4))])
        for seq in range(1500)
    ]
    state = {}
    for post, folder in prior:
        state.setdefault(post, set()).add(folder)
    for post, _, complete, folders in observed:
        state[post] = set(folders) if complete else state.get(post, set()) | set(folders)
    expected = sorted((p, f) for p, fs in state.items() for f in fs)
    got = membership.fold_memberships(
        spark.createDataFrame(prior, S.MEMBERSHIPS),
        spark.createDataFrame(observed, S.MEMBERSHIP_OBSERVATIONS),
    )
    assert sorted(map(tuple, got.collect())) == expected
