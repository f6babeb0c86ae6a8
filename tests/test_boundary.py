import random

import pytest

from postarchive.operators import boundary


def loop(feed, archived, stop_after):
    """Newest first; stop at the post that completes a run of known posts."""
    taken, known, streak = [], set(archived), 0
    for pos, key in feed:
        was_known = key in known
        known.add(key)
        taken.append((pos, key, was_known))
        streak = streak + 1 if was_known else 0
        if streak >= stop_after:
            return taken, boundary.AT_BOUNDARY
    return taken, boundary.EXHAUSTED


@pytest.mark.parametrize("block", [4, 16, 65536])
@pytest.mark.parametrize("p_new", [0.1, 0.4])
def test_quick_cut_equals_loop(spark, block, p_new):
    rng = random.Random(block * 10 + int(p_new * 10))
    archived = [f"a{i}" for i in range(40)]
    feeds, rows = {}, []
    for feed_id in "pqr":
        pos, feed = 0, []
        for i in range(400):
            pos += rng.choice([1, 1, 1, 3, 9])
            new = f"{feed_id}{rng.randrange(300)}"
            feed.append((pos, new if rng.random() < p_new else rng.choice(archived)))
        feeds[feed_id] = feed
        rows += [(feed_id, p, k) for p, k in feed]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "feed_id string, pos bigint, tweet_id string")
    keys = spark.createDataFrame([(k,) for k in archived], "tweet_id string")
    for stop_after in (3, 12):
        got = boundary.quick_cut(frame, keys, stop_after, block).collect()
        for feed_id, feed in feeds.items():
            taken, reason = loop(feed, archived, stop_after)
            mine = sorted(r for r in got if r["feed_id"] == feed_id)
            assert [(r["pos"], r["tweet_id"], r["known"]) for r in mine] == taken
            assert {r["stopped_reason"] for r in mine} == {reason}


def test_full_cut_cap(spark):
    frame = spark.createDataFrame(
        [("f", i, f"k{i % 3}") for i in range(10)], "feed_id string, pos bigint, tweet_id string"
    )
    none = spark.createDataFrame([], "tweet_id string")
    assert boundary.full_cut(frame, none).count() == 10
    assert boundary.full_cut(frame, none, 0).count() == 10
    capped = boundary.full_cut(frame, none, 4).collect()
    assert len(capped) == 4 and capped[0]["stopped_reason"] == "pagination ended (limit 4 requested)"
    counters = boundary.sync_counters(boundary.full_cut(frame, none)).first()
    assert (counters["seen"], counters["known"], counters["added"]) == (10, 7, 3)
