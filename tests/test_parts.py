"""Counts by leading parts and rows of an index against plain loops."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from postarchive.functions import parts, postings
from postarchive.functions.stem import stem_word
from postarchive.operators import index as ix


def plain(posts, longest):
    posts_of, terms_of = Counter(), Counter()
    for terms in posts:
        words = set(terms or [])
        posts_of.update({w[:n] for w in words for n in range(1, min(len(w), longest) + 1)} | {w for w in words if len(w) > longest})
        terms_of.update(words)
    return {p: (n, terms_of[p]) for p, n in posts_of.items()}


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_plain_loops(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(parts, "TERMS_AT_ONCE", rng.choice([1, 40, 10**6]))
    monkeypatch.setattr(parts, "PAIRS_AT_ONCE", rng.choice([1, 7, 10**6]))
    words = ["".join(rng.choice("abé𐐀") for _ in range(rng.choice([1, 2, 3, 5, 6, 9]))) for _ in range(60)]
    posts = [rng.choice([None, [], rng.choices(words, k=rng.randrange(1, 20))]) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(posts[i : i + 13], pa.list_(pa.string()))], ["terms"]) for i in range(0, 50, 13)]
    found = Counter(), Counter()
    for batch in parts.counts(5)(iter(batches)):
        for part, n, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[0][part] += n
            found[1][part] += terms
    assert {p: (found[0][p], found[1][p]) for p in found[0]} == plain(posts, 5)


def test_nothing_is_counted_of_nothing():
    assert not list(parts.counts(5)(iter([])))


def test_buckets_are_those_of_spark(spark):
    terms = ["a", "ab", "abc", "é1", "日本語", "𐐀𐐀x", "ß", "9z"]
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select("term", ix.bucket_of("term").alias("bucket")).collect()
    assert {r["term"]: r["bucket"] for r in rows} == {t: postings.bucket_of(t[: ix.BUCKET_LETTERS], ix.BUCKETS) for t in terms}


@pytest.mark.parametrize("stem", [True, False])
def test_index_rows_equal_plain_loops(stem, monkeypatch):
    """Postings come sorted as they are stored, and every post has its length."""
    rng = random.Random(stem)
    monkeypatch.setattr(postings, "ROWS_AT_ONCE", 30)
    words = ["running", "runs", "run", "trains", "é", "x" * 8, *("".join(rng.choices("abc", k=3)) for _ in range(20))]
    posts = {str(i): [(c, rng.choices(words, k=rng.randrange(1, 9))) for c in sorted(rng.sample(range(7), rng.randrange(4)))] for i in range(40)}
    posts[None] = [(2, ["running", "run"])]
    kind = pa.list_(pa.struct([("col", pa.int32()), ("tokens", pa.list_(pa.string()))]))

    def batch(rows):
        cols = [[{"col": c, "tokens": t} for c, t in cs] for _, cs in rows]
        sizes = [sum(len(t) for _, t in cs) for _, cs in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.string()), pa.array(cols, kind), pa.array(sizes, pa.int64())], ["tweet_id", "cols", "dl"]
        )

    listed = rng.sample(list(posts.items()), len(posts))
    made = postings.rows(stem, 5, 64, 2)(iter([batch(listed[:17]), batch([]), batch(listed[17:])]))
    rows = [r for b in made for r in b.to_pylist()]
    cut = stem_word if stem else str
    dl = {k: sum(len(t) for _, t in cs) for k, cs in posts.items()}
    want = [(cut(t), k, c, n, dl[k]) for k, cs in posts.items() for c, ts in cs for n, t in enumerate(ts)]
    got = [(r["term"], r["tweet_id"], r["col"], r["pos"], r["dl"]) for r in rows if r["kind"] == postings.POSTING]
    order = lambda r: (postings.bucket_of(r[0][:2], 64), r[0].encode(), r[1] is None, r[1] or "", r[2], r[3])
    assert got == sorted(want, key=order)
    assert {r["tweet_id"]: r["dl"] for r in rows if r["kind"] == postings.DOC} == dl
    counted = {}
    for r in (r for r in rows if r["kind"] == postings.PART):
        one, other = counted.get(r["term"], (0, 0))
        counted[r["term"]] = (one + r["posts"], other + r["term_posts"])
    assert counted == plain([[cut(t) for _, ts in cs for t in ts] for cs in posts.values()], 5)
