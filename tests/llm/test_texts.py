"""Mixing, decontamination and token counts against plain loops."""

import hashlib
import re

import pytest

from postarchive.llm import contamination, mixing, queries, token_counts
from tests.llm import brute

DOCS = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 7), ("b", 30), (None, 5), ("é", 1), ("a", 0), ("z", 40), ("b", 3)] * 40)]


def want_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)


def check_mix(rows, docs):
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", brute.raw(t)))
    sizes = {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + size(text)
    target = want_targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, size(t)) for d, _, t in docs)
    source_of = {d: s for d, s, _ in docs}
    taken = {}
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        largest = max(size(t) for _, x, t in docs if x == s)
        assert abs(n - target[s]) <= largest / 2 + 1e-6


def mixed(frame):
    from pyspark.sql import functions as F

    return mixing.mix_documents(frame).withColumn("taken", F.col("copies") * F.col("size")).collect()


def test_mix(spark):
    docs = DOCS + [(9999, "a", None), (9998, "only empty", ""), (9997, "b", "x\x0b\x0cy z \ty")]
    frame = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, source string, text string, size int, target double")
    first = mixed(frame)
    check_mix(first, docs)
    again = mixed(frame.repartition(7))
    key = lambda r: r["doc_id"]
    assert [(r["doc_id"], r["taken"]) for r in sorted(first, key=key)] == [(r["doc_id"], r["taken"]) for r in sorted(again, key=key)]
    assert mixed(frame.limit(0)) == []
    assert [r["taken"] for r in mixed(frame.where("doc_id = 9998"))] == [0]


def test_mix_of_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a", "w w w")] * 50 + [(None, "b", "w")] * 9, "doc_id long, source string, text string")
    rows = mixed(frame)
    assert len(rows) == 59 and all(r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["taken"] for r in rows if r["source_size"] == 150)
    assert abs(total - rows[0]["target"]) <= 1.5 or abs(total - [r for r in rows if r["source_size"] == 150][0]["target"]) <= 1.5


def test_mix_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    check_mix(queries.QUERIES["op3_mixing"](spark, sf_dir).collect(), docs)


def test_inclusion_follows_odds(spark):
    """Over many seeds' worth of documents the share drawn is the inclusion probability."""
    docs = [(i, "a" if i % 3 else "b", "w") for i in range(6000)]
    rows = mixed(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    drawn = [r["copies"] for r in rows if r["source_size"] == 4000]
    target = next(r["target"] for r in rows if r["source_size"] == 4000)
    assert abs(sum(drawn) - target) <= 0.5
    assert len(set(drawn)) == 2  # whole copies for all, one more for those drawn


ITEMS = [
    (1, "The quick brown fox, jumps over the lazy dog near 42 rivers of Gold"),
    (20, "short item"),
    (3, None),
    (4, " .. "),
    (5, "over the lazy dog near 42 rivers of gold today and more"),
    (None, "an item without an id"),
    (6, "Été à côté"),
]
TEXTS = [
    (1, "x. THE QUICK brown fox jumps-over the lazy dog near 42 rivers of gold today and more"),
    (2, "a short item; short\n\nitem"),
    (3, "shorts item short items"),
    (4, None),
    (5, ""),
    (6, "see an item, without an ID here"),
    (7, "Été à côté"),
    (8, "quick brown fox jumps over the lazy dog near 42 RIVERS, of"),
    (9, "filler " * 30000 + "short item"),
    (2, "a short item; short\n\nitem"),
    (None, "short item"),
]


def want_scan(text, items, width=10):
    words_of = lambda t: [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(brute.raw(t)))]
    words = words_of(text)
    hit, found = [False] * len(words), set()
    for item_id, item in items:
        own = words_of(item)
        windows = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} or ({tuple(own)} if own else set())
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit[i : i + len(w)] = [True] * len(w)
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 26, 200])
def test_scan(spark, limit, monkeypatch):
    monkeypatch.setattr(contamination, "MAX_PATTERN_BYTES", limit)
    docs = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert (len(contamination.scanners(bench)) > 1) == (limit == 200)
    rows = contamination.scan_documents(docs, bench).collect()
    got = [(r["doc_id"], *r["contamination"][:3]) for r in rows]
    assert sorted(got, key=repr) == sorted(((d, *want_scan(t, ITEMS)) for d, t in TEXTS), key=repr)
    for r in rows:  # spans are byte ranges of the original that hold the hit words
        cut = b" ".join(brute.raw(r["text"])[s["start"] : s["end"]] for s in r["contamination"]["spans"])
        assert len(contamination.normal_words(cut)) == r["contamination"]["n_hit"]
    none = contamination.scan_documents(docs, bench.limit(0)).collect()
    assert {r["contamination"]["n_hit"] for r in none} == {0}
    assert contamination.scan_documents(docs.limit(0), bench).count() == 0


def test_scan_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    items = read("benchmark", "item_id", "text")
    want = []
    for doc_id, text in read("documents", "doc_id", "text"):
        n, hit, ids = want_scan(text, items)
        want.append((doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    got = [tuple(r) for r in queries.QUERIES["op6_contamination"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


VOCABULARY = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁ab": -5.5, "aba": -4.5, "bb": -4.0, "▁a": -3.5, "é": -6.0}


def test_counts_equal_a_unigram_model():
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = {k: v + i * 1e-4 for i, (k, v) in enumerate(VOCABULARY.items())}  # no ties
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *own.items()], unk_id=0))
    model.pre_tokenizer = pre_tokenizers.Metaspace()
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aabbé") for _ in range(rng.randint(1, 60))) for _ in range(400)})
    for max_kept, step in ((10**6, 400), (50, 7)):
        counter = token_counts.TrieCounter(own, max_kept)
        for i in range(0, len(words), step):
            counter.add({w.encode() for w in words[i : i + step]})
            for w in words[i : i + step]:
                assert counter.counts[w.encode()] == len(model.encode(w).ids), w


def test_counts(spark):
    long = "ab" * 400
    texts = ["ab abab  b", None, "", " \n", "ab", "q", "日", long, "ab " * 20000, "ab", "😀a😀", "a\0 a\0b a"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = [tuple(r)[1:] for r in token_counts.count_tokens(docs, VOCABULARY).orderBy("doc_id").collect()]
    counter = token_counts.TrieCounter(VOCABULARY)
    want = [(len(brute.raw(t).split()), sum(counter.alone("▁" + w.decode()) for w in brute.raw(t).split())) for t in texts]
    assert got == want
    assert got[5][1] == 2 and got[6][1] == 4  # the mark, and a token per byte
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0
    ids = [(1 << 62) + 1, None]
    both = spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in token_counts.count_tokens(both, VOCABULARY).collect()} == set(ids)


def test_counts_of_a_public_vocabulary(spark):
    vocabulary = token_counts.read_vocabulary(queries.VOCABULARY)
    assert len(vocabulary) > 31000
    got = queries.QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["n_words"] <= r["n_tokens"] for r in got) and len(got) == 200
