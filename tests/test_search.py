"""Ranked search against SQLite FTS5 from the standard library, and against brute force."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import text as T
from postarchive.functions.stem import stem_word, stems
from postarchive.operators import index as ix, search, selftest

WORDS = (
    "launch launches launching launched vector vectorize vectordb café cafe running runs runner "
    "durable objects object sqlite database databases agent agents agentic über straße naïve "
    "hello world rust async runtime traits benchmark benchmarks model models context window"
).split()
QUERIES = [
    "launch", "launches", "vector", "durable objects", "durable-obj", "café", "caf", "agent model",
    "rust nosuchword", "nosuchword", "@ rust", "@", "hello hello world", "context-window", "RUN",
    "author_3", "e.org", "database sqlite runtime async", "straße", "über-agent",
]
TEXT_COLUMNS = ["full_text", "author_name", "author_handle", "links_text", "quoted_full_text",
                "article_title", "article_summary"]


def random_posts(n, seed):
    rng = random.Random(seed)

    def words(k):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "!", "-"]) for _ in range(k))

    rows = []
    for i in range(n):
        rows.append({
            "tweet_id": f"{1000 + i}", "full_text": words(rng.randrange(1, 40)),
            "author_name": f"Author {i % 7}", "author_handle": f"author_{i % 7}",
            "links": [f"https://e.org/{rng.choice(WORDS)}"] if i % 3 == 0 else None,
            "quoted_full_text": words(5) if i % 4 == 0 else None,
            "article_title": words(3) if i % 5 == 0 else None, "article_summary": None,
        })
    return rows


def post_frame(spark, rows):
    given = ["tweet_id", "full_text", "author_name", "author_handle", "links", "quoted_full_text",
             "article_title", "article_summary"]
    part = spark.createDataFrame(
        [tuple(r[c] for c in given) for r in rows],
        ", ".join(f"{c} {S.POST_TYPES[c]}" for c in given),
    )
    return part.select(
        *[F.col(c) if c in given else F.lit(None).cast(k).alias(c) for c, k in S.POST_TYPES.items()]
    )


def sqlite_index(rows, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(tweet_id UNINDEXED, {', '.join(TEXT_COLUMNS)}, tokenize='{tokenizer}')")
    con.executemany(
        f"INSERT INTO t VALUES ({', '.join('?' * 8)})",
        [(r["tweet_id"], r["full_text"], r["author_name"], r["author_handle"],
          " ".join(r["links"] or []), r["quoted_full_text"], r["article_title"], r["article_summary"])
         for r in rows],
    )
    return con


def sqlite_search(con, query, allowed=None):
    phrases = [f'"{t}"*' for t in re.findall(r"[\w@#.\-]+", query)]
    for joined in dict.fromkeys([" AND ".join(phrases), " OR ".join(phrases)]):
        hits = con.execute("SELECT tweet_id, -rank FROM t WHERE t MATCH ?", (joined,)).fetchall()
        hits = {k: round(v, 6) for k, v in hits if allowed is None or k in allowed}
        if hits:
            return hits
    return {}


@pytest.mark.parametrize("stem", [False, True])
def test_hits_and_scores_equal_fts5(spark, folder, stem):
    rows = random_posts(190, 1)
    con = sqlite_index(rows, "porter unicode61" if stem else "unicode61")
    posts = post_frame(spark, rows)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    ix.write_index(posts, f"{folder}/index", stem)
    only = posts.where("author_handle = 'author_3'")
    allowed = {r["tweet_id"] for r in rows if r["author_handle"] == "author_3"}
    computed, stored = ix.build_index(posts, stem), ix.read_index(spark, f"{folder}/index", stem)
    for index, eligible, keys in ((computed, None, None), (stored, None, None), (computed, only, allowed)):
        got = {}
        for r in search.rank(queries, index, 200, eligible).collect():
            got.setdefault(r["query_id"], {})[r["tweet_id"]] = r["score"]
        for i, query in enumerate(QUERIES):
            expected = sqlite_search(con, query, keys)
            mine = got.get(i, {})
            assert mine.keys() == expected.keys(), query
            assert all(abs(mine[k] - expected[k]) < 2e-6 for k in mine), query


def test_few_tokens_reach_the_scan(spark, folder):
    posts = post_frame(spark, random_posts(50, 2))
    ix.write_index(posts, f"{folder}/index", False)
    index = ix.read_index(spark, f"{folder}/index", False)
    one = spark.createDataFrame([("q", "durable-obj")], "query_id string, query string")
    plan = search.rank(one, index, one=True)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,durable)" in plan and "StringStartsWith(term,obj)" in plan


def test_plan_shape(spark):
    """One shuffle by post, local top k before the shuffle by query, no product joins."""
    posts = post_frame(spark, random_posts(50, 2))
    many = spark.createDataFrame([(str(i), f"{w} x{i}") for i, w in enumerate(WORDS * 3)], "query_id string, query string")
    plan = search.rank(many, ix.build_index(posts, False))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 2
    assert "Exchange hashpartitioning(query_id" in plan


def test_no_limit_is_cut(spark):
    posts = post_frame(spark, [dict(r, full_text="common") for r in random_posts(300, 3)])
    queries = spark.createDataFrame([("q", "common")], "query_id string, query string")
    index = ix.build_index(posts, False)
    assert search.rank(queries, index, 250).count() == 250
    with pytest.raises(ValueError):
        search.rank(queries, index, 0)


def test_only_the_vocabulary_is_repeated(spark):
    posts = post_frame(spark, random_posts(50, 2))
    queries = spark.createDataFrame([("q", "durable-obj word")], "query_id string, query string")
    plan = search.rank(queries, ix.build_index(posts, False))._jdf.queryExecution().optimizedPlan().toString()
    # Below the generator of leading parts stands the aggregate of distinct terms.
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Generate explode(sequence(1, " in line:
            assert any("Aggregate [term" in below for below in lines[i + 1 : i + 3])


def test_refresh_equals_rebuild(spark):
    rows = random_posts(60, 4)
    changed = [dict(r, full_text=r["full_text"] + " added word") for r in rows[:20]]
    old = ix.build_index(post_frame(spark, rows[:50]), True)
    fresh = ix.refresh(old, post_frame(spark, changed + rows[50:]))
    rebuilt = ix.build_index(post_frame(spark, changed + rows[20:]), True)
    for name in ("postings", "docs"):
        assert sorted(getattr(fresh, name).collect()) == sorted(getattr(rebuilt, name).collect())


def test_integrity(spark):
    posts = post_frame(spark, random_posts(10, 5))
    docs = ix.doc_lengths(posts)
    ok = ix.integrity(posts, docs).first()
    assert ok["in_sync"] and ok["bookmarks"] == ok["indexed"] == 10
    bad = ix.integrity(posts.where("tweet_id < '1008'"), docs.where("tweet_id > '1002'")).first()
    assert (bad["orphaned"], bad["missing"], bad["in_sync"]) == (2, 3, False)


def test_self_test_finds_every_post(spark):
    rows = random_posts(40, 6)
    for i, r in enumerate(rows):
        r["full_text"] += f" filler text that makes the post long enough to be tested zebra{i:03d}x " * 2
    rows[0]["full_text"] = "benchmark " * 20
    posts = post_frame(spark, rows)
    tests = selftest.self_test(posts, ix.build_index(posts, True), size=None).collect()
    assert len(tests) == 40 and all(r["ok"] for r in tests)
    by_key = {r["tweet_id"]: r for r in tests}
    assert by_key["1000"]["mode"] == "fallback" and by_key["1000"]["author_filter_ok"] is None
    assert by_key["1005"]["token"] == "zebra005x" and by_key["1005"]["hits"] == 1
    few = selftest.self_test(posts, ix.build_index(posts, True), size=5, seed=1)
    assert few.count() == 5 and sorted(few.collect()) == sorted(few.collect())


def test_tokens_equal_unicode61(spark):
    texts = ["Café_x #Tag @name a-b.c", "ÀÉÎõü Straße", "école", "日本語 text", "x1y2 3.14", "",
             "ŁÓDŹ ñandú", "ΑΣΣ σς µ ſ", None]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", list(enumerate(texts, 1)))
    expected = {i: [] for i in range(1, len(texts) + 1)}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        expected[doc].append(term)
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string")
    got = {r["i"]: r["k"] for r in frame.select("i", T.tokens(F.col("t")).alias("k")).collect()}
    assert got == expected


def test_stems(spark):
    cases = {"launches": "launch", "relational": "relat", "hopping": "hop", "happy": "happi",
             "geology": "geologi", "conformabli": "conform", "as": "as", "skies": "ski", "generalizations": "gener"}
    assert {w: stem_word(w) for w in cases} == cases
    rows = spark.createDataFrame([(["running", "cats"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in rows.select(stems("t")).collect()] == [["run", "cat"], [], []]


def test_words(spark):
    row = spark.createDataFrame([("Tiny Elephants elephants and Giraffes 12345678",)], "t string").select(
        T.distinctive_word(F.col("t")).alias("w"), T.candidate_words(F.col("t")).alias("c")
    ).first()
    assert row["w"] == "elephants" and row["c"] == ["Elephants", "elephants", "Giraffes"]


@pytest.mark.parametrize("seed", [7, 8])
def test_frequent_phrases_are_left_for_last(spark, folder, monkeypatch, seed):
    """The same ranking as scoring everything, with fewer posts looked at."""
    rng = random.Random(seed)
    rows = random_posts(250, seed)
    for i, r in enumerate(rows):
        r["full_text"] += " the a of" + rng.choice(["", " the", f" rare{i % 40}", f" rare{i % 40} rare{i % 7}"])
    ix.write_index(post_frame(spark, rows), f"{folder}/index", False)
    index = ix.read_index(spark, f"{folder}/index", False)
    vocabulary = WORDS + ["the", "a", "of", "nosuchword", "durable-obj", "of-the", *[f"rare{i}" for i in range(40)]]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    frame = spark.createDataFrame(queries, "query_id int, query string")
    written = {}
    keep = search.held

    def recorded(frame, purpose):
        written[purpose] = keep(frame, purpose)
        return written[purpose]

    monkeypatch.setattr(search, "held", recorded)
    monkeypatch.setattr(search, "AT_ONCE", 0)
    got = search.rank(frame, index, 5).collect()
    pruned = written["search-candidates"].count()
    assert written["search-asked"].where("NOT essential").count() > 20
    assert written["search-plan"].where("proven AND left > 0").count() > 10 and written["search-plan"].where("NOT proven").count() > 0
    monkeypatch.setattr(search, "MARGIN", 1e9)  # no threshold: every query is scored by all its phrases
    want = search.rank(frame, index, 5).collect()
    assert sorted(got) == sorted(want) and len(want) > 200
    assert pruned < 60 * 250 / 4
    monkeypatch.setattr(search, "AT_ONCE", 10**9)
    assert sorted(search.rank(frame, index, 5).collect()) == sorted(want)
    assert sorted(search.rank(frame, ix.build_index(post_frame(spark, rows), False), 5).collect()) == sorted(want)


def test_stems_in_sql_equal_the_rules():
    """The SQL that checks the stemmed searches, on the rules' own suffixes."""
    import duckdb

    from postarchive.plans.stemming import stem_tables

    rng = random.Random(3)
    ends = ("sses ies s ed ing eed y ational enci izer bli alli entli ousli ization ator alism iveness fulness aliti biliti "
            "logi icate ative iciti ness al ance er able ible ement ment ent sion tion ou ism ate iti ive ize e ll").split()
    words = {"".join(rng.choice("bcdaeiouylstxwzé") for _ in range(rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(["", *ends])
             for _ in range(20_000)} | {"x" * 70, "a", "é"}
    con = duckdb.connect()
    con.execute("CREATE TABLE words(term VARCHAR)")
    con.execute("INSERT INTO words SELECT unnest(?)", [sorted(words)])
    got = dict(con.execute(f"WITH {stem_tables('words')} SELECT term, stem FROM stems").fetchall())
    assert got == {w: stem_word(w) for w in words}


def test_stemming_moves_no_token(spark):
    """Stems are those of the rules, and neither the index nor its vocabulary joins tokens with stems."""
    posts = post_frame(spark, random_posts(60, 9))
    plain, stemmed = (sorted(ix.tokenise(posts, s).select("tweet_id", "col", "pos", "dl", "term").collect()) for s in (False, True))
    assert [(*r[:4], stem_word(r["term"])) for r in plain] == [tuple(r) for r in stemmed] and plain != stemmed
    plan = ix.vocabulary(posts, True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"tweet_id", "part"}
    twice = ix.vocabulary(posts.unionByName(posts), True)
    assert sorted(twice.collect()) == sorted(ix.vocabulary(posts, True).collect())  # rows of one post count once


@pytest.mark.parametrize("stem", [False, True])
def test_frequencies_without_a_shuffle_of_tokens(spark, stem):
    """The same frequencies as by way of the vocabulary, with texts dealt out once."""
    long = "x" * 40
    rows = [dict(r, full_text=f"{r['full_text']} alpha beta gammas {long}{i % 3} alpha beta") for i, r in enumerate(random_posts(60, 10))]
    index = ix.build_index(post_frame(spark, rows), stem)
    texts = ["al", "alpha-be", "alpha-beta-ga", "beta-alpha", f"{long}1", f"{'x' * 35}", f"gammas-{long}", "durable-obj", "nosuch", "a"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    phrases = search.held(search.query_phrases(queries, stem), "test")
    got = search.computed_frequencies(index.dealt(60), phrases)
    want = search.phrase_frequencies(index, phrases)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)) <= {"tweet_id", "phrase", "token", "query_id", "term"}
    assert "SortMergeJoin [term" not in plan and "REPARTITION_BY_NUM" in plan


def test_prefix_posts(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["zebra", "zebras", "zeb", "horse", "z" * 40, "z" * 40 + "q", "z" * 33])
    posts = [[word() for _ in range(rng.randrange(4))] for _ in range(50)]
    frame = spark.createDataFrame([(p,) for p in posts], "terms array<string>")
    for asked in (["zebra", "horse", "nosuch"], ["zeb", "z" * 33, "z" * 32, "z" * 41, "z" * 40 + "q"]):
        phrases = spark.createDataFrame([(a,) for a in asked], "phrase string")
        got = {r["phrase"]: r["posts"] for r in selftest.prefix_posts(frame, phrases).collect()}
        want = {a: sum(any(t.startswith(a) for t in p) for p in posts) for a in asked}
        assert got == {a: n for a, n in want.items() if n}


def test_self_test_counts_rows_of_one_post_together(spark):
    """Equal rows are one post, and a word of one post alone stays unique."""
    rows = [dict(r, full_text=f"{r['full_text']} filler text that makes this post long enough to be tested zebra{i:03d}x end of it")
            for i, r in enumerate(random_posts(10, 6))]
    posts = post_frame(spark, rows + rows[:3])
    tests = selftest.self_test(posts, ix.build_index(posts, False), size=None).collect()
    assert {r["hits"] for r in tests if r["token"].startswith("zebra")} == {1} and all(r["ok"] for r in tests)
    plan = selftest.prefix_posts(
        ix.build_index(posts, False).terms_by_post().select(F.inline_outer("groups")),
        spark.createDataFrame([("zebra",)], "phrase string"),
    )._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
