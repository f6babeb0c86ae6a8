"""Filter audit, exact dedup by a digest index and whitening, each against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from decimal import Decimal, getcontext
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postarchive.llm import exact_dedup, filter_audit, whitening

DOCS = "doc_id long, text string, source string, n int, part string, digest string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows, i):
    """Letters of the filters that row ``i`` fails, by reading the contract."""
    doc, text, _ = rows[i]
    text = text or ""
    words = WORD.findall(text)
    out = ""
    if len(words) < 200:
        out += "A"
    if 100 * len(set(words)) < 50 * len(words):
        out += "B"
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out += "C"
    if any(c in "#$%&*|" for c in text):
        out += "D"
    place = lambda d: math.inf if d is None else d
    if any((t or "") == text and place(d) < place(doc) for d, t, _ in rows):
        out += "E"
    return out


def plain_audit(rows, good, toxic):
    fails = [failures(rows, i) for i in range(len(rows))]
    parts = [s or "" for _, _, s in rows]
    out = {}
    for part in set(parts):
        own = [i for i in range(len(rows)) if parts[i] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                redundant = sum(f in fails[i] for i in own if i not in left)
                left -= gone
                shapley[f] += len(gone)
                alone = sum(fails[i] == f for i in own)
                ids = [rows[i][0] for i in gone]
                out[part, order, step] = [
                    len(left), len(gone), redundant, alone, sum(d in good for d in ids), sum(d in toxic for d in ids)
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in found}) == len(found)
    return {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in found
    }


def test_audit_matches_plain_loops(spark):
    rnd = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [
        None, "", " \t ", "short one", "SHOUTED WORDS", "a " * 300, long, long + " #", long.upper(),
        "A " * 220 + "%", "Été " * 230, "x|y", long + "\n", "\x0b".join(f"v{i}" for i in range(201)),
    ]
    rows = [(i, rnd.choice(texts), rnd.choice(["hot", "hot", "b", "", None])) for i in range(120)]
    rows += [(7, "short one", "b"), (7, "short one", "b"), (None, "short one", None), (None, "only here", "b"), (None, "only here", "b")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    assert audited(spark, rows, labels) == plain_audit(rows, good, toxic)


def test_audit_of_nothing_and_of_a_long_text(spark):
    assert audited(spark, [], []) == {}
    rows = [(1, "Word " * 400_000, "s"), (2, "Word " * 400_000, "s")]
    found = audited(spark, rows, [(1, 1, 0)])
    assert found == plain_audit(rows, {1}, set()) and len(found) == 600


def test_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = {"L": lambda text, words, distinct: F.length(text) > 1}
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit.audit(docs, labels, rules, "U").collect()}
    assert found == {("LU", 1): (2, 1, 2), ("LU", 2): (1, 1, 2), ("UL", 1): (2, 1, 2), ("UL", 2): (1, 1, 2)}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def plain_exact(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[lowered(text)]
        keep = max((d for d in ids if d is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256(lowered(text)).hexdigest()))
    return sorted(out, key=repr)


def shown(found):
    rows = found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def small_share(monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 20)  # so that small groups are hot as well as not


@pytest.mark.parametrize("count", [1, 3])
def test_exact_groups(spark, folder, count, small_share):
    rnd = random.Random(count)
    texts = [None, "", "Abc", "aBC", "Été", "été", "x" * 2_000_000, "abc ", *(f"t{i % 70}" for i in range(300))]
    rows = [(i, rnd.choice(texts)) for i in range(400)] + [(i, "hot") for i in range(400, 600)]
    rows += [(5, "hot"), (5, "hot"), (None, "hot"), (None, "nowhere"), (None, "nowhere"), (600, "only"), (-3, "abc")]
    docs = spark.createDataFrame(
        [(d, t, "d", 1, True, "k") for d, t in rows],
        "doc_id long, text string, digest string, group_size int, kept boolean, other string",
    )
    found = exact_dedup.deduplicate(docs, folder, count)
    assert shown(found) == plain_exact(rows) and "other" in found.columns


def test_exact_of_nothing(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate(docs, folder).count() == 0


def test_index_lasts_and_repeats_arrivals(spark, folder):
    def rows(*pairs):
        return exact_dedup.digested(spark.createDataFrame(pairs, "doc_id long, text string"))

    index = exact_dedup.DigestIndex(spark, folder, 4)
    index.add(rows((9, "a"), (8, "a"), (7, "b")), 0)
    again = exact_dedup.DigestIndex(spark, folder, 4)  # as another session finds it
    second = rows((6, "B"), (5, "c"), (4, "a"))
    again.add(second, 1)
    again.add(second, 1)  # a run repeated
    groups = {r.keep_id: r.group_size for r in again.groups().collect()}
    assert groups == {9: 3, 7: 2, 5: 1}
    firsts = again.entries().where("first").groupBy("arrival").count().collect()
    assert {r.arrival: r["count"] for r in firsts} == {0: 2, 1: 1}
    plan = again.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_index_is_read_without_a_shuffle(spark, folder):
    index = exact_dedup.DigestIndex(spark, folder, 4)
    index.add(exact_dedup.digested(spark.createDataFrame([(1, "a")], "doc_id long, text string")), 0)
    new = spark.createDataFrame([(b"x",)], "digest binary").repartition(4, "digest")
    plan = new.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") == 1


def whitened(spark, rows, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, label int")
    return whitening.whiten(spark, vectors, **more).collect()


def plain_whitening(vectors, most=32):
    """From the exact integer covariance by numpy's eigh."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(0)
    y = n * x - total
    centred = y.astype(float) / n
    values, parts = np.linalg.eigh((y.T @ y).astype(float) / float(n) ** 3)
    order = np.argsort(-values)[:most]
    return (y * y).sum(1), centred @ parts[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compare(found, vectors, most=32):
    deviation, white, explained = plain_whitening(vectors, most)
    n, k = white.shape
    assert len(found) == n * k
    got = np.full((n, k), np.nan)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign((got * white).sum(0))
    assert np.allclose(got * sign, white, atol=1e-6)


def test_whitening_matches_eigenvectors(spark):
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5] + rnd.normal(size=6) * 50).tolist()
    compare(whitened(spark, [(i, v, "z", 1) for i, v in enumerate(vectors)]), vectors)
    wide = (rnd.normal(size=(200, 40)) * np.linspace(5, 1, 40)).tolist()
    compare(whitened(spark, [(i, v, "z", 1) for i, v in enumerate(wide)]), wide)


def test_whitening_keeps_small_components(spark):
    """Variances a million million apart: a covariance in doubles would lose the small one."""
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=400) * 1e6, rnd.normal(size=400) * 0.5
    vectors = np.stack((a + b, a - b), 1).tolist()
    found = whitened(spark, [(i, v, "z", 1) for i, v in enumerate(vectors)])
    # The two eigenvectors in closed form, with 60 digits.
    getcontext().prec = 60
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - t for c, t in zip(row, total)] for row in x]
    p, q, r = (sum(row[i] * row[j] for row in y) for i, j in ((0, 0), (0, 1), (1, 1)))
    root = (Decimal((p - r) ** 2 + 4 * q * q)).sqrt()
    small = (Decimal(p + r) - root) / 2
    axis = (Decimal(q), small - p)
    length = (axis[0] ** 2 + axis[1] ** 2).sqrt()
    want = [float((row[0] * axis[0] + row[1] * axis[1]) / length / (small / n).sqrt()) for row in y]
    second = [r.whitened for r in sorted(found, key=lambda r: r.vec_id) if r.component == 2]
    assert np.allclose(np.abs(second), np.abs(want), rtol=1e-5, atol=1e-6)
    assert found[0].identity_error < 1e-6


def test_whitening_drops_and_defines(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [7.0, 7.0], [1.0, 2.0]]
    rows = [(i, v, "z", None) for i, v in enumerate(good)]
    bad = [None, [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0], [], [1.0, 2.0, 3.0], [1e300, 0.0]]
    compare(whitened(spark, rows + [(90 + i, v, "z", 1) for i, v in enumerate(bad)]), good)
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0], "z", 1)]) == []
    assert whitened(spark, [(i, [1.0, 2.0], "z", 1) for i in range(5)]) == []
    # One direction only: one component.
    line = whitened(spark, [(i, [float(i), 2.0 * i, 0.0], "z", 1) for i in range(10)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    # Missing and repeated ids are rows; at most `most` components.
    found = whitened(spark, [(None, v, "z", 1) for v in good] + [(1, v, "z", 1) for v in good], most=1)
    assert len(found) == 10 and {r.vec_id for r in found} == {None, 1}


def test_whitening_of_wide_numbers(spark):
    """Sums and deviations beyond 64 bits."""
    big = float(1 << 55)
    found = whitened(spark, [(i, [big * (i % 3), float(i)], "z", 1) for i in range(9)])
    assert {r.deviation for r in found} == {None} and {r.component for r in found} >= {1}
    assert found[0].identity_error < 1e-4
