"""Near-duplicate documents and vectors against all pairs."""

import itertools

import numpy as np
import pytest

from postarchive.llm import components, minhash, multi_index, queries
from postarchive.llm.common import table
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.01"


def linked(sets, near=75):
    """Pairs of ids with similar sets, by counting shared elements."""
    holders, shared = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[x].append(i)
    return [(i, j) for (i, j), n in shared.items() if 100 * n >= near * (len(sets[i]) + len(sets[j]) - n)]


def want_groups(docs):
    sets = [brute.shingles(t) for _, t in docs]
    usable = [i for i, (d, _) in enumerate(docs) if d is not None]
    links = [(docs[i][0], docs[j][0]) for i, j in linked(sets) if docs[i][0] is not None and docs[j][0] is not None]
    root = brute.roots({docs[i][0] for i in usable}, links)
    return [(d, len(s), None if d is None else root[d]) for (d, _), s in zip(docs, sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_documents(spark, seed):
    docs = brute.invented(seed, 80)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, band string")
    got = [tuple(r) for r in minhash.groups(frame).collect()]
    assert sorted(got, key=repr) == sorted(want_groups(docs), key=repr)


def test_chain_of_documents(spark):
    """Neighbours are similar, ends are not: groups reach beyond a bucket's smallest."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]
    docs += [(100 + i, " ".join(words[:3] + [str(i)] * 9)) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc"]: r["component_id"] for r in minhash.groups(frame).collect()}
    assert got == {d: c for d, _, c in want_groups(docs)}
    assert {got[i] for i in range(60)} == {0}


def test_documents_of_the_table(spark):
    rows = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    want = want_groups([tuple(r) for r in rows])
    got = queries.QUERIES["op8_minhash"](spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)
    assert sum(d != c for d, _, c in want) > 20


def tile_input(spark, sets, components_, sketches=None):
    """Rows of one region and its members, from lists of numbers."""
    rows, members = [], []
    for i, (numbers, component) in enumerate(zip(sets, components_, strict=True)):
        values = np.sort(minhash.mix64(np.array(sorted(numbers), np.uint64)))
        signature = minhash.signatures(np.zeros(len(values), np.int64), values, 1)[0]
        sketch = minhash.mix64(signature).astype(np.uint8).tobytes()
        rows.append((5, -1, 0, i, 0, component))
        members.append((i, 0, len(values), sketch, values.tobytes()))
    return (
        spark.createDataFrame(rows, "region long, band int, hash long, doc long, tag long, component long"),
        spark.createDataFrame(members, "doc long, tag long, n long, sketch binary, elements binary"),
    )


@pytest.mark.parametrize(("tile", "elements"), [(16, 1 << 21), (2048, 1 << 21), (2048, 900)])
def test_tiles_join_what_is_near(spark, tile, elements):
    rng = np.random.default_rng(tile + elements)
    base = rng.integers(0, 1 << 40, (6, 120))
    sets = [set(base[i % 6][: rng.integers(70, 121)].tolist()) | set(rng.integers(0, 99, 5).tolist()) for i in range(90)]
    before = [i if i % 4 else i % 6 for i in range(90)]  # some are in one component already
    rows, members = tile_input(spark, sets, before)
    got = [tuple(r) for r in minhash.compared(rows, members, tile, elements).collect()]
    near = linked(sets)
    assert {tuple(sorted(p)) for p in got} <= set(near)
    known = [(i, j) for i, j in itertools.combinations(range(90), 2) if before[i] == before[j]]
    assert brute.roots(range(90), got + known) == brute.roots(range(90), near + known)
    if tile > 90 and elements > 1 << 20:
        assert len(got) == len(set(brute.roots(range(90), known).values())) - len(set(brute.roots(range(90), near + known).values()))


def test_tile_sends_unions_only(spark):
    """All near one another: a row less than members, not their pairs."""
    shared = set(range(1000, 1200))
    rows, members = tile_input(spark, [shared | {i} for i in range(300)], range(300))
    assert minhash.compared(rows, members).count() == 299


def test_same_id_with_two_texts(spark):
    """Rows that share an id are one node; each of its texts links."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    docs = [(1, x), (1, y), (1, x), (2, x + " end"), (3, y + " end"), (4, "alone " * 30)] + [(1, x)] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc"]: r["component_id"] for r in minhash.groups(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for size, share in itertools.product((3, 40, 2000), (0.3, 0.75)):
        common = int(size * share)
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate((a[:common], rng.integers(0, 1 << 63, size - common, dtype=np.uint64)))
        text = np.repeat([0, 1], size)
        s = minhash.signatures(text, np.concatenate((a, b)), 2)
        assert (s < 1 << 62).all()
        errors.append((s[0] == s[1]).mean() - common / (2 * size - common))
    assert max(map(abs, errors)) < 0.15


def test_no_documents(spark):
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(5, int(x)) for x in rng.integers(10, 900, 300)]
    edges += [tuple(map(int, e)) for e in rng.integers(2000, 2400, (150, 2))]
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    root = brute.roots({x for e in edges for x in e}, edges)
    linked_nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, root[x]) for x in linked_nodes)


def want_vectors(rows):
    ids, groups = [r[0] for r in rows], {}
    for i, (vec_id, v, label) in enumerate(rows):
        ok = v is not None and label is not None and vec_id is not None and None not in v
        if ok and np.isfinite(v).all() and np.any(v):
            groups.setdefault((label, len(v)), []).append(i)
    links, n = [], [0] * len(rows)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], np.float32).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        for start in range(0, len(x), 2000):
            for p, q in zip(*np.nonzero(x[start : start + 2000] @ x.T >= 0.98)):
                if start + p != q:
                    n[members[start + p]] += 1
                    links.append((ids[members[start + p]], ids[members[q]]))
    root = brute.roots({i for i in ids if i is not None}, links)
    return {i: (k, root[i]) for i, k in zip(ids, n) if i is not None}, len(links)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.standard_normal((30, 16))
    for i in range(900):
        v = centres[i % 30] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(1000 + i, rows[5][1], 2) for i in range(40)]  # many equal vectors
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1e30] * 16, [1e-30] * 16, rows[5][1][:7]]
    rows += [(2000 + i, v, 2) for i, v in enumerate(odd)] + [(3000, rows[5][1], None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(frame).collect()}
    want, total = want_vectors(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * total


def test_tiles_count_each_pair_once(spark):
    """A tight group in one cell and its neighbours, cut into many tiles."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (np.ones(8) + rng.standard_normal(8) * 0.05).astype(np.float32)], 1) for i in range(300)]
    want, total = want_vectors(rows)
    x = np.array([r[1] for r in rows], np.float32)
    index = multi_index.fit(x, 40 * 25)
    index.surplus = 1e9  # visit all cells: every pair is met from both sides
    frame = spark.createDataFrame(
        [(i, 1, v, "1", 8) for i, v, _ in rows], "vec_id long, copies long, embedding array<float>, label string, length int"
    )
    routed = multi_index.route(frame, index)
    for tile in (1024, 16):
        found = multi_index.link(routed, index, tile=tile).groupBy("node").sum("links").collect()
        assert {r[0]: r[1] for r in found} == {i: n for i, (n, _) in want.items() if n}


def test_vectors_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    want, total = want_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.QUERIES["op4_multi_index"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert sum(n for n, _ in got.values()) >= 0.98 * total
    assert all(got[i][0] <= want[i][0] for i in want)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in multi_index.near_duplicates(frame).collect()] == [(1, 0, 1)]
    assert multi_index.near_duplicates(frame.limit(0)).count() == 0
