"""Byte and word substring dedup against plain loops."""

import random

import numpy as np
import pytest

from postarchive.llm import suffix_family, superkmers, windows
from tests.llm import brute


def frame(spark, docs):
    rows = [(d, t, "kept", 1, 2) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, doc long, row long")


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, monkeypatch):
    docs = brute.invented(seed, 60)
    want = sorted(zip([d for d, _ in docs], brute.removed_bytes(docs, 50)), key=repr)
    got = suffix_family.digests(suffix_family.mark(frame(spark, docs), bucket_bytes=2000)).collect()
    assert sorted(((r[0], tuple(r[1:])) for r in got), key=repr) == want
    assert sum(x[1] for _, x in want) > 1000


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    docs = brute.invented(seed, 60)
    want = sorted(zip([d for d, _ in docs], brute.removed_words(docs, 20)), key=repr)
    got = superkmers.digests(superkmers.mark(frame(spark, docs), bucket_bytes=2000)).collect()
    assert sorted(((r[0], tuple(r[1:])) for r in got), key=repr) == want
    assert sum(x[1] for _, x in want) > 300


def lowest(strings, rule):
    """The string whose units hash lowest as a seed."""
    hashes = [int(windows.rolling(rule.units(np.frombuffer(s, np.uint8))[2], rule.seed)[0]) for s in strings]
    return strings[int(np.argmin(hashes))].decode()


def around_one_seed(op):
    """Texts that differ, but for a few copied passages, around a low-hashing seed in every window."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    if op is superkmers:
        seed, parts = lowest([f"{word()} {word()}".encode() for _ in range(5000)], op.rule()), 8
    else:
        seed, parts = lowest(["".join(rng.choices("abcdefghij", k=8)).encode() for _ in range(5000)], op.rule()), 3
    docs = []
    for i in range(300):
        words = [x for _ in range(8) for x in [*(word() for _ in range(parts)), seed]]
        if i % 5 == 4:
            words[20:40] = docs[i - 3][1].split(" ")[22:50]
        docs.append((i, " ".join(words)))
    return docs


OPS = [(suffix_family, brute.removed_bytes, 50), (superkmers, brute.removed_words, 20)]


@pytest.mark.parametrize("op, removed, width", OPS)
def test_bucket_of_one_seed_is_split(spark, monkeypatch, op, removed, width):
    docs = around_one_seed(op)
    plain = op.repeats

    def bounded(width):
        judge = plain(width)

        def run(doc, row, unit, size, strings):
            if len(strings) > 60_000:
                raise ValueError(f"a bucket of {len(strings)} bytes")
            return judge(doc, row, unit, size, strings)

        return run

    monkeypatch.setattr(op, "repeats", bounded)
    got = op.digests(op.mark(frame(spark, docs).repartition(16), bucket_bytes=1500)).collect()
    want = list(zip([d for d, _ in docs], removed(docs, width)))
    assert sorted((r[0], tuple(r[1:])) for r in got) == want
    assert sum(x[1] for _, x in want) > 300


@pytest.mark.parametrize("op, removed, width", OPS)
def test_split_down_to_equal_windows(spark, monkeypatch, op, removed, width):
    """Buckets of a few hundred bytes: single windows are dealt anew, and copies leave on the way."""
    monkeypatch.setattr(windows, "SPLIT", 1)
    same = " ".join(f"w{i}" for i in range(25))
    docs = around_one_seed(op)[:40] + brute.invented(6, 30)
    docs += [(1000 + i // 2, f"{i} " + " " * (55 + i % 7) + f"{same} x{i} {same}" + " go" * (18 + i % 9)) for i in range(60)]
    got = op.digests(op.mark(frame(spark, docs).repartition(8), bucket_bytes=1000)).collect()
    want = sorted(zip([d for d, _ in docs], removed(docs, width)), key=repr)
    assert sorted(((r[0], tuple(r[1:])) for r in got), key=repr) == want


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(windows, "SLICE_BYTES", 64)
    text = bytes(range(33, 120)) * 5
    for width in (5, 50):
        found = [(at + i, piece[i : i + width]) for at, piece in windows.byte_pieces(text, width) for i in range(len(piece) - width + 1)]
        assert found == [(i, text[i : i + width]) for i in range(len(text) - width + 1)]
    words = b"a bb ccc dddd " * 30
    found = [
        (at + i, w)
        for at, piece in windows.word_pieces(words, 4)
        for i, w in enumerate(zip(*[piece.split()[k:] for k in range(4)]))
    ]
    assert found == list(enumerate(zip(*[words.split()[k:] for k in range(4)])))


def test_index_family_equals_one_pass():
    import numpy as np

    rng = np.random.default_rng(5)
    strings = bytes(rng.integers(97, 99, 6000, dtype=np.uint8))
    at = np.arange(len(strings) - 11)
    docs = at // 100
    family = suffix_family.IndexFamily(strings, 12)
    hashes = windows.rolling(windows.byte_units(np.frombuffer(strings, np.uint8))[2], 12)
    # A fingerprint of few bits makes different strings meet.
    hashes = (hashes >> np.uint64(55)) << np.uint64(55)
    gone = np.concatenate([family.add(hashes[i : i + 700], docs[i : i + 700], at[i : i + 700]) for i in range(0, len(at), 700)])
    least = {}
    for i in at.tolist():
        least.setdefault(strings[i : i + 12], docs[i])
    assert gone.tolist() == [bool(least[strings[i : i + 12]] < docs[i]) for i in at.tolist()]
    sizes = [len(x.fingerprints) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_empty(spark):
    none = frame(spark, [])
    assert suffix_family.digests(suffix_family.mark(none)).count() == 0
    assert superkmers.digests(superkmers.mark(none)).count() == 0
