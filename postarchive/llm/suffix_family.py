"""Suffix-array dedup with a logarithmic index family.

A byte is removed if a ``WIDTH``-byte string that covers it also starts in a document
with a smaller id.  Suffixes matter by their first ``WIDTH`` bytes only, and are dealt
to buckets by the minimisers of these (see :mod:`postarchive.llm.windows`); each bucket
keeps an :class:`IndexFamily` of its own.  Its suffixes come in batches by rising
document.  A batch gets a suffix array, which is scanned against the arrays of the
existing levels for long matches; suffixes not met before form a new level, and levels
of like size are merged, so there are logarithmically many.

Suffixes are ordered by a 44-bit fingerprint of their first ``WIDTH`` bytes: matches
only need equal strings to be neighbours, for which any order serves.  Every match is
confirmed byte by byte; different strings under one fingerprint are kept apart.

Defined cases: NULL and empty texts have no bytes; texts shorter than ``WIDTH`` keep
all; repeats inside a document, and among rows sharing a doc_id, stay; rows without an
id count as later than all others.  An empty table gives an empty result.  Other
columns pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm import windows as win
from postarchive.llm.common import utf8

WIDTH = 50
SEED = 8
BUCKET_BYTES = 2 << 20
BATCH_BYTES = 1 << 20
INDEX_BITS = 20  # a batch has 2**20 suffixes at most


@dataclass
class Level:
    """Suffixes in order of fingerprint, one for each: its smallest document and its place."""

    fingerprints: np.ndarray
    docs: np.ndarray
    places: np.ndarray


class IndexFamily:
    def __init__(self, strings: bytes, width: int = WIDTH):
        self.width = width
        self.data = np.frombuffer(strings, np.uint8)
        self.levels: list[Level] = []
        self.others: dict[bytes, int] = {}  # strings that share another's fingerprint

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return win.same_bytes(self.data, a, b, np.full(len(a), self.width))

    def add(self, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which suffixes of a batch, in order of document, start in a smaller document too."""
        n, low = len(hashes), np.uint64((1 << INDEX_BITS) - 1)
        assert n <= 1 << INDEX_BITS
        # The suffix array: a value sort of fingerprint and number at once.
        array = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
        order, prints = (array & low).astype(np.int64), array >> np.uint64(INDEX_BITS)
        head = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if n else np.empty(0, np.int64)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
        first, at = docs[order[head]], places[order[head]]
        own = prints[head]
        new = np.ones(len(head), bool)
        for level in self.levels:
            where = np.minimum(np.searchsorted(level.fingerprints, own), len(level.fingerprints) - 1)
            hit = np.flatnonzero(level.fingerprints[where] == own)
            first[hit], at[hit] = level.docs[where[hit]], level.places[where[hit]]
            new[hit] = False
        alone = np.bincount(group, minlength=len(head)) == 1 if n else np.empty(0, bool)
        check = np.flatnonzero(~(new & alone)[group])
        equal = self.same(places[order[check]], at[group[check]])
        gone = np.zeros(n, bool)
        matched = check[equal]
        gone[order[matched]] = docs[order[matched]] > first[group[matched]]
        for i in np.sort(order[check[~equal]]).tolist():
            string = self.data[places[i] : places[i] + self.width].tobytes()
            gone[i] = self.others.setdefault(string, int(docs[i])) < docs[i]
        self.insert(Level(own[new], first[new], at[new]))
        return gone

    def insert(self, level: Level) -> None:
        if not len(level.fingerprints):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].fingerprints) < 2 * len(self.levels[-1].fingerprints):
            a, b = self.levels.pop(), self.levels.pop()
            joined = [np.concatenate(pair) for pair in zip(vars(a).values(), vars(b).values(), strict=True)]
            order = np.argsort(joined[0], kind="stable")  # merges two sorted runs
            self.levels.append(Level(*(x[order] for x in joined)))


def rule(width: int = WIDTH) -> win.Rule:
    return win.Rule(width, min(SEED, width), win.byte_units, win.byte_pieces)


def repeats(width: int, batch_bytes: int = BATCH_BYTES) -> win.Judge:
    def judge(doc, row, unit, size, strings):
        family = IndexFamily(strings, width)
        begin = np.cumsum(size + 1) - (size + 1)
        # Documents by rank, and places, mostly fit 32 bits, as large buckets are dealt anew.
        kind = np.int32 if len(strings) < 1 << 31 else np.int64
        rank = np.cumsum(np.append(False, doc[1:] != doc[:-1]), dtype=kind)
        which, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        a = 0
        while a < len(size):
            # Whole strings, batch_bytes or one at least; one too long is taken in parts.
            b = max(a + 1, int(np.searchsorted(begin + size, begin[a] + batch_bytes, side="right")))
            end = int(begin[b - 1] + size[b - 1])
            owner = np.repeat(np.arange(a, b), size[a:b] + 1)
            for part in range(int(begin[a]), max(end - width, int(begin[a])) + 1, batch_bytes):
                data = family.data[part : min(end, part + batch_bytes + width - 1)]
                at = part + np.arange(max(0, len(data) - width + 1))
                own = owner[at - begin[a]]
                whole = at + width <= (begin + size)[own]
                at, own = at[whole], own[whole]
                gone = family.add(win.rolling(win.byte_units(data)[2], width, at - part), rank[own], at.astype(kind))
                which.append(own[gone])
                start.append(at[gone] - begin[own[gone]])
            a = b
        which = np.concatenate(which)
        return which, np.concatenate(start), np.full(len(which), width)

    return judge


def mark(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` and their spans: the packed ranges of bytes to remove."""
    rows = win.keyed(docs)
    return win.with_spans(rows, win.spans_to_remove(rows, repeats(width), rule(width), bucket_bytes))


def kept_bytes(text: bytes, packed) -> tuple[bytes, np.ndarray]:
    spans = win.union_spans(packed)
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), spans


def digests(marked: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, hashed where the text is."""

    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, packed in zip(texts, spans, strict=True):
            kept, gone = kept_bytes(text, packed)
            rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = F.pandas_udf(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    found = marked.select("doc_id", cut(utf8(), F.col(win.SPANS)).alias("kept"))
    return found.select("doc_id", "kept.*")
