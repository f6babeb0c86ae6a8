"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z lower-cased, everything but
digits, letters and non-ASCII bytes a separator, words joined by one space.  An
item's windows of ``width`` consecutive words (or the whole item, if shorter) are
the patterns; a space on either side keeps them to whole words.  Each text is run
through the automaton once, and matches are mapped back to bytes of the original.

The benchmark is test data of limited size; its patterns are shipped to every
task.  :func:`scanners` checks that: beyond ``MAX_PATTERN_BYTES`` the patterns
are split over several automata, and texts are run through one after the other.

Defined cases: NULL and empty texts have no words and hit nothing; an item
without words has no window; items with the same window all count; items without
an id hit words but are not listed; repeated rows are judged alike; other columns
pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import utf8

WIDTH = 10
MAX_PATTERN_BYTES = 64 << 20

KEPT = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NORMAL = bytes(c if c in KEPT else 0x20 for c in (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)))

RESULT = (
    "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: Iterator[tuple[object, bytes]], width: int = WIDTH) -> dict[bytes, tuple[int, set[str]]]:
    """Pattern -> (its number of words, ids of the items that have it)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = words[i : i + width]
            ids = found.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1]
            if item_id is not None:
                ids.add(str(item_id))
    return found


def automaton(of: dict[bytes, tuple[int, set[str]]]) -> ahocorasick.Automaton:
    """Bytes are read as Latin-1, so that a character is a byte."""
    built = ahocorasick.Automaton()
    for pattern, value in of.items():
        built.add_word(pattern.decode("latin-1"), value)
    if len(built):
        built.make_automaton()
    return built


def scan(text: bytes, automata: list[ahocorasick.Automaton]) -> tuple:
    """(number of words, number of hit words, sorted item ids, hit byte ranges of ``text``)."""
    words = normal_words(text)
    if not words:
        return 0, 0, [], []
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [hit for a in automata if len(a) for hit in a.iter(joined)]
    if not found:
        return len(words), 0, [], []
    ends = np.cumsum([len(w) + 1 for w in words])
    hit, items = np.zeros(len(words) + 1, np.int64), set()
    last = np.searchsorted(ends, [end for end, _ in found])
    for i, (_, (width, ids)) in zip(last, found, strict=True):
        hit[i - width + 1] += 1
        hit[i + 1] -= 1
        items |= ids
    covered = np.cumsum(hit[:-1]) > 0
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    spans = [(places[a][0], places[b - 1][1]) for a, b in edges.reshape(-1, 2)]
    return len(words), int(covered.sum()), sorted(items), spans


def scanners(benchmark: DataFrame, width: int = WIDTH) -> list[dict]:
    """The benchmark's patterns, in groups of at most ``MAX_PATTERN_BYTES``."""
    groups, size = [{}], 0
    items = benchmark.select("item_id", utf8().alias("text")).toLocalIterator(prefetchPartitions=True)
    for pattern, value in patterns(((i, bytes(t)) for i, t in items), width).items():
        if size + len(pattern) > MAX_PATTERN_BYTES:
            groups.append({})
            size = 0
        groups[-1][pattern] = value
        size += len(pattern)
    return groups


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` and ``contamination``: n_words, n_hit, items, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(scanners(benchmark, width))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [automaton(group) for group in sent.value]
        for texts in batches:
            rows = [scan(text, automata) for text in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "n_hit": [r[1] for r in rows],
                    "items": [r[2] for r in rows],
                    "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                }
            )

    marked = F.pandas_udf(run, RESULT)
    return docs.withColumn("contamination", marked(utf8()))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
