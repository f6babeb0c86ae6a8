"""Substring dedup on words by super-k-mer partitioning.

A window is ``WIDTH`` consecutive words of one document.  A word is removed if a
window that covers it, as a sequence of words, also starts earlier: in a document
with a smaller id, or in the same one further ahead.  Windows are dealt to buckets
by their minimisers, neighbours with the same minimiser as one packed string (see
:mod:`postarchive.llm.windows`).  A bucket sorts the hashes of its windows; those
whose hash is not alone are compared by their bytes, so counts are exact.

Defined cases: NULL and blank texts have no words; texts shorter than a window keep
all words; rows sharing a doc_id are judged each against smaller ids and against
themselves, not against one another, and equal rows alike; rows without an id count
as later than all others.  An empty table gives an empty result.  Other columns pass
through.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm import windows as win
from postarchive.llm.common import utf8

WIDTH = 20
SEED = 2
BUCKET_BYTES = 2 << 20


def repeated(w: win.Windows, at: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, window) of the windows ``at`` that are not alone, equal windows in a group, in order.

    Windows are sorted by hash.  Neighbours under one hash are compared by their bytes;
    should they differ, their group is told apart by its words.
    """
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    several = np.zeros(len(order), bool)
    several[1:] = same
    several[:-1] |= same
    order, hashes = at[order[several]], hashes[several]
    if not len(order):
        return order, order
    left, size = w.starts[order].astype(np.int64), w.ends[order + width - 1] - w.starts[order]
    pair = np.flatnonzero(hashes[1:] == hashes[:-1])
    equal = size[pair] == size[pair + 1]
    equal[equal] = win.same_bytes(w.data, left[pair[equal]], left[pair[equal] + 1], size[pair[equal]])
    group = np.cumsum(np.append(True, hashes[1:] != hashes[:-1]))
    if not equal.all():
        group = told_apart(w, order, group, np.unique(group[pair[~equal]]), left, size)
    back = np.lexsort((order, group))
    return group[back], order[back]


def told_apart(w, order, group, mixed, left, size) -> np.ndarray:
    """``group`` with the windows of the ``mixed`` groups, which share a hash only, numbered by their bytes."""
    group, numbers = group.copy(), {}
    for k in np.flatnonzero(np.isin(group, mixed)).tolist():
        window = w.data[left[k] : left[k] + size[k]].tobytes()
        group[k] = numbers.setdefault((int(group[k]), window), len(order) + 1 + len(numbers))
    return group


def repeats(width: int) -> win.Judge:
    def judge(doc, row, unit, size, strings):
        data = np.frombuffer(strings, np.uint8)
        w = win.Windows.of(data, size, rule(width))
        at = np.flatnonzero(w.whole)
        group, at = repeated(w, at, win.rolling(w.hashes, width, at), width)
        if not len(at):
            none = np.empty(0, np.int64)
            return none, none, none
        own = w.owner[at]
        place = unit[own] + at - w.first_unit[own]
        doc, row = doc[own], row[own]
        # Members of a group are in order of document, row and place.
        first = np.append(True, group[1:] != group[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        own_first = first | np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
        own_head = np.flatnonzero(own_first)[np.cumsum(own_first) - 1]
        # Rows that share the first one's id are judged against themselves only.
        gone = (doc > doc[head]) | (place != place[own_head])
        at, own = at[gone], own[gone]
        return own, at - w.first_unit[own], np.full(len(at), width)

    return judge


def rule(width: int = WIDTH) -> win.Rule:
    return win.Rule(width, min(SEED, width), win.word_units, win.word_pieces)


def mark(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` and their spans: the packed ranges of words to remove."""
    rows = win.keyed(docs)
    return win.with_spans(rows, win.spans_to_remove(rows, repeats(width), rule(width), bucket_bytes))


def kept_words(text: bytes, packed) -> tuple[int, int, bytes]:
    """Number of words, number removed, the kept words joined by spaces."""
    words = text.split()
    gone = win.union_spans(packed)
    kept, at = [], 0
    for a, b in gone.tolist():
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove(marked: DataFrame) -> DataFrame:
    """``marked`` without spans, with ``kept``: n_words, n_removed, text."""

    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [kept_words(t, s) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "text"])

    cut = F.pandas_udf(run, "n_words long, n_removed long, text binary")
    return marked.withColumn("kept", cut(utf8(), F.col(win.SPANS))).drop(win.SPANS)


def digests(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, hashed where the text is."""

    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [kept_words(t, s) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(
            [(n, gone, hashlib.sha256(text).hexdigest()) for n, gone, text in rows],
            columns=["n_words", "n_removed", "kept_sha256"],
        )

    cut = F.pandas_udf(run, "n_words long, n_removed long, kept_sha256 string")
    found = marked.select("doc_id", cut(utf8(), F.col(win.SPANS)).alias("kept"))
    return found.select("doc_id", "kept.*")
