"""Tokens of posts as rows of an index, on whole batches of posts.

The rows of a batch come in the order in which postings are stored, so that sorting what
a task is dealt merges a few sorted runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postarchive.functions import parts
from postarchive.functions.stem import stem_distinct

POSTING, PART, DOC = range(3)
ROWS = "kind int, term string, tweet_id string, col int, pos int, dl bigint, posts bigint, term_posts bigint"
ROWS_AT_ONCE = 1 << 16


def rows(stem: bool, longest: int, buckets: int, letters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``tweet_id``, ``cols`` (col, tokens), ``dl``, a row a post: :data:`ROWS`.

    ``kind`` tells postings, counts by leading parts (see :func:`parts.counts`) and posts.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += pc.sum(batch.column(2)).as_py() or 0
            if n >= parts.TERMS_AT_ONCE:
                yield from _rows(kept, stem, longest, buckets, letters)
                kept, n = [], 0
        if kept:
            yield from _rows(kept, stem, longest, buckets, letters)

    return made


def _rows(batches: list[pa.RecordBatch], stem: bool, longest: int, buckets: int, letters: int) -> Iterator[pa.RecordBatch]:
    ids, cols, dl = (pa.concat_arrays([b.column(i) for b in batches]) for i in range(3))
    yield from _batches(DOC, len(ids), tweet_id=ids, dl=dl)
    held = pc.list_flatten(cols)
    tokens = pc.struct_field(held, "tokens")
    flat = pc.list_flatten(tokens).dictionary_encode()
    if not len(flat):
        return
    column = pc.list_parent_indices(tokens).to_numpy()
    post = pc.list_parent_indices(cols).to_numpy()[column]
    begins = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    pos = np.arange(len(column)) - np.repeat(begins, np.diff(np.append(begins, len(column))))
    word, words = flat.indices.to_numpy(), flat.dictionary
    if stem:
        stems = pa.array(stem_distinct(words.to_pylist()), pa.string()).dictionary_encode()
        word, words = stems.indices.to_numpy()[word], stems.dictionary
    order = pc.sort_indices(words).to_numpy()
    words, word = words.take(pa.array(order)), _ranks(order)[word]

    heads = pc.utf8_slice_codeunits(words, 0, letters).dictionary_encode()
    bucket = np.array([bucket_of(h, buckets) for h in heads.dictionary.to_pylist()])[heads.indices.to_numpy()]
    by_bucket, by_id = _ranks(np.argsort(bucket, kind="stable")), _ranks(pc.sort_indices(ids).to_numpy())
    placed = np.argsort(by_bucket[word] * len(ids) + by_id[post], kind="stable")
    rows = pa.array(post[placed])
    yield from _batches(
        POSTING, len(placed), term=words.take(pa.array(word[placed])), tweet_id=ids.take(rows),
        col=pc.struct_field(held, "col").take(pa.array(column[placed])), pos=pa.array(pos[placed], pa.int32()), dl=dl.take(rows),
    )
    for part, posts, term_posts in parts.sums(words, post, word, longest):
        yield from _batches(PART, len(part), term=part, posts=posts, term_posts=term_posts)


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


_TYPES = {"kind": pa.int32(), "term": pa.string(), "tweet_id": pa.string(), "col": pa.int32(), "pos": pa.int32(),
          "dl": pa.int64(), "posts": pa.int64(), "term_posts": pa.int64()}


def _batches(kind: int, n: int, **given: pa.Array) -> Iterator[pa.RecordBatch]:
    for i in range(0, n, ROWS_AT_ONCE):
        size = min(ROWS_AT_ONCE, n - i)
        arrays = {name: given[name].slice(i, size) if name in given else pa.nulls(size, t) for name, t in _TYPES.items()}
        arrays["kind"] = pa.array(np.full(size, kind, np.int32))
        yield pa.RecordBatch.from_arrays([*arrays.values()], [*arrays])


@cache
def bucket_of(head: str, buckets: int) -> int:
    """``pmod(xxhash64(head), buckets)`` of Spark, for less than 32 bytes and a power of two of buckets."""
    mask, data = (1 << 64) - 1, head.encode()
    p1, p2, p3, p4, p5 = (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
    )
    turned = lambda x, n: (x << n | x >> 64 - n) & mask
    h, at = 42 + p5 + len(data) & mask, 0
    while at + 8 <= len(data):
        k = turned(int.from_bytes(data[at : at + 8], "little") * p2 & mask, 31) * p1 & mask
        h, at = turned(h ^ k, 27) * p1 + p4 & mask, at + 8
    if at + 4 <= len(data):
        k = int.from_bytes(data[at : at + 4], "little") * p1 & mask
        h, at = turned(h ^ k, 23) * p2 + p3 & mask, at + 4
    for byte in data[at:]:
        h = turned(h ^ byte * p5 & mask, 11) * p1 & mask
    h = (h ^ h >> 33) * p2 & mask
    h = (h ^ h >> 29) * p3 & mask
    return (h ^ h >> 32) % buckets
