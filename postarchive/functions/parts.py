"""Counts of terms by their leading parts, over arrays of terms.

In sorted order, the leading parts of a post's term that no earlier term of the post has
are those longer than what it shares with the term before it.  So a part's posts are a
sum over the terms below it, and no part of a post is ever written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Terms that are counted together, and pairs of terms that are compared at once.
TERMS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 17


def counts(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``part``, ``posts``, ``term_posts`` of rows of one array of terms, a row a post.

    ``posts`` have a term that begins with the part, of parts up to ``longest`` letters and
    of whole terms; ``term_posts`` have the part itself as a term.  A part may come in
    several rows, which add up.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch.column(0))
            n += len(pc.list_flatten(kept[-1]))
            if n >= TERMS_AT_ONCE:
                yield from _counted(kept, longest)
                kept, n = [], 0
        yield from _counted(kept, longest)

    return counted


def _counted(arrays: list[pa.Array], longest: int) -> Iterator[pa.RecordBatch]:
    flat = pa.concat_arrays([pa.array([], pa.string()), *(pc.list_flatten(a) for a in arrays)]).dictionary_encode()
    if not len(flat):
        return
    rows = np.cumsum([0, *(len(a) for a in arrays)])
    post = np.concatenate([pc.list_parent_indices(a).to_numpy() + first for a, first in zip(arrays, rows, strict=False)])
    order = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for columns in sums(flat.dictionary.take(pa.array(order)), post, rank[flat.indices.to_numpy()], longest):
        yield pa.RecordBatch.from_arrays(list(columns), ["part", "posts", "term_posts"])


def sums(words: pa.Array, post: np.ndarray, word: np.ndarray, longest: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """``part``, ``posts``, ``term_posts`` of terms: each one's post and place in the sorted ``words``."""
    n = len(words)
    post, word = np.divmod(np.unique(post.astype(np.int64) * n + word), n)
    letters = np.array(words.to_pylist(), dtype=f"U{longest}").view(np.uint32).reshape(n, longest)
    size = pc.utf8_length(words).to_numpy()
    shared = np.append(0, _shared(letters, word[:-1], word[1:]))
    shared[np.append(True, post[1:] != post[:-1])] = 0
    # Posts in which the word shares at most so many letters with the one before it.
    upto = np.bincount(word * (longest + 1) + shared, minlength=n * (longest + 1)).reshape(n, -1).cumsum(axis=1)
    total = upto[:, longest]
    yield words, pa.array(np.where(size > longest, total, 0), pa.int64()), pa.array(total, pa.int64())
    next_to = np.append(0, _shared(letters, np.arange(n - 1), np.arange(1, n)))
    for length in range(1, longest + 1):
        at = np.flatnonzero(size >= length)
        if not len(at):
            break
        heads = np.flatnonzero(next_to[at] < length)
        found = np.ascontiguousarray(letters[at[heads], :length]).view(f"U{length}").ravel()
        posts = np.add.reduceat(upto[at, length - 1], heads)
        yield pa.array(found, pa.string()), pa.array(posts, pa.int64()), pa.array(np.zeros_like(posts), pa.int64())


def _shared(letters: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many first letters two words share, for pairs of words."""
    found = np.empty(len(one), np.int64)
    for i in range(0, len(one), PAIRS_AT_ONCE):
        same = letters[one[i : i + PAIRS_AT_ONCE]] == letters[other[i : i + PAIRS_AT_ONCE]]
        found[i : i + PAIRS_AT_ONCE] = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))
    return found
