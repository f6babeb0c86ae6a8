"""Windows of text units, dealt to buckets by their minimisers.

Texts are sequences of units (words or bytes).  A window is ``width`` consecutive
units; its minimiser is the place in it whose ``seed`` units hash lowest (the
leftmost such).  Equal windows have equal minimisers, so all copies of a window
meet in the bucket of that hash.  Consecutive windows with the same minimiser
travel as one string (a super-k-mer) with the document and the place it starts at.

A task packs the strings of some megabytes of texts by bucket: one compressed row
per bucket.  A string that repeats among them is sent once, for its smallest document;
the copies in later documents are known to be repeats right there and sent on only as
such.  So a passage that a third of all documents hold reaches its bucket once per
some megabytes, not once per document.

Windows around one frequent seed may still make a bucket of any size.  Oversized buckets
are told from a sample beforehand; the tasks that deal the texts deal their windows by
longer seeds, to many parts, so no task reads such a bucket.  A bucket is read as a stream, and one that exceeds its limit is dealt anew: by minimisers of half a
window first, then by whole windows, as often as needed.  Equal windows meet each time.
Where copies of one window make a bucket, those known to be repeats leave it on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import mix64, slices, utf8, written

SLICE_BYTES = 1 << 20
FLUSH_BYTES = 8 << 20
FLUSH_STRINGS = 1 << 18  # short strings take more memory than their bytes
FAN = 64  # parts that a bucket is dealt to anew
WHOLE = 2  # from this level on, windows are dealt by their own hashes
SPLIT = 10  # a bucket's strings are that much larger than its share of the texts, at most
HOT = 1 << 16  # an oversized bucket with more than one in so many of all bytes is dealt apart at once
HOT_FAN = 256  # parts of such a bucket
TASKS = 1 << 16  # that gather buckets, at most
SAMPLE = 1 / 16  # of the rows, to tell which buckets these are

# A text's key: its doc_id (a missing one is the largest) and a hash that tells
# rows with the same doc_id apart.  Equal rows share a key and all verdicts.
LAST_ID = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


DOC, ROW, SPANS = "__doc", "__row", "__spans"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its key.  The hash is 0 unless rows share the doc_id.

    The ids that rows share are looked for first, without the texts; they are few, so
    the join below does not shuffle the texts (Catalyst sees the size of the table).
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    ids = docs.select(doc.alias(DOC)).groupBy(DOC).count().where("count > 1")
    shared = written(ids.select(DOC), "shared-ids").withColumn("__shared", F.lit(True))
    row = F.when(F.col("__shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.withColumn(DOC, doc).join(shared, DOC, "left").withColumn(ROW, row).drop("__shared")


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the next call."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), np.uint64(base))
        kept[0] = 1
        _POWERS[base] = kept = np.cumprod(kept, dtype=np.uint64)
    return kept[:n]


def rolling(units: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A scrambled polynomial hash of ``width`` consecutive hashed units, at all places or ``at`` (rising)."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n if at is None else len(at), np.uint64)
    for i in range(0, n, SLICE_BYTES):
        j = min(n, i + SLICE_BYTES)
        part = units[i : j + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(BASE, len(part)), dtype=np.uint64, out=sums[1:])
        if at is None:
            out[i:j] = (sums[width:] - sums[:-width]) * powers(INVERSE, j - i)
        else:
            a, b = np.searchsorted(at, (i, j))
            own = at[a:b] - i
            out[a:b] = (sums[own + width] - sums[own]) * powers(INVERSE, j - i)[own]
    return mix64(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes that begin at ``a`` and at ``b`` are equal, pair by pair."""
    same = np.ones(len(a), bool)
    if len(data) < 8:
        short = np.ones(len(a), bool)
    else:
        words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))  # eight bytes at any place
        short = (size < 8) | (size > 2048)
        for i in range(0, len(a), 1 << 16):
            at = np.flatnonzero(~short[i : i + (1 << 16)]) + i
            step = 0
            while len(at):
                place = np.minimum(step, size[at] - 8)
                same[at] = words[a[at] + place] == words[b[at] + place]
                step += 8
                at = at[same[at] & (size[at] > step)]
    for k in np.flatnonzero(short).tolist():
        same[k] = np.array_equal(data[a[k] : a[k] + size[k]], data[b[k] : b[k] + size[k]])
    return same


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def word_units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``, which are parted by single spaces."""
    kind = np.int32 if len(data) < (1 << 31) - 1 else np.int64
    gaps = np.flatnonzero(data == 0x20).astype(kind)
    starts = np.concatenate((np.zeros(1, kind), gaps + 1), dtype=kind)
    ends = np.concatenate((gaps, np.full(1, len(data), kind)), dtype=kind)
    del gaps
    full = starts < ends
    starts, ends = starts[full], ends[full]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # whole words, a slice's bytes or one at least
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        part = data[starts[i] : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        symbols = part.astype(np.uint64) + np.uint64(1)
        np.cumsum(symbols * powers(BASE, len(part)), dtype=np.uint64, out=sums[1:])
        left, right = starts[i:j] - starts[i], ends[i:j] - starts[i]
        hashes[i:j] = (sums[right] - sums[left]) * powers(INVERSE, len(part) + 1)[left]
        i = j
    return starts, ends, mix64(hashes + (ends - starts).astype(np.uint64))


BYTE_HASHES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data), dtype=np.int32 if len(data) < (1 << 31) - 1 else np.int64)
    return at, at + 1, BYTE_HASHES[data]


def byte_pieces(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(first unit, piece) of a text; pieces overlap so that each window is in one."""
    for at in range(0, max(1, len(text) - width + 1), SLICE_BYTES):
        yield at, text[at : at + SLICE_BYTES + width - 1]


def word_pieces(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    words, step = text.split(), SLICE_BYTES // 8
    for at in range(0, max(1, len(words) - width + 1), step):
        yield at, b" ".join(words[at : at + step + width - 1])


@dataclass
class Rule:
    """What windows are made of."""

    width: int
    seed: int
    units: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    pieces: Callable[[bytes, int], Iterator[tuple[int, bytes]]]


@dataclass
class Windows:
    """The windows of strings that are joined by single spaces.

    By unit: ``starts``, ``ends``, ``hashes``.  By window: ``owner``, its string, and
    ``whole``, whether it lies in one string.  By string: ``first_unit``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    whole: np.ndarray
    first_unit: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, lengths: np.ndarray, rule: Rule) -> Windows:
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        starts, ends, hashes = rule.units(data)
        owner = (np.searchsorted(begin, starts, side="right") - 1).astype(np.int32)
        inside = starts < (begin + lengths)[owner]
        n = max(0, len(starts) - rule.width + 1)
        whole = (owner[rule.width - 1 :] == owner[:n]) & inside[rule.width - 1 :] & inside[:n]
        return cls(data, starts, ends, hashes, owner[:n], whole, np.searchsorted(starts, begin))


def runs(pieces: list[bytes], rule: Rule) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser hash.

    Piece number, first unit in it, number of windows, first and last byte in the
    joined pieces, the minimiser's hash; and the joined pieces.
    """
    data = np.frombuffer(b" ".join(pieces), np.uint8)
    w = Windows.of(data, np.array([len(p) for p in pieces]), rule)
    n = len(w.owner)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, none, none, np.empty(0, np.uint64), data
    lowest = sliding_min(rolling(w.hashes, rule.seed), rule.width - rule.seed + 1)
    new = np.ones(n, bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (w.owner[1:] != w.owner[:-1]) | (w.whole[1:] != w.whole[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, n))
    good = w.whole[head]
    head, count = head[good], count[good]
    piece = w.owner[head]
    last = w.ends[head + count + rule.width - 2]
    return piece, head - w.first_unit[piece], count, w.starts[head], last, lowest[head], data


PACKED = "bucket long, n long, bytes long, block binary"
VERDICTS = f"{DOC} long, {ROW} long, spans binary"
CODEC = pa.Codec("zstd", compression_level=6)


def pack(doc: np.ndarray, row: np.ndarray, unit: np.ndarray, size: np.ndarray, joined: bytes) -> tuple:
    """Documents mostly come in order: their differences are small and compress well."""
    steps = np.diff(doc, prepend=np.int64(0))
    block = b"".join([x.astype(np.int64).tobytes() for x in (steps, row, unit, size)] + [joined])
    return len(doc), len(block), CODEC.compress(block, asbytes=True)


def unpack(n: int, size: int, block: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(doc, row, unit, size) as rows of one array, and the strings."""
    data = CODEC.decompress(block, decompressed_size=int(size), asbytes=True)
    arrays = np.frombuffer(data, np.int64, 4 * n).reshape(4, n).copy()
    np.cumsum(arrays[0], out=arrays[0])
    return arrays, data[32 * n :]


class Dealer:
    """Collects the strings of some slices of texts and packs them by bucket."""

    def __init__(self, rule: Rule, buckets: int, shift: int = 0, hot: np.ndarray | None = None):
        self.rule, self.buckets, self.shift = rule, buckets, np.uint64(shift)
        self.hot = hot if hot is not None and len(hot) else None
        self.finer = replace(rule, seed=max(rule.seed, rule.width // 2))
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.first_doc: list[int] = []
        self.strings: list[bytes] = []
        self.arrays: list[tuple] = []
        self.known: list[tuple] = []
        self.bytes = 0

    def add(self, pieces: list[bytes], doc: np.ndarray, row: np.ndarray, base: np.ndarray) -> None:
        piece, unit, count, left, right, low, data = runs(pieces, self.rule)
        self.bytes += len(data)
        if not len(piece):
            return
        doc, row, unit = doc[piece], row[piece], unit + base[piece]
        bucket = ((low >> self.shift) % np.uint64(self.buckets)).astype(np.int64)
        raw = data.tobytes()
        if self.hot is not None:
            place = np.minimum(np.searchsorted(self.hot, bucket), len(self.hot) - 1)
            hot = self.hot[place] == bucket
            at = np.flatnonzero(hot)
            if len(at):
                pieces = [raw[x:y] for x, y in zip(left[at].tolist(), right[at].tolist(), strict=True)]
                for i, j in slices(pieces, SLICE_BYTES):
                    own = at[i:j]
                    which, first, n, x, y, low, part = runs(pieces[i:j], self.finer)
                    home = self.buckets + place[own][which] * HOT_FAN + ((low >> np.uint64(32)) % np.uint64(HOT_FAN)).astype(np.int64)
                    self.take(part.tobytes(), home, doc[own][which], row[own][which], unit[own][which] + first, n, x, y)
                doc, row, unit, count, left, right, bucket = (v[~hot] for v in (doc, row, unit, count, left, right, bucket))
        self.take(raw, bucket, doc, row, unit, count, left, right)

    def take(self, raw: bytes, bucket, doc, row, unit, count, left, right) -> None:
        """Strings, from ``left`` to ``right`` of ``raw``, for their buckets."""
        if not len(doc):
            return
        strings = [raw[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
        start = len(self.first_doc)
        self.first_doc += doc.tolist()
        first = [self.seen.setdefault(s, i) for i, s in enumerate(strings, start)]
        # A copy in a later document than the first met is a repeat.  All other copies
        # are sent on: the bucket decides.
        copy = doc > np.array([self.first_doc[i] for i in first])
        self.known.append((doc[copy], row[copy], unit[copy], count[copy] + self.rule.width - 1))
        sent = np.flatnonzero(~copy)
        self.strings += [strings[i] for i in sent.tolist()]
        self.arrays.append((bucket[sent], doc[sent], row[sent], unit[sent], right[sent] - left[sent]))

    def flush(self) -> pd.DataFrame:
        out = []
        if self.arrays:
            bucket, doc, row, unit, size = (np.concatenate(x) for x in zip(*self.arrays, strict=True))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[i:j]
                joined = b" ".join([self.strings[k] for k in own.tolist()])
                out.append((int(bucket[own[0]]), *pack(doc[own], row[own], unit[own], size[own], joined)))
            known = merge(*(np.concatenate(x) for x in zip(*self.known, strict=True)))
            if len(known[0]):
                # They go with any bucket, but not all with the same.
                out.append((-1 - int(bucket[int(known[0][0]) % len(bucket)]), *pack(*known, b"")))
        self.clear()
        return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])


Texts = tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]


def cut(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[Texts]:
    """Pieces of the texts of some slice, with their documents, rows and first units."""
    for batch in batches:
        order = np.lexsort((batch[ROW].to_numpy(), batch[DOC].to_numpy()))
        doc, row = batch[DOC].to_numpy()[order], batch[ROW].to_numpy()[order]
        pieces, text, base = [], [], []
        for i, k in enumerate(order):
            for at, piece in rule.pieces(batch["text"].iat[k], rule.width):
                pieces.append(piece)
                text.append(i)
                base.append(at)
        text, base = np.array(text, np.int64), np.array(base, np.int64)
        for a, b in slices(pieces, SLICE_BYTES):
            yield pieces[a:b], doc[text[a:b]], row[text[a:b]], base[a:b]


def hot_buckets(docs: DataFrame, rule: Rule, buckets: int, limit: int) -> list[int]:
    """Buckets of more than ``limit`` bytes and one in :data:`HOT` of all: fewer than that; rising.

    Told from a random :data:`SAMPLE` of the rows.  This only plans who does the work, as
    range partitioning does: a bucket that it misses is dealt anew when it is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pieces, *_ in cut(batches, rule):
            _, _, _, left, right, low, _ = runs(pieces, rule)
            bucket, at = np.unique((low % np.uint64(buckets)).astype(np.int64), return_inverse=True)
            size = np.bincount(at, right - left + 32, len(bucket)).astype(np.int64)
            yield pd.DataFrame({"bucket": bucket, "size": size})

    some = docs.sample(SAMPLE, seed=7).select(DOC, ROW, utf8().alias("text"))
    sizes = some.mapInPandas(run, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    sizes = written(sizes, "bucket-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    hot = sizes.where((F.col("size") > limit * SAMPLE) & (F.col("size") * HOT > total))
    return sorted(r["bucket"] for r in hot.select("bucket").collect())


def deal(docs: DataFrame, rule: Rule, buckets: int, hot: list[int] | None = None) -> DataFrame:
    """Packed strings of ``docs`` (keyed) by bucket; ``hot`` buckets dealt by longer seeds to parts of theirs.

    Rows with bucket -1 - b hold spans of units that are known to be repeats.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer = Dealer(rule, buckets, hot=np.array(hot or [], np.int64))
        for texts in cut(batches, rule):
            dealer.add(*texts)
            if dealer.bytes >= FLUSH_BYTES or len(dealer.first_doc) >= 2 * FLUSH_STRINGS:
                yield dealer.flush()
        yield dealer.flush()

    return docs.select(DOC, ROW, utf8().alias("text")).mapInPandas(run, PACKED)


def merge(doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of units in order of their texts, those that touch made one."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order].astype(np.int64)
    end = start + size[order]
    if not len(doc):
        return doc, row, start, end.astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    # So that ends can run up over all texts at once, lift each text above the one before.
    lift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    head = new.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], row[at], start[at], (reach[last] - start[at]).astype(np.int64)


def packed_by_text(doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    """A row per text: its spans as pairs (start, end) of 64-bit integers."""
    doc, row, start, size = merge(doc, row, start, size)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    pairs = np.stack((start, start + size), 1)
    edges = np.append(at, len(doc))
    spans = [pairs[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame({DOC: doc[at], ROW: row[at], "spans": spans})


def reordered(strings: bytes, at: np.ndarray, size: np.ndarray) -> bytes:
    """The strings that begin ``at``, in that order, with a space after each but the last."""
    data = np.frombuffer(strings + b" ", np.uint8)
    ends = np.cumsum(size + 1)
    out = np.empty(len(data) if len(size) else 0, np.uint8)
    i = 0
    while i < len(size):
        start = ends[i] - size[i] - 1
        j = max(i + 1, int(np.searchsorted(ends, start + SLICE_BYTES, side="right")))
        to = np.arange(start, ends[j - 1])
        out[to] = data[to + np.repeat(at[i:j] - (ends[i:j] - size[i:j] - 1), size[i:j] + 1)]
        i = j
    return out[:-1].tobytes()


Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes], tuple[np.ndarray, ...]]
GATHERED = f"{VERDICTS}, {PACKED}"


class Bucket:
    """The strings of a bucket: judged together, or dealt anew once they exceed ``limit`` bytes."""

    def __init__(self, home: int, level: int, rule: Rule, judge: Judge, limit: int):
        self.home, self.level, self.rule, self.judge, self.limit = home, level, rule, judge, limit
        self.dealer: Dealer | None = None
        self.hold([], [])

    def hold(self, arrays: list[np.ndarray], texts: list[bytes]) -> None:
        full = [i for i, a in enumerate(arrays) if a.shape[1]]
        self.arrays, self.texts = [arrays[i] for i in full], [texts[i] for i in full]
        self.bytes = sum(32 * a.shape[1] for a in arrays) + sum(map(len, texts))

    def take(self, arrays: np.ndarray, joined: bytes) -> Iterator[pd.DataFrame]:
        if self.dealer is not None:
            yield from self.deal(arrays, joined)
            return
        self.arrays.append(arrays)
        self.texts.append(joined)
        self.bytes += 32 * arrays.shape[1] + len(joined)
        if self.bytes <= self.limit:
            return
        if self.level >= WHOLE:
            yield self.judged()
            alone = self.drop_repeats()
            if alone or 2 * self.bytes <= self.limit:
                self.limit = max(self.limit, 2 * self.bytes)
                return
        seed = self.rule.width if self.level + 1 >= WHOLE else max(self.rule.seed, self.rule.width // 2)
        # Each level of whole windows looks at other bits of their hashes.
        shift = min(58, 6 * max(0, self.level + 1 - WHOLE))
        self.dealer = Dealer(replace(self.rule, seed=seed), FAN, shift)
        held = list(zip(self.arrays, self.texts, strict=True))
        self.hold([], [])
        while held:
            yield from self.deal(*held.pop(0))

    def deal(self, arrays: np.ndarray, joined: bytes) -> Iterator[pd.DataFrame]:
        doc, row, unit, size = arrays
        ends = np.cumsum(size + 1) - 1
        strings = [joined[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        for a, b in slices(strings, SLICE_BYTES):
            self.dealer.add(strings[a:b], doc[a:b], row[a:b], unit[a:b])
            if self.dealer.bytes >= FLUSH_BYTES or len(self.dealer.first_doc) >= FLUSH_STRINGS:
                yield self.parts()

    def parts(self) -> pd.DataFrame:
        found = self.dealer.flush()
        bucket = found["bucket"].to_numpy(np.int64)
        base = self.home % (1 << 56) * FAN
        found["bucket"] = np.where(bucket < 0, bucket - base, bucket + base)
        return found.assign(**{DOC: 0, ROW: 0, "spans": None})

    def judged(self) -> pd.DataFrame:
        """Verdicts on the strings held, which are then in order of document, row and place."""
        (doc, row, unit, size), strings = np.concatenate(self.arrays, 1), b" ".join(self.texts)
        self.hold([], [])
        order = np.lexsort((unit, row, doc))
        at = (np.cumsum(size + 1) - (size + 1))[order]
        doc, row, unit, size = doc[order], row[order], unit[order], size[order]
        strings = reordered(strings, at, size)
        which, start, length = self.judge(doc, row, unit, size, strings)
        self.hold([np.stack((doc, row, unit, size))], [strings])
        self.gone = np.bincount(which, minlength=len(doc))
        return verdict_rows(doc[which], row[which], unit[which] + start, length)

    def drop_repeats(self) -> bool:
        """Keep of the strings judged those with a window that may stay; is it one window only?

        A repeat decides on nothing: what it repeats is kept.
        """
        (arrays,), (strings,) = self.arrays, self.texts
        w = Windows.of(np.frombuffer(strings, np.uint8), arrays[3], self.rule)
        at = np.flatnonzero(w.whole)
        kept = self.gone < np.bincount(w.owner[at], minlength=len(self.gone))
        hashes = rolling(w.hashes, self.rule.width, at[kept[w.owner[at]]])
        size = arrays[3][kept]
        begin = (np.cumsum(arrays[3] + 1) - (arrays[3] + 1))[kept]
        self.hold([arrays[:, kept]], [b" ".join([strings[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)])])
        return len(np.unique(hashes)) <= 1

    def finish(self) -> Iterator[pd.DataFrame]:
        if self.dealer is not None:
            yield self.parts()
        elif self.arrays:
            yield self.judged()


def verdict_rows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    return packed_by_text(doc, row, start, size).assign(bucket=0, n=0, bytes=0, block=None)


def gathered(dealt: DataFrame, judge: Judge, rule: Rule, limit: int, level: int, parts: int | None) -> DataFrame:
    """Verdicts of the buckets within ``limit``, and the strings of the others, dealt anew.

    Buckets are gathered in ``parts`` tasks, a few buckets each, or as Spark sees fit.
    """
    columns = [c.split()[0] for c in GATHERED.split(", ")]

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for home, bucket, n, size, block in batch.itertuples(index=False):
                if bucket < 0:  # known to be repeats
                    yield verdict_rows(*unpack(n, size, block)[0])
                    continue
                if held is None or held.home != home:
                    if held is not None:
                        yield from held.finish()
                    held = Bucket(int(home), level, rule, judge, limit)
                yield from held.take(*unpack(n, size, block))
        if held is not None:
            yield from held.finish()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(batches):
            if len(frame):
                yield frame[columns]

    home = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    rows = dealt.select(home.alias("home"), "bucket", "n", "bytes", "block")
    placed = rows.repartition(parts, "home") if parts else rows.repartition("home")
    return placed.sortWithinPartitions("home").mapInPandas(run, GATHERED)


def verdicts(dealt: DataFrame, judge: Judge, rule: Rule, limit: int, buckets: int) -> DataFrame:
    """Spans to remove, by text: what ``judge`` finds in each bucket, and what was known before.

    ``judge`` gets a bucket's strings in order of document, row and place: doc, row,
    first unit, size in bytes, and the strings joined by spaces.  It returns string number, first
    unit in the string and number of units of each window that is to go.  Buckets of more
    than ``limit`` bytes are dealt anew.  There is a task for each of the ``buckets``, up to
    :data:`TASKS`, so that a task's share does not grow with their number.
    """
    found, level = [], 0
    while not found or not dealt.isEmpty():
        parts = None if level else min(buckets, TASKS)
        out = written(gathered(dealt, judge, rule, limit, level, parts), "window-verdicts")
        found.append(out.where("block IS NULL").select(DOC, ROW, "spans"))
        dealt = out.where("block IS NOT NULL").select("bucket", "n", "bytes", "block")
        level += 1
    return reduce(DataFrame.union, found)


def spans_to_remove(rows: DataFrame, judge: Judge, rule: Rule, bucket_bytes: int) -> DataFrame:
    """The spans to remove of ``rows`` (keyed): dealt, hot buckets apart, and judged."""
    buckets, limit = bucket_count(rows, bucket_bytes), SPLIT * bucket_bytes
    hot = hot_buckets(rows, rule, buckets, limit)
    return verdicts(deal(rows, rule, buckets, hot), judge, rule, limit, buckets)


def bucket_count(docs: DataFrame, bucket_bytes: int) -> int:
    """As many buckets as the texts have ``bucket_bytes``, so that a bucket's size stays the same."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(max(16, -(-total // bucket_bytes)), (1 << 31) - 1)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (keyed), its key replaced by the list of its packed spans; NULL if nothing is to go."""
    found = spans.groupBy(DOC, ROW).agg(F.collect_list("spans").alias(SPANS))
    return docs.join(found, [DOC, ROW], "left").drop(DOC, ROW)


def union_spans(packed: list[bytes] | None) -> np.ndarray:
    """The packed spans of a text as one sorted list without overlaps."""
    if packed is None or not len(packed):
        return np.empty((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return np.stack((pairs[head, 0], reach[np.append(head[1:], len(pairs)) - 1]), 1)
