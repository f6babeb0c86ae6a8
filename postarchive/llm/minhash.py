"""MinHash near-dedup with SuperMinHash signatures.

Documents are sets of word shingles (five words, A-Z lower-cased; a shorter text is
one shingle).  Two are linked if their sets' Jaccard similarity is ``NEAR`` or more.

1. Signatures.  SuperMinHash: in round j every element of a document throws a random
   value above j at the j-th place of its own random permutation, and places keep
   their least value.  Once all places of a document are below j, later rounds cannot
   change it, so long documents stop after one or two rounds.
2. Classes.  Documents with equal sets are one class from here on (128-bit digest of
   the set), so thousands of exact copies are one row.
3. Bands.  ``ROWS`` places make a band; classes that agree in a band are candidates.
   At similarity 0.75 a pair misses all bands with probability about 1e-6.
4. Verification on full sets.  First each class against the smallest of its band's
   bucket.  Buckets whose members are then in several components are unsettled; those
   that share members make a region.  A region is cut into tiles, and where two parts of
   it meet, each two members in different components are compared: by size and whole
   signature, then by their full sets.  Only the unions that a tile makes leave it, one
   row each.  Where a region's pairs outnumber those of its buckets, the buckets are
   compared instead.  Nothing is compared inside a component, and no pairs leave a task.
   A pair at the threshold is passed over by its signature only if its estimate is five
   deviations too low, which is rarer than a miss of all bands.
5. Grouping by union-find (:mod:`postarchive.llm.components`).

Defined cases: texts without words are linked with nothing, also not with one another.
An id is one node: rows sharing a doc_id are linked, and a link of one is a link of all.
Rows without an id are linked with nothing and stay.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import NO_ID, mix64, slices, utf8, written
from postarchive.llm.components import components
from postarchive.llm.windows import BASE, rolling, word_units

SHINGLE = 5
NEAR = 75  # per cent
BANDS, ROWS = 36, 4
PLACES = BANDS * ROWS
TILE = 2048  # members of a part, at most about
ELEMENTS = 1 << 21  # elements of a part's sets, at most about, or one set
HOPELESS = 0.55  # an estimate this low is five deviations below NEAR
GLANCE = 48  # places that are compared first
SLICE_BYTES = 1 << 19
UPPER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of ``texts``, sorted."""
    words = [t.translate(UPPER).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(x for w in words for x in w), np.uint8)
    hashes = word_units(data)[2]
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    n = max(0, len(hashes) - width + 1)
    whole = np.flatnonzero(owner[width - 1 :] == owner[:n]) if n else np.empty(0, np.int64)
    texts_, found = [owner[whole]], [rolling(hashes, width)[whole] if n else np.empty(0, np.uint64)]
    for k in range(1, width):  # texts of k words are one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            texts_.append(short)
            found.append(rolling(hashes, k)[begin[short]] + np.uint64(k))
    text, values = np.concatenate(texts_), np.concatenate(found)
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[new], values[new]


def signatures(text: np.ndarray, values: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of the sets (text number, element hash): ``n`` rows of ``places`` values.

    A value is round j in the high bits and 48 random bits below.
    """
    signature = np.full(n * places, np.uint64(1 << 63))
    permuted = None
    for j in range(places):
        if not len(text):
            break
        drawn = mix64(values + np.uint64((j + 1) * BASE % (1 << 64)))
        other = j + ((drawn >> np.uint64(48)) % np.uint64(places - j)).astype(np.int64)
        if permuted is None:  # in the first round the permutation is still in order
            place, swap = other, other
        else:
            each = np.arange(len(text))
            place = permuted[each, other].astype(np.int64)
            permuted[each, other] = permuted[:, j]
        thrown = (np.uint64(j) << np.uint64(48)) | (drawn & np.uint64((1 << 48) - 1))
        np.minimum.at(signature, text * places + place, thrown)
        # A document is done once every place holds a value of this round or before.
        done = signature.reshape(n, places).max(1) < np.uint64(1 << 62)
        going = ~done[text]
        if permuted is None:
            swap = swap[going]
            permuted = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(swap), 1))
            permuted[np.arange(len(swap)), swap] = 0
        else:
            permuted = permuted[going]
        text, values = text[going], values[going]
    return signature.reshape(n, places)


SIGNED = "doc long, n_shingles long, digest binary, bands array<long>, sketch binary"


def sign(docs: DataFrame) -> DataFrame:
    """doc, n_shingles, digest of the set, band hashes and a byte per place, by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for a, b in slices(texts, SLICE_BYTES):
                text, values = shingle_sets(texts[a:b])
                n = b - a
                counts = np.bincount(text, minlength=n)
                edges = np.append(0, np.cumsum(counts))
                signature = signatures(text, values, n)
                bands = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(3) + signature[:, r::ROWS] + np.uint64(r))
                sketch = mix64(signature).astype(np.uint8)
                yield pd.DataFrame(
                    {
                        "doc": batch["doc"].iloc[a:b].to_numpy(),
                        "n_shingles": counts,
                        "digest": [digest(values[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)],
                        "bands": list(bands.view(np.int64)),
                        "sketch": [s.tobytes() for s in sketch],
                    }
                )

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    signed = docs.select(doc.alias("doc"), utf8().alias("text")).mapInPandas(run, SIGNED)
    return signed.withColumn("doc", F.nullif(F.col("doc"), F.lit(NO_ID)))


def digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def tag() -> Column:
    """What tells classes with the same smallest id apart; 0 unless rows share that id."""
    return F.when(F.col("shared"), F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")).otherwise(0)


def full_sets(texts: DataFrame) -> DataFrame:
    """doc, tag, elements (sorted 64-bit hashes) of ``texts`` (doc, shared, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for a, b in slices(texts, SLICE_BYTES):
                text, values = shingle_sets(texts[a:b])
                edges = np.searchsorted(text, np.arange(b - a + 1))
                found = [values[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pd.DataFrame(
                    {
                        "doc": batch["doc"].iloc[a:b].to_numpy(),
                        "shared": batch["shared"].iloc[a:b].to_numpy(),
                        "digest": [digest(x) for x in found],
                        "elements": [x.tobytes() for x in found],
                    }
                )

    found = texts.select("doc", "shared", "text").mapInPandas(run, "doc long, shared boolean, digest binary, elements binary")
    return found.select("doc", tag().alias("tag"), "elements")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs (a, a_tag, b, b_tag) whose sets are near, verified on the full ``sets``."""
    left = sets.toDF("a", "a_tag", "x")
    right = sets.toDF("b", "b_tag", "y")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            p, q = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            if 100 * min(len(p), len(q)) < NEAR * max(len(p), len(q)):
                out.append(False)
                continue
            both = np.sort(np.concatenate((p, q)))
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared > 0 and 100 * shared >= NEAR * (len(both) - shared))
        return pd.Series(out, dtype=bool)

    met = pairs.join(left, ["a", "a_tag"]).join(right, ["b", "b_tag"])
    return met.where(near("x", "y")).select("a", "b")


# Sets whose sizes differ more than this cannot be near.
SIZES = f"100 * least({{a}}, {{b}}) >= {NEAR} * greatest({{a}}, {{b}})"


def unsettled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (band, hash, doc, tag) of buckets with several components, with ``component``."""
    placed = rows.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc"))
    spread = placed.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return placed.join(spread.where("lo <> hi").select("band", "hash"), ["band", "hash"], "left_semi")


def regions(rows: DataFrame) -> DataFrame:
    """region, band, hash, doc, tag, component: who is to be compared with whom.

    ``rows`` (band, hash, doc, tag, component) share a region if they share a bucket, over any
    number of steps.  Its members are compared with one another once (band -1), unless
    there are fewer pairs in its buckets.
    """
    least = rows.groupBy("band", "hash").agg(F.min("doc").alias("a"))
    steps = rows.join(least, ["band", "hash"]).select("a", F.col("doc").alias("b")).where("a <> b").distinct()
    region = components(steps).select(F.col("node").alias("doc"), F.col("component").alias("region"))
    placed = written(rows.join(region, "doc"), "minhash-regions")
    buckets = placed.groupBy("region", "band", "hash").agg(F.count("*").cast("double").alias("n"))
    members = placed.select("region", "doc", "tag", "component").distinct()
    cost = buckets.groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("in_buckets"))
    sizes = members.groupBy("region").agg(F.count("*").cast("double").alias("n")).join(cost, "region")
    apart = written(sizes.where("n * n > in_buckets").select("region"), "minhash-apart")
    whole = members.join(apart, "region", "left_anti").select(
        "region", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "doc", "tag", "component"
    )
    return whole.unionByName(placed.join(apart, "region", "left_semi").select(whole.columns))


def joined_in_tile(n: np.ndarray, component: np.ndarray, sketch: np.ndarray, ids: np.ndarray, anchors, others) -> list:
    """Unions (x, y) of members whose sets are near, of ``anchors`` with later ``others``.

    ``ids``: the elements of all sets one after the other, as small numbers.
    """
    begin = np.cumsum(n) - n
    marked = np.zeros(int(ids.max(initial=0)) + 1, bool)
    label = np.unique(component, return_inverse=True)[1]
    unions = []
    same_part = anchors is others
    for k, x in enumerate(anchors):
        y = others[k + 1 :] if same_part else others
        y = y[label[y] != label[x]]
        y = y[100 * np.minimum(n[x], n[y]) >= NEAR * np.maximum(n[x], n[y])]
        y = y[(sketch[y, :GLANCE] == sketch[x, :GLANCE]).sum(1) >= (HOPELESS - 0.1) * GLANCE]
        y = y[(sketch[y] == sketch[x]).sum(1) >= HOPELESS * PLACES]
        if not len(y):
            continue
        own = ids[begin[x] : begin[x] + n[x]]
        marked[own] = True
        for a, b in slices([range(n[z]) for z in y], ELEMENTS):
            some = y[a:b]
            ends = np.cumsum(n[some])
            places = np.arange(ends[-1]) + np.repeat(begin[some] - (ends - n[some]), n[some])
            shared = np.add.reduceat(marked[ids[places]].astype(np.int64), ends - n[some])
            for z in some[100 * shared >= NEAR * (n[x] + n[some] - shared)]:
                if label[z] != label[x]:
                    unions.append((x, z))
                    label[label == label[z]] = label[x]
        marked[own] = False
    return unions


def compared(rows: DataFrame, members: DataFrame, tile: int = TILE, elements: int = ELEMENTS) -> DataFrame:
    """Links (a, b) that join members of a region's ``rows`` in different components.

    ``members``: doc, tag, n, sketch, elements.  A large region is cut into parts by number
    of members and of elements, and each two parts meet in a task.  A task returns the
    unions it makes, fewer than its components.
    """
    key = ["region", "band", "hash"]
    sized = rows.join(members.select("doc", "tag", "n"), ["doc", "tag"])
    most = F.greatest(F.count("*") / tile, F.sum("n") / elements)
    parts = sized.groupBy(*key).agg(F.greatest(F.ceil(most), F.lit(1)).cast("int").alias("parts"))
    cut = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("doc", "tag"), "parts").cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc, n, component, part = (frame[c].to_numpy() for c in ("doc", "n", "component", "part"))
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, PLACES)
        ids = np.unique(np.frombuffer(b"".join(frame["elements"]), np.uint64), return_inverse=True)[1].astype(np.int32)
        i, j = frame["i"].iat[0], frame["j"].iat[0]
        anchors = np.flatnonzero(part == i)
        others = anchors if i == j else np.flatnonzero(part == j)
        unions = joined_in_tile(n, component, sketch, ids, anchors, others)
        return pd.DataFrame([(doc[x], doc[y]) for x, y in unions], columns=["a", "b"], dtype="int64")

    return dealt.join(members, ["doc", "tag"]).groupBy(*key, "i", "j").applyInPandas(run, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    signed = written(sign(docs), "minhash-signed")
    usable = signed.where("n_shingles > 0 AND doc IS NOT NULL")
    shared = usable.groupBy("doc").count().where("count > 1").select("doc")
    shared = written(shared, "minhash-shared").withColumn("shared", F.lit(True))
    classes = usable.groupBy("digest").agg(
        F.min("doc").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    classes = written(classes.join(shared, "doc", "left").withColumn("tag", tag()).drop("shared"), "minhash-classes")
    band = classes.select("doc", "tag", "n", F.posexplode("bands").alias("band", "hash"))
    least = F.min(F.struct("doc", "tag", "n"))
    buckets = band.groupBy("band", "hash").agg(least.alias("least"), F.count("*").alias("members")).where("members > 1")
    buckets = written(
        buckets.select("band", "hash", "least.*").toDF("band", "hash", "a", "a_tag", "least_n"), "minhash-buckets"
    )
    members = written(band.join(buckets, ["band", "hash"]), "minhash-members")
    # One text for each class that shares a bucket: of its smallest id, and equal rows of that once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), utf8().alias("text"))
    asked = members.select("doc").distinct()
    once = texts.join(shared, "doc", "left_anti").join(asked, "doc", "left_semi").withColumn("shared", F.lit(False))
    again = texts.join(shared, "doc").join(asked, "doc", "left_semi").distinct()
    sets = written(full_sets(once.unionByName(again)), "minhash-sets")
    tried = members.where("a <> doc AND " + SIZES.format(a="n", b="least_n"))
    tried = tried.select("a", "a_tag", F.col("doc").alias("b"), F.col("tag").alias("b_tag")).distinct()
    links = written(similar(tried, sets), "minhash-links")
    left = written(unsettled(members.select("band", "hash", "doc", "tag"), components(links)), "minhash-unsettled")
    asked = left.select("doc", "tag").distinct()
    of_members = classes.select("doc", "tag", "n", "sketch").join(asked, ["doc", "tag"], "left_semi")
    of_members = of_members.join(sets, ["doc", "tag"])
    links = links.union(written(compared(regions(left), of_members), "minhash-links"))
    of_id = usable.join(shared.select("doc"), "doc").select(F.col("doc").alias("b"), "digest")
    tied = of_id.join(classes.select("digest", F.col("doc").alias("a")), "digest").select("a", "b")
    final = components(links.union(tied))
    by_class = classes.select("digest", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left").select(
        "digest", F.coalesce("component", "doc").alias("component")
    )
    grouped = signed.withColumn("_key", F.when(F.col("n_shingles") > 0, F.col("digest"))).join(
        written(by_class, "minhash-groups").withColumnRenamed("digest", "_key"), "_key", "left"
    )
    return grouped.select(
        "doc",
        "n_shingles",
        F.when(F.col("doc").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc")).alias("component_id"),
    )
