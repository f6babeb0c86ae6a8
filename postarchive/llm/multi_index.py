"""Embedding near-dedup with an inverted multi-index.

Vectors with the same label are linked if their cosine is ``NEAR`` or more.

* Codebooks for the two halves of a unit vector are fitted by k-means on at most
  ``SAMPLE`` vectors.  A vector's home is the cell of its nearest codewords in the
  grid of both codebooks.
* A vector visits the cells in order of the sum of its squared distances to their
  codewords (the multi-sequence order), up to a surplus over its home.  The surplus
  is fitted on the sample: partners at exactly ``NEAR`` must be met with probability
  ``RECALL`` by either of the two alone.
* Rows meet by label and cell.  Cells with many rows are cut into tiles, members by
  visitors, so no task holds a hot cell.  In a tile cosines are taken in double
  precision.  A pair met from both sides is counted by one: by the visitor with the
  smaller id, or by the other if the smaller one does not visit the larger one's home.
* Tiles return no pairs, only each vector's links and its local component.

Equal vectors with one label are one row throughout, with their number.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components, and
those without label or id, link with nothing.  Vectors of different lengths are not
compared.  An id is one node: the links of all its rows count for each.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import written
from postarchive.llm.components import components, forest

NEAR = 0.98
RECALL = 0.99
SAMPLE = 20_000
PER_CELL = 40
MAX_WORDS = 1024
TILE = 1024
SEED = 11


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def distances(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances; the same for a vector whatever others are in the array."""
    out = np.empty((len(half), len(book)))
    for k, word in enumerate(book):
        out[:, k] = ((half - word) ** 2).sum(1)
    return out


def codebook(half: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = half[rng.choice(len(half), min(words, len(half)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (-2 * half @ book.T + (book**2).sum(1)).argmin(1)
        count = np.bincount(nearest, minlength=len(book))
        total = np.stack([np.bincount(nearest, half[:, d], len(book)) for d in range(half.shape[1])], 1)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    surplus: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def excess(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By codeword: squared distance beyond that of the nearest, for either half."""
        a = distances(units[:, : self.half], self.first)
        b = distances(units[:, self.half :], self.second)
        return a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)

    def homes(self, units: np.ndarray) -> np.ndarray:
        a, b = self.excess(units)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells that one vector with these excesses visits, its home included.

        Both sequences are walked in order: for each codeword of the first half all of
        the second that keep the sum within the surplus.
        """
        one, two = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        one = one[: np.searchsorted(a[one], self.surplus, side="right")]
        depth = np.searchsorted(b[two], self.surplus - a[one], side="right")
        ends = np.cumsum(depth)
        step = np.arange(ends[-1]) - np.repeat(ends - depth, depth)
        return np.repeat(one * len(self.second), depth) + two[step]


def fit(sample: np.ndarray, total: int, near: float = NEAR, recall: float = RECALL) -> MultiIndex:
    """Codebooks sized for ``total`` vectors, and the surplus that meets ``recall``."""
    rng = np.random.default_rng(SEED)
    units = unit(sample)
    half = units.shape[1] // 2
    words = int(min(MAX_WORDS, max(4, (total / PER_CELL) ** 0.5)))
    index = MultiIndex(codebook(units[:, :half], words, rng), codebook(units[:, half:], words, rng), 0.0)
    noise = rng.standard_normal(units.shape)
    noise -= (noise * units).sum(1, keepdims=True) * units
    noise /= np.maximum(np.sqrt((noise**2).sum(1, keepdims=True)), 1e-12)
    homes = index.homes(near * units + (1 - near**2) ** 0.5 * noise)
    a, b = index.excess(units)
    each = np.arange(len(units))
    needed = a[each, homes // len(index.second)] + b[each, homes % len(index.second)]
    index.surplus = float(np.quantile(needed, recall)) if len(needed) else 0.0
    return index


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding of rows that can be linked."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return (
        rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .where(F.forall("embedding", lambda x: x.isNotNull()))
        .where(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists("embedding", lambda x: x != 0))
    )


ROUTED = "vec_id long, copies long, vector binary, label string, length int, cell long, visitor boolean"
LINKED = "node long, links long, root long"


def route(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """Each vector at home, and as a visitor in the other cells it visits."""
    sent = classes.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_WORDS codewords
    width = 2 * index.half

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                vectors = padded(part["embedding"], width)
                a, b = own.excess(unit(vectors))
                home = a.argmin(1) * len(own.second) + b.argmin(1)
                cells = [own.visits(x, y) for x, y in zip(a, b, strict=True)]
                each = np.repeat(np.arange(len(part)), [len(c) for c in cells])
                cell = np.concatenate(cells)
                packed = np.array([v.tobytes() for v in vectors], object)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy()[each],
                        "copies": part["copies"].to_numpy()[each],
                        "vector": packed[each],
                        "label": part["label"].to_numpy()[each],
                        "length": part["length"].to_numpy()[each],
                        "cell": cell,
                        "visitor": cell != home[each],
                    }
                )

    return classes.mapInPandas(run, ROUTED)


def padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float32)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def link(routed: DataFrame, index: MultiIndex, near: float = NEAR, tile: int = TILE) -> DataFrame:
    """node, links, root by tile: what its cosines show; to be summed and united."""
    place = ["label", "length", "cell"]
    counts = routed.groupBy(*place).agg(
        F.count(F.when(~F.col("visitor"), 1)).alias("members"), F.count("*").alias("rows")
    )
    large = counts.where(F.col("rows") > 2 * tile).select(
        *place,
        F.ceil(F.greatest("members", F.lit(1)) / tile).cast("int").alias("down"),
        F.ceil(F.col("rows") / tile).cast("int").alias("across"),
    )
    large = written(large, "index-large")
    cut = routed.join(large, place, "left").withColumn("down", F.coalesce("down", F.lit(1))).withColumn(
        "across", F.coalesce("across", F.lit(1))
    )
    spot = F.xxhash64("vec_id")
    all_down, all_across = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("down", "across"))
    own_down, own_across = F.pmod(spot, F.col("down")).cast("int"), F.pmod(spot, F.col("across")).cast("int")
    # Members stand in every tile of their row, visitors in every tile of their column;
    # in a cut cell the members visit each other too.
    stand = cut.where("NOT visitor").select("*", own_down.alias("i"), F.explode(all_across).alias("j"))
    visit = cut.where("visitor OR across > 1").withColumn("visitor", F.lit(True))
    visit = visit.select("*", F.explode(all_down).alias("i"), own_across.alias("j"))
    sent = routed.sparkSession.sparkContext.broadcast(index)
    width = 2 * index.half

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, here = sent.value, int(frame["cell"].iat[0])
        visitor = frame["visitor"].to_numpy()
        units = unit(np.frombuffer(b"".join(frame["vector"]), np.float32).reshape(-1, width))
        ids, copies = frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
        members = np.flatnonzero(~visitor)
        guests = np.flatnonzero(visitor) if frame["across"].iat[0] > 1 else np.arange(len(frame))
        links: dict[int, int] = {}
        pairs: list[tuple[int, int]] = []
        if len(members) and len(guests):
            a, b = own.excess(units[members])
            home = own.homes(units[guests])
            for start in range(0, len(guests), 1024):
                some = guests[start : start + 1024]
                x, y = np.nonzero(units[some] @ units[members].T >= near)
                came = home[start + x]
                asked = a[y, came // len(own.second)] + b[y, came % len(own.second)] <= own.surplus
                p, q = some[x], members[y]
                counted = (ids[p] != ids[q]) & ((ids[p] < ids[q]) | ((came != here) & ~asked))
                p, q = p[counted], q[counted]
                for one, two in ((p, q), (q, p)):
                    nodes, spot_ = np.unique(ids[one], return_inverse=True)
                    for node, n in zip(nodes.tolist(), np.bincount(spot_, copies[two]).tolist(), strict=True):
                        links[node] = links.get(node, 0) + int(n)
                pairs += zip(ids[p].tolist(), ids[q].tolist(), strict=True)
        roots = forest(pairs)
        return pd.DataFrame(
            [(node, n, roots[node]) for node, n in links.items()], columns=["node", "links", "root"], dtype="int64"
        )

    return stand.unionByName(visit).groupBy(*place, "i", "j").applyInPandas(run, LINKED)


def near_duplicates(embeddings: DataFrame, near: float = NEAR, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``embeddings`` (vec_id, embedding, label)."""
    rows = usable(embeddings)
    classes = written(
        rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")),
        "index-classes",
    )
    total, longest = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return embeddings.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
        )
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    index = fit(padded(sample["embedding"], longest + longest % 2), total, near, recall)
    sent = classes.select(
        "vec_id", "copies", F.col("label").cast("string").alias("label"), F.size("embedding").alias("length"), "embedding"
    )
    tasks = max(1, min(sent.sparkSession.sparkContext.defaultParallelism * 4, total // 500))
    routed = written(route(sent.repartition(tasks, "vec_id"), index), "index-routed")
    found = written(link(routed, index, near), "index-links")
    united = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(
        united.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left"
    )
    by_class = classes.join(linked, classes["vec_id"] == linked["node"], "left").select(
        classes["label"], classes["embedding"], F.col("copies"), F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", classes["vec_id"]).alias("component"),
    )
    done = rows.join(by_class, ["label", "embedding"]).select(
        F.col("vec_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id")
    )
    # Rows sharing an id are one node.
    done = done.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    all_ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    return all_ids.join(done, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
