"""Quality classifier by supervised subword embeddings.

A document is the mean of the learned vectors of its words, pairs of neighbouring
words and the words' character n-grams (3 to 5 bytes, word ends included), all
hashed into ``BUCKETS`` rows; a softmax over the classes follows.  A pair is hashed
by the difference of its words' hashes, so any word said twice in a row is one
feature.  ``SMOOTH`` features without a vector are counted into each mean: a text of
a few words then stays near the prior.  Classes are sampled alike; their shares among
all usable labels are put back into the output bias.  Vectors and output weights are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows:
``PER_CLASS`` documents of each class at most, chosen by a hash of their ids.  The
sample's texts are read whole, as are all texts that are scored.

Averaging and the output layer are linear, so a trained model is folded to one
logit per bucket; a score is then one look-up per feature, in the task that reads
the text.  Nothing is shuffled but the sample.

Defined cases: NULL, empty or blank texts have no feature and get the score of
the output bias; labels that are NULL, held out or without a document are left
out; several labels of a document all count; with no labels at all every score is
0.5.  Other columns pass through; only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import slices, utf8

BUCKETS = 1 << 17
DIMENSIONS = 8
PER_CLASS = 1000
EPOCHS = 4
LEAST_STEPS = 240  # a small sample is gone through more often
BATCH = 32
RATE = 0.6
SLICE_BYTES = 1 << 20
THRESHOLD = 0.7
NGRAMS = (3, 4, 5)
CLASSES = 2
SMOOTH = 100

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the ids, never trained on; a missing id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of ``texts``, and the number of the text each belongs to."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    symbols = np.where(space, np.uint32(0x20), data.astype(np.uint32)) + np.uint32(1)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    found, owners = [], []
    rolling = np.zeros(len(data), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        rolling = rolling[: len(data) - n + 1] * np.uint32(0x01000193) + symbols[n - 1 :]
        if n == 2:  # a space inside an n-gram parts words; at its ends it marks them
            inner = np.zeros(max(len(data) - 2, 0), bool)
        if n > 2:
            inner = inner[: len(data) - n + 1] | space[n - 2 : len(data) - 1]
        if n in NGRAMS:
            at = np.flatnonzero(~inner)
            found.append((rolling[at] * np.uint32(0x9E3779B1)) >> shift)
            owners.append(owner[np.minimum(at, len(owner) - 1)])
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    powers = np.cumprod(np.full(len(data) + 1, np.uint32(0x01000193), np.uint32), dtype=np.uint32)
    weighted = np.concatenate(([0], np.cumsum(symbols * powers[:-1], dtype=np.uint32))).astype(np.uint32)
    inverse = np.uint32(pow(0x01000193, -1, 1 << 32))
    unshift = np.cumprod(np.full(len(data) + 1, inverse, np.uint32), dtype=np.uint32)
    word = (weighted[end] - weighted[begin]) * unshift[begin]
    of_word = owner[np.minimum(begin, len(owner) - 1)]
    found.append(((word ^ (word >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift)
    owners.append(of_word)
    pair = np.flatnonzero(of_word[1:] == of_word[:-1])
    gap = word[pair + 1] - word[pair] + np.uint32(0x27220A95)
    found.append(((gap ^ (gap >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> shift)
    owners.append(of_word[pair])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    """Logits of class 1 over class 0: one per bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts, SLICE_BYTES):
            buckets, owner = features(texts[a:b])
            total = np.bincount(owner, self.weights[buckets], minlength=b - a)
            count = np.bincount(owner, minlength=b - a)
            out[a:b] = total / (count + SMOOTH)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """``rows``: class, buckets, share of each bucket in the document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((CLASSES, DIMENSIONS), np.float32), np.zeros(CLASSES, np.float32)
    per_epoch = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch)) if rows else 0
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            batch = [rows[i] for i in order[a : a + BATCH]]
            rate = np.float32(RATE * BATCH * (1 - step / steps))
            step += 1
            owner = np.repeat(np.arange(len(batch)), [len(r[1]) for r in batch])
            ids = np.concatenate([r[1] for r in batch])
            share = np.concatenate([r[2] for r in batch])
            gathered = vectors[ids] * share[:, None]
            hidden = np.stack([np.bincount(owner, gathered[:, d], len(batch)) for d in range(DIMENSIONS)], 1)
            logits = hidden @ output.T + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            wrong = odds / odds.sum(1, keepdims=True)
            wrong[np.arange(len(batch)), [r[0] for r in batch]] -= 1
            wrong = (wrong / len(batch)).astype(np.float32)
            # A bucket's gradient is a mix of the output rows: sum the mix, then multiply once.
            mixed = np.stack([np.bincount(ids, share * wrong[owner, k], BUCKETS) for k in range(CLASSES)], 1)
            touched = np.flatnonzero(mixed.any(1))
            step_out = wrong.T @ hidden.astype(np.float32)
            vectors[touched] -= rate * (mixed[touched].astype(np.float32) @ output)
            output -= rate * step_out
            bias -= np.float32(0.1) * rate * wrong.sum(0)
    direction = output[1] - output[0]
    return Model((vectors @ direction).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labels.quality`` from at most ``per_class`` documents of each class."""
    usable = labels.select("doc_id", "quality").where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()
    )
    chosen = None
    for k in range(CLASSES):
        own = usable.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most CLASSES * per_class ids: small whatever the tables' size.
    sample = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")

    def featurise(batches):
        for batch in batches:
            out = {"doc_id": [], "quality": [], "buckets": [], "counts": []}
            for doc_id, quality, text in zip(batch["doc_id"], batch["quality"], batch["text"], strict=True):
                ids, counts = np.unique(features([text])[0], return_counts=True)
                if len(ids):
                    out["doc_id"].append(doc_id)
                    out["quality"].append(quality)
                    out["buckets"].append(ids.astype(np.uint32).tobytes())
                    out["counts"].append(counts.astype(np.uint32).tobytes())
            yield pd.DataFrame(out)

    counted = sample.mapInPandas(featurise, "doc_id long, quality int, buckets binary, counts binary")
    rows = []
    for r in sorted(counted.collect(), key=lambda r: (r["doc_id"], r["quality"], r["buckets"])):
        counts = np.frombuffer(r["counts"], np.uint32).astype(np.float32)
        rows.append((r["quality"], np.frombuffer(r["buckets"], np.uint32), counts / (counts.sum() + SMOOTH)))
    model = train(rows)
    shares = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    drawn = [sum(r[0] == k for r in rows) for k in range(CLASSES)]
    if all(drawn):
        model.bias += float(np.log(shares[1] / shares[0]) - np.log(drawn[1] / drawn[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of class 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for texts in batches:
            yield pd.Series(own.scores(list(texts)))

    marked = F.pandas_udf(run, "double")
    return docs.withColumn("score", marked(utf8()))
