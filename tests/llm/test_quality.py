"""The classifier on held-out labels of the tables, and its odd cases."""

import zlib

import numpy as np
import pytest

from postarchive.llm import quality, queries
from postarchive.llm.common import table


def test_features_by_definition():
    """Two texts give the features of each, n-grams stay inside words and their ends."""
    one, two = b"Ab cde", b"  fg\tAb "
    both, owner = quality.features([one, two])
    for i, text in enumerate((one, two)):
        alone, _ = quality.features([text])
        assert sorted(both[owner == i]) == sorted(alone)

    def n_features(words):
        grams = sum(max(0, len(w) + 2 - n + 1) for w in words for n in (3, 4, 5))
        return grams + len(words) + max(0, len(words) - 1)

    for text in (one, two, b"", b" \n", b"x", b"aaa aaa aaa"):
        assert len(quality.features([text])[0]) == n_features(text.split())
    # The same words, in whatever white space, are the same features.
    assert sorted(quality.features([b"Ab\n\ncde  "])[0]) == sorted(quality.features([one])[0])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = queries.QUERIES["op1_quality"](spark, sf_dir).toPandas()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    both = got.merge(table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    ranks = held["score"].rank().to_numpy()
    good = held["quality"].to_numpy() == 1
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.99


def test_held_out_labels_are_not_read(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality"
    )
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 9.0), (2, None, 1.0), (3, "", 1.0), (None, "good", 1.0), (1, "good words here", 2.0), (4, "bad " * 50000, 0.0)],
        "doc_id long, text string, other double",
    )
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (9, 1), (None, 0), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    by = {(r["doc_id"], r["text"] and r["text"][:4]): r["score"] for r in got}
    assert by[2, None] == by[3, ""]
    assert by[1, "good"] > by[4, "bad "]
    nothing = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def plain_training(rows, seed=7):
    """The same classifier, a document and a number at a time, in double precision."""
    rng = np.random.default_rng(seed)
    size, classes = quality.DIMENSIONS, quality.CLASSES
    vectors = rng.uniform(-1 / size, 1 / size, (quality.BUCKETS, size)).astype(np.float32).astype(float)
    output, bias = [[0.0] * size for _ in range(classes)], [0.0] * classes
    per_epoch = -(-len(rows) // quality.BATCH)
    epochs = max(quality.EPOCHS, -(-quality.LEAST_STEPS // per_epoch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), quality.BATCH):
            batch = [rows[i] for i in order[a : a + quality.BATCH]]
            rate = quality.RATE * quality.BATCH * (1 - step / (epochs * per_epoch))
            step += 1
            grads = []
            for label, ids, shares in batch:
                hidden = [sum(vectors[i][d] * s for i, s in zip(ids, shares)) for d in range(size)]
                logits = [sum(h * o for h, o in zip(hidden, output[k])) + bias[k] for k in range(classes)]
                odds = [np.exp(x - max(logits)) for x in logits]
                wrong = [(o / sum(odds) - (k == label)) / len(batch) for k, o in enumerate(odds)]
                grads.append((ids, shares, hidden, wrong))
            old = [list(o) for o in output]
            for ids, shares, hidden, wrong in grads:
                for k in range(classes):
                    bias[k] -= 0.1 * rate * wrong[k]
                    for d in range(size):
                        output[k][d] -= rate * wrong[k] * hidden[d]
                for i, s in zip(ids, shares):
                    for d in range(size):
                        vectors[i][d] -= rate * s * sum(wrong[k] * old[k][d] for k in range(classes))
    return vectors, np.array(output), np.array(bias)


def test_training_and_scores_equal_plain_loops(monkeypatch):
    """Averaged vectors, softmax and descent against loops; scores against vectors and outputs, not folded."""
    monkeypatch.setattr(quality, "BUCKETS", 64)
    monkeypatch.setattr(quality, "DIMENSIONS", 3)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "LEAST_STEPS", 100)
    monkeypatch.setattr(quality, "BATCH", 4)
    monkeypatch.setattr(quality, "SMOOTH", 1)
    texts = [(1, b"good calm words here"), (0, b"BUY now now now"), (1, b"more calm words"), (0, b"now BUY"), (1, b"x"),
             (0, b"now and now and now"), (1, b"calm and good")]
    rows = []
    for label, text in texts:
        ids, counts = np.unique(quality.features([text])[0], return_counts=True)
        rows.append((label, ids, counts.astype(np.float32) / (counts.sum() + quality.SMOOTH)))
    model = quality.train(rows)
    vectors, output, bias = plain_training(rows)
    asked = [t for _, t in texts] + [b"", b"calm now", b" \t "]
    want = []
    for text in asked:
        found = quality.features([text])[0]
        hidden = vectors[found].sum(0) / (len(found) + quality.SMOOTH) if len(found) else np.zeros(3)
        logits = output @ hidden + bias
        want.append(1 / (1 + np.exp(logits[0] - logits[1])))
    assert np.allclose(model.scores(asked), want, atol=1e-4)
    assert np.ptp(want) > 0.02
