"""The pipeline's stages against plain versions, each on the input it really gets."""

import re

import corpus_pipeline
import pytest

from postarchive.llm import quality
from postarchive.llm.common import table, written
from tests.llm import brute
from tests.llm.test_near import want_groups
from tests.llm.test_texts import want_scan, want_targets

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before and after each stage."""
    docs = table(spark, SF_DIR, "documents")
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "test-pipeline")
        found.append((docs.columns, docs.collect()))
    return [found[0], *(rows for _, rows in found[1:])], [columns for columns, _ in found[1:]]


def test_columns(kept):
    assert all(c == COLUMNS for c in kept[1][:-1])
    assert kept[1][-1][:5] == COLUMNS


def test_quality_drops_what_the_model_rejects(spark, kept):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = quality.fit(docs, labels)
    before, after = kept[0][0], kept[0][1]
    scores = model.scores([brute.raw(r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s >= 0.7)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(truth.get(d) == 1 for d in gone) <= 0.01 * len(before)
    assert sum(truth.get(d) == 0 for d in gone) >= 0.9 * sum(q == 0 for d, q in truth.items())


def test_one_document_of_each_group_stays(kept):
    before, after = kept[0][1], kept[0][2]
    groups = want_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, c in groups if d == c)


def test_repeated_passages_go(kept):
    before, after = sorted(kept[0][2]), {r["doc_id"]: r for r in kept[0][3]}
    want = brute.removed_words([(r["doc_id"], r["text"]) for r in before], 20)
    assert len(after) == len(before)
    for r, (_, gone, sha) in zip(before, want):
        now = after[r["doc_id"]]
        if gone:
            assert brute.sha(brute.raw(now["text"])) == sha and now["n_chars"] == len(now["text"])
        else:
            assert now == r


def test_contaminated_documents_go(spark, kept):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    before, after = kept[0][3], kept[0][4]
    windows = set()
    for _, text in items:
        words = [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(brute.raw(text)))]
        windows |= {b" ".join(words[i : i + 10]) for i in range(max(1, len(words) - 9) if words else 0)}

    def clean(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(brute.raw(text)))
        own = {b" ".join(words[i : i + n]) for n in {len(w.split()) for w in windows} for i in range(len(words) - n + 1)}
        return not own & windows

    assert sorted(after) == sorted(r for r in before if clean(r["text"]))
    assert want_scan(items[0][1], items)[1] > 0


def test_mix(kept):
    before, after = kept[0][4], kept[0][5]
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", brute.raw(t)))
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    target = want_targets(sizes)
    for s in sizes:
        taken = sum(r["size"] for r in after if r["source"] == s)
        assert abs(taken - target[s]) <= max(size(r["text"]) for r in before if r["source"] == s) / 2
    rows = {}
    for r in after:
        rows.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in rows.values())


def test_odd_documents(spark):
    rows = [(None, "text without id", "en", None, 3), (1, None, None, "a", None), (2, "", "en", "a", 0)]
    rows += [(3, "word " * 3000, "en", "b", 1), (4, "some good words here", "de", None, 2)] * 2
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, size int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        docs = written(stage(spark, docs, SF_DIR), "test-pipeline")
        assert docs.columns[:5] == COLUMNS
