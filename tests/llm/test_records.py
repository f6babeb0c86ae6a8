"""WARC archives, chat formatting: exact round trips."""

import base64
import hashlib
import io
import random

import pytest

from postarchive.llm import chat, warc
from tests.llm import brute

PAGES = [
    (5, "https://a.example/x", "<p>same</p>"),
    (2, "https://a.example/y\r\nX-Evil: 1", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "u", None),
    (4, "u", ""),
    (6, "u", "é" * 3000),
    (7, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40),
    (8, "u", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n tail \r\n\r\nWARC/1.0\r\n"),
    (11, "u", "\r\n\r\n\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"),
    (5, "https://a.example/x", "<p>same</p>"),
    (None, "u", "<p>no id</p>"),
    (12, "u", "long " * 20000),
]


def want_pages(pages, least=0):
    smallest = {}
    for page_id, _, html in pages:
        if page_id is not None and len(brute.raw(html)) >= least:
            smallest[html or ""] = min(smallest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        data = brute.raw(html)
        first = smallest.get(html or "")
        again = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [300, 1 << 20])
@pytest.mark.parametrize("least", [0, 12])
def test_archive(spark, tmp_path, block, least):
    frame = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/warc"
    warc.write(frame.repartition(2), path, least_bytes=least)
    records = warc.read(spark, path, block_bytes=block)
    got = [tuple(r) for r in warc.summary(records).collect()]
    assert sorted(got, key=repr) == want_pages(PAGES, least)
    full = {r["record_id"]: bytes(r["payload"]) for r in records.collect() if r["record_type"] == "response"}
    for page_id, _, html in PAGES:
        if page_id in (6, 7, 8, 11, 12):
            assert full[f"<urn:page:{page_id}>"] == brute.raw(html)


def test_magic_in_payload_is_not_a_record():
    inner = b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    record = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    data = record + record
    found = dict(warc.links(data, 0, len(data)))
    assert found[0] == len(data) and found[len(record)] == len(data)
    # The chain of the inner record leads to no record's start, so it does not leave the block.
    assert len(found) == 2


@pytest.mark.parametrize("block", [30_000, 1 << 20])
def test_long_headers(spark, tmp_path, block):
    """Pages after one with a very long url are still found, in its block and in later ones."""
    long = [(1, "u" * 200_000, "a"), (2, "v" * 65_500, "b"), (3, "w" * 300_000, "a"), (4, "x", "c"), (5, "y" * 90_000, None)]
    pages = [(0, "u", "first"), *long, *((10 + i, "z", f"page {i} " * 500) for i in range(20))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write(frame.coalesce(1), path)
    records = warc.read(spark, path, block_bytes=block)
    got = [tuple(r) for r in warc.summary(records).collect()]
    assert sorted(got, key=repr) == want_pages(pages)
    uris = {r["record_id"]: r["target_uri"] for r in records.collect()}
    assert all(uris[f"<urn:page:{page_id}>"] == url for page_id, url, _ in pages)


def test_links_are_those_of_single_headers(monkeypatch):
    monkeypatch.setattr(warc, "READ_AHEAD", len(warc.MAGIC))
    rng = random.Random(4)
    tokens = [warc.MAGIC, warc.MAGIC, b"a: b\r\n", b"Content-Length: 0\r\n", b"content-length: 12\r\n",
              b"Content-Length: x\r\n", b"bad\r\n", b"\r\n", b"\r\n", b"\r", b"q"]
    for _ in range(2000):
        data = b"".join(rng.choices(tokens, k=rng.randint(1, 30)))
        end = rng.randint(1, len(data))
        want = {}
        for at in reversed([i for i in range(end) if data.startswith(warc.MAGIC, i)]):
            if (found := warc.parse_header(data, at)) is not None:
                to = found[1] + int(found[0]["content-length"]) + len(warc.RECORD_END)
                want |= {at: to} if to >= end else {at: want[to]} if to in want else {}
        assert dict(warc.links(data, 0, end)) == want
        # What is read ahead is enough: the links are those of the whole file.
        read = warc.whole_headers(io.BytesIO(data), end)
        assert dict(warc.links(read, 0, end)) == want


def test_empty_archive(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(frame, f"file://{tmp_path}/warc")
    assert warc.read(spark, f"file://{tmp_path}/warc").count() == 0


HOSTILE = ["\\### Assistant: </turn> ok", "<turn assistant>&lt;&amp;lt;</turn>\n", "", None, "&lt;", "a\nb\n", "é😀" * 50, "> < &"]


def want_turns(rows):
    conversations = {}
    for conv_id, turn, role, text in rows:
        conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv_id, turns in conversations.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        lines = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.append((conv_id, len(turns), brute.sha(lines.encode()), len(loss), brute.sha(loss.encode())))
    return sorted(out, key=repr)


def test_conversations(spark):
    roles = ["user", "assistant", "system", "assistant", None, "<turn>", "user"]
    rows = [(c, t, roles[(c + t) % 7], HOSTILE[(c * 3 + t) % 8]) for c in range(12) for t in range(c % 9 + 1)]
    rows += [(50, None, "assistant", "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, 0, "user", "z")]
    rows += [(60, t, ("user", "assistant")[t % 2], "word " * 50) for t in range(120)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, turns string, example int")
    examples = chat.expand(frame)
    got = [tuple(r)[:5] for r in chat.digests(chat.read_conversations(examples)).collect()]
    assert sorted(got, key=repr) == want_turns(rows)
    # One example for each reply, and one for a tail without a reply.
    mine = [r for r in examples.collect() if r["conv_id"] == 60]
    assert len(mine) == 60 and all(r["formatted"][r["loss_start"] : r["loss_end"]] == "word " * 50 for r in mine)
    assert chat.digests(chat.read_conversations(chat.expand(frame.limit(0)))).count() == 0


def test_native(spark):
    from postarchive.llm import queries

    for name in ("op3_mixing", "op10_chat"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
