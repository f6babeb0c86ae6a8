r"""WARC archives: writing, and reading by verified record boundaries.

:func:`write` makes one response record of a page, or a revisit record of a page
whose payload an earlier page has; files come from Spark's text sink, whose line
separator is the blank lines that end a record.

:func:`read` splits files into blocks.  A task looks for the magic of a record in
its block and emits, for each place that parses as a header, where the next record
must begin.  The magic may stand in a payload too, so such links are candidates
only.  Within a block they are followed to the first place beyond it; over blocks,
pointer jumping from the start of each file keeps the places that the chain of true
records reaches.  Tasks then read the records of a block from its first true one.

Defined cases: a NULL payload is empty; pages without an id or address lack those
headers' values; rows repeating a page with the smallest id are responses each; an
empty table makes an archive without records; other columns are ignored.  A chain
that a damaged record breaks ends there.  Files are read with pyarrow's file
systems and are not compressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.llm.common import written

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BLANK = b"\r\n\r\n"

READ_AHEAD = 1 << 16  # a first try; longer headers are read on to their end
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 8 << 20

RECORD = (
    "path string, offset long, record_type string, record_id string, refers_to string, "
    "target_uri string, digest string, declared_bytes long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 40 bits are ten hexadecimal or eight base32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, first: pages whose payload a page with a smaller id has."""
    hashed = pages.select("page_id", "digest", "bytes").where(F.col("bytes") >= least_bytes)
    groups = hashed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return (
        hashed.join(groups.where("n > 1 AND first IS NOT NULL"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", "first")
        .distinct()
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to the folder ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    prepared = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"),
        payload.alias("html"),
        base32_sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    # Written first: Catalyst then knows its size and broadcasts it only if it is small.
    again = written(revisits(prepared, least_bytes), "warc-revisits").select(
        F.col("page_id").alias("_page_id"), F.col("digest").alias("_digest"), "first"
    )
    rows = prepared.join(
        again,
        prepared["page_id"].eqNullSafe(again["_page_id"]) & (prepared["digest"] == again["_digest"]),
        "left",
    )
    is_revisit = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(
            is_revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first"))
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", RECORD_END).text(path)


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at ``at`` and where its block begins; None if there is none."""
    end = data.find(BLANK, at)
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", ""), re.ASCII):
        return None
    return fields, end + 4


def whole_headers(file, size: int) -> bytes:
    """The next ``size`` bytes of ``file`` and as many more as the headers that begin there have."""
    data, step = file.read(size + READ_AHEAD), READ_AHEAD
    last = data.rfind(MAGIC, 0, size + len(MAGIC) - 1)
    while last >= 0 and data.find(BLANK, last) < 0:
        lines = data[last + len(MAGIC) :].split(b"\r\n")
        if any(b":" not in line for line in lines[:-1]):
            break  # no header, nor any before it that has no blank line yet
        more = file.read(step)
        if not more:
            break
        data, step = data + more, 2 * step
    return data


def links(data: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, first place at or after ``end`` on its chain) of the candidates in [start, end).

    ``data`` begins at ``start`` and is of :func:`whole_headers`.  Candidates before the
    same blank line share their last lines, so these are looked at once for all of them.
    A chain that meets no candidate inside the block leads nowhere and is dropped.
    """
    onward: dict[int, int] = {}
    at = data.find(MAGIC)
    while 0 <= at < end - start and (blank := data.find(BLANK, at)) >= 0:
        begins = []
        while 0 <= at < min(end - start, blank + 1):
            begins.append(at + len(MAGIC))
            at = data.find(MAGIC, at + 1)
        line, length, last = blank, None, -1  # the last length, and where its line begins
        for field in reversed(data[begins[0] : blank].split(b"\r\n")):
            line -= len(field)
            name, colon, value = field.partition(b":")
            if not colon:
                break
            if length is None and name.strip().lower() == b"content-length":
                length, last = value.strip(), line
            line -= 2
        else:
            line = -1
        if length is not None and re.fullmatch(rb"[0-9]{1,18}", length):
            to = start + blank + len(BLANK) + int(length) + len(RECORD_END)
            # The lines after ``line`` are fields; a header has them only, and a length.
            onward |= {start + x - len(MAGIC): to for x in begins if line < x <= last}
    leaves: dict[int, int] = {}
    for offset in sorted(onward, reverse=True):
        to = onward[offset]
        if to >= end:
            leaves[offset] = to
        elif to in leaves:
            leaves[offset] = leaves[to]
    return sorted(leaves.items())


def open_file(path: str):
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def records(path: str, entry: int, end: int) -> Iterator[tuple]:
    """Records that begin in [entry, end), read one after the other from a true one."""
    with open_file(path) as file:
        size, at = file.size(), entry
        while at < min(end, size):
            file.seek(at)
            found = parse_header(whole_headers(file, 1), 0)
            if found is None:
                return
            fields, begin = found
            length = int(fields["content-length"])
            file.seek(at + begin)
            block = file.read(length + len(RECORD_END))
            if len(block) < length:
                return
            http, _, payload = block[:length].partition(b"\r\n\r\n")
            declared = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
            yield (
                path,
                at,
                fields.get("warc-type"),
                fields.get("warc-record-id"),
                fields.get("warc-refers-to"),
                fields.get("warc-target-uri"),
                fields.get("warc-payload-digest"),
                int(declared[1]) if declared else None,
                payload,
            )
            at += begin + length + len(RECORD_END)


def entries(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, entry: for each block that a true record begins in, the first such record."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = F.lit(block_bytes)
    blocks = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size)).alias("start")
    )
    n, longest = blocks.groupBy("path").count().agg(F.sum("count"), F.max("count")).first()
    tasks = min(n or 1, 4 * spark.sparkContext.defaultParallelism)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length, start in zip(batch["path"], batch["length"], batch["start"], strict=True):
                end = min(start + block_bytes, length)
                with open_file(name) as file:
                    file.seek(start)
                    data = whole_headers(file, end - start)
                found = links(data, start, end)
                yield pd.DataFrame({"path": name, "offset": [x[0] for x in found], "to": [x[1] for x in found]})

    candidates = written(
        blocks.repartition(tasks, "path", "start").mapInPandas(find, "path string, offset long, to long"),
        "warc-links",
    )
    reached = files.select("path", F.lit(0).cast("long").alias("offset"))
    # Only the start of a file and places where a chain leaves a block can be entered.
    doors = candidates.select("path", F.col("to").alias("offset")).union(reached).distinct()
    jump = candidates.join(doors, ["path", "offset"], "left_semi")
    for _ in range(int(longest or 0).bit_length()):
        reached = written(
            reached.union(reached.join(jump, ["path", "offset"]).select("path", "to")).distinct(), "warc-reached"
        )
        step = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(step, ["path", "to"]).select("path", "offset", F.col("further").alias("to")), "warc-jump")
    return files.join(reached, "path").where("offset < length").select("path", F.col("offset").alias("entry"))


def read(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The true records of all files in ``path``; columns as in :data:`RECORD`."""
    starts = written(entries(spark, path, block_bytes), "warc-entries")
    tasks = 4 * spark.sparkContext.defaultParallelism
    names = [field.split()[0] for field in RECORD.split(", ")]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, entry in zip(batch["path"], batch["entry"], strict=True):
                rows, size = [], 0
                for row in records(name, entry, (entry // block_bytes + 1) * block_bytes):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str | bytes))
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return starts.repartition(tasks, "path", "entry").mapInPandas(take, RECORD)


def summary(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records of :func:`write`."""
    full = F.col("record_type") != "revisit"

    def page(column: str) -> Column:
        return F.regexp_extract(F.col(column), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    return found.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload")))
        .otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
