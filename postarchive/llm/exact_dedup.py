"""Exact dedup against a persistent digest index.

Texts are equal if they are the same after lower-casing A-Z; SHA-256 of the normalised
text stands for it.  :class:`DigestIndex` is a Parquet table bucketed and sorted by
digest, with a partition for each arrival.  New data is aggregated by digest first, so a
text that a third of all rows hold is one row per task from there on, and deduplicated
by a sort-merge anti-join with the buckets of what came before: a bucket of the index is
read where it is joined, without a shuffle.  Digests not met before are appended as
first; those that are known, as repeats, which only carry counts.  So the text that
arrives first stays; data comes in the order of preference.

An arrival is one partition, overwritten if the same arrival is added again, and it is
compared with the arrivals before it only: a run that was lost half-way is repeated as
it is.

Defined cases: NULL text is empty and equals other empty texts.  Rows without an id are
last in preference; a group of such rows only has no id to keep, and its rows are all
kept.  Rows sharing the id that stays are all kept, as they are that document.  An empty table gives an empty
result, and an empty arrival leaves the index as it is.  Texts are hashed whole, however
long.  Other columns pass through ``decide`` unless they are named like its own.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.llm.common import written

FIRST_ID = -(1 << 63)
BUCKET_ROWS = 4_000_000  # of the index; some 200 MB
SHARE = 1_000  # a digest with more than one in so many rows is hot
ENTRIES = "digest BINARY, keep_id BIGINT, n BIGINT, first BOOLEAN, arrival INT"
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
OWN = ("digest", "keep_id", "group_size", "kept")


def digested(docs: DataFrame) -> DataFrame:
    """``docs`` with ``digest`` instead of ``text``, hashed where the text is."""
    @F.pandas_udf("binary")
    def sha256(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(t.translate(LOWER)).digest())

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("digest", sha256(text)).drop("text")


class DigestIndex:
    """The digests of all arrivals, in ``buckets`` buckets below ``path``.

    The catalogue only knows where the files are: opening the same path again, also in
    another session, finds all arrivals.  ``buckets`` is fixed when an index is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        # Makes the folder if it is not there yet.
        spark.createDataFrame([], ENTRIES).write.mode("append").partitionBy("arrival").parquet(path)
        spark.sql(
            f"CREATE TABLE {self.table} ({ENTRIES}) USING parquet PARTITIONED BY (arrival) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def entries(self) -> DataFrame:
        """digest, keep_id, n, first, arrival: a row for each digest and arrival."""
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, arrival: int) -> None:
        """Adds ``rows`` (doc_id, digest) as number ``arrival``; within it the largest id comes first."""
        grouped = rows.groupBy("digest").agg(
            F.max(F.col("doc_id").cast("long")).alias("keep_id"), F.count("*").alias("n")
        )
        # Both joins read the new rows: they are few next to the texts, and written once.
        new = written(grouped.repartition(self.buckets, "digest"), "digest-arrival")
        known = self.entries().where(F.col("first") & (F.col("arrival") < arrival)).select("digest")
        met = {"left_anti": True, "left_semi": False}
        parts = [
            new.join(known.hint("merge"), "digest", how).withColumn("first", F.lit(first)) for how, first in met.items()
        ]
        # Written before it goes into the table that it was joined with.
        entry = written(parts[0].unionByName(parts[1]), "digest-entries").repartition(self.buckets, "digest")
        entry.createOrReplaceTempView(self.table + "_new")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (arrival = {int(arrival)}) "
            f"SELECT digest, keep_id, n, first FROM {self.table}_new"
        )
        self.spark.catalog.dropTempView(self.table + "_new")

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all arrivals; aggregated inside the buckets.

        A text kept without an id (its first arrival had none) takes the first id that came later.
        """
        by_arrival = F.struct(F.when(F.col("keep_id").isNull(), 1).otherwise(0), "arrival")
        return self.entries().groupBy("digest").agg(
            F.min_by("keep_id", by_arrival).alias("keep_id"), F.sum("n").alias("group_size")
        )


def arrivals(rows: DataFrame, count: int) -> list[DataFrame]:
    """``rows`` in ``count`` ranges of doc_id, the largest ids first and missing ones last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10_000)).first()[0] or []
    key, edges = F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)), sorted(set(cuts), reverse=True)
    upper = [None, *edges]
    lower = [*edges, None]
    parts = []
    for high, low in zip(upper, lower, strict=True):
        part = rows
        if high is not None:
            part = part.where(key <= high)
        if low is not None:
            part = part.where(key > low)
        parts.append(part)
    return parts


def decide(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with keep_id, group_size and kept.

    Digests of more than one in :data:`SHARE` rows are fewer than that, so their groups
    are broadcast; the others are joined with the buckets.
    """
    groups = index.groups()
    total = index.entries().agg(F.sum("n")).first()[0] or 0
    large = groups.where((F.col("group_size") > 1) & (F.col("group_size") * SHARE > total))
    hot = written(large.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"}), "digest-hot")
    asked = rows.drop(*(c for c in OWN if c != "digest")).join(F.broadcast(hot), "digest", "left")
    cold = asked.where("hot_size IS NULL").drop("hot_id", "hot_size").join(groups.hint("merge"), "digest")
    warm = asked.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    return warm.unionByName(cold).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def buckets_for(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets of about ``bucket_rows`` digests, and one per shuffle partition at least."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // bucket_rows))


def deduplicate(docs: DataFrame, path: str, count: int = 4) -> DataFrame:
    """``docs`` without text, with digest, keep_id, group_size and kept, by an index made at ``path``.

    The documents arrive in ``count`` ranges of falling ids, so the largest id of equal texts stays.
    """
    rows = written(digested(docs.drop(*OWN)), "digests")
    index = DigestIndex(docs.sparkSession, path, buckets_for(rows))
    for number, part in enumerate(arrivals(rows.select("doc_id", "digest"), count)):
        index.add(part, number)
    return decide(rows, index)
