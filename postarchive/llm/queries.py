"""The registered queries of the operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.llm import (
    chat,
    contamination,
    exact_dedup,
    filter_audit,
    minhash,
    mixing,
    multi_index,
    quality,
    suffix_family,
    superkmers,
    token_counts,
    warc,
    whitening,
)
from postarchive.llm.common import table
from postarchive.session import configure, shared_dir

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.summary(warc.read(spark, folder))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_family.digests(suffix_family.mark(docs))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = contamination.scan_documents(docs, table(spark, sf_dir, "benchmark"))
    found = F.col("contamination")
    return scanned.select(
        "doc_id",
        found.n_words.alias("n_words"),
        found.n_hit.alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (found.n_hit > 0).alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.read_vocabulary(vocabulary))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op9_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return superkmers.digests(superkmers.mark(docs))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A text full of what templates use as marks.
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(chat.read_conversations(chat.expand(asked.unionByName(hostile))))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.deduplicate(docs, shared_dir(spark, "digest-index"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def _configured(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


QUERIES = {
    query.__name__: _configured(query)
    for query in (
        op1_quality, op2_warc, op3_mixing, op4_multi_index, op5_suffix_family, op6_contamination,
        op7_token_counts, op8_minhash, op9_superkmers, op10_chat, op11_filter_audit, op12_exact_dedup,
        op13_whitening,
    )
}
