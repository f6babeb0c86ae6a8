"""A training-data pipeline in five stages, each over all that the one before kept.

Every stage is written as Parquet and read again, so a lost executor costs at most
the stage at work.  Stages return the columns of ``documents``; the last adds those of
the mix.  Columns beyond these are dropped.  Rows without ``doc_id``, with NULL or
empty text, and repeated rows follow the rule of each operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.llm import contamination, minhash, mixing, quality, superkmers
from postarchive.llm.common import table, written
from postarchive.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones among them."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    docs = docs.select(*COLUMNS)
    gone = minhash.groups(docs).where("doc <> component_id").select("doc").distinct()
    return docs.join(written(gone, "pipeline-gone"), F.col("doc_id") == F.col("doc"), "left_anti")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows met before cover; texts without such stay as they are."""
    cut = superkmers.remove(superkmers.mark(docs.select(*COLUMNS)))
    changed = F.col("kept.n_removed") > 0
    text = F.when(changed, F.col("kept.text").cast("string")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in."""
    scanned = contamination.scan_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return scanned.where("contamination.n_hit = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken, with its number, and its source's figures."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.words())
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(mixing.source_targets(mixing.cycled_weights(sizes)), "pipeline-targets")
    taken = mixing.mix(sized, targets).where("copies > 0 AND size > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select(*COLUMNS, "size", "source_size", "target", copies.alias("copy"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _configured(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _configured(good_quality)),
    ("MinHash near-dedup", _configured(one_of_each_group)),
    ("substring dedup", _configured(without_repeated_passages)),
    ("benchmark decontamination", _configured(uncontaminated)),
    ("mixing sources", _configured(mixed)),
]

# The classifier is trained; SQL cannot express that.  tests/llm holds the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs
