"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words.  A document of a source whose target is ``r``
times its size takes ``floor(r)`` whole copies for certain; the fraction left is
its inclusion probability ``p``.  Documents are ranked by their random odds over
their inclusion odds, ``u/(1-u) / (p/(1-p))``, and the front of the ranking that
comes nearest to the words still missing is taken: a sample of fixed size, here
counted in words because the targets are.

No source is ranked in one task.  Ranks fall into :data:`BINS` equal bins of
``q/(1+q)``; the words of a bin are summed with partial aggregates, and only the
rows of the one bin where a source reaches its target are put in order.  ``u``
comes from a hash of the id, so every run takes the same documents.

Defined cases: NULL text has no words; NULL source is a source of its own;
documents without words take none; rows repeating a document are ranked side by
side (ties by size) and sampled as rows; an empty table gives an empty mix.
Sources are settings of a mix: their table (a row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postarchive.llm.common import WORD, written

BINS = 1 << 14
SEED = "mix"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """source, source_size, weight: sources by code point, NULL last, weigh ``cycle`` in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    return sizes.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), place))


def source_targets(weighted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size, weight.

    ``share`` of all words is dealt out by weight; what a source would get beyond
    ``most`` times its size goes to the others by weight.  With sources in order of
    cap over weight, the level ``a`` of ``target = min(cap, a * weight)`` is that of
    the first source it does not fill.
    """
    capped = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    levels = capped.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min_by(
        F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))
    ).over(everything)
    return levels.withColumn("chosen", first).select(
        "source",
        "source_size",
        F.when(
            F.col("chosen").isNull() | (F.col("chosen") * F.col("weight") > F.col("cap")), F.col("cap")
        ).otherwise(F.col("chosen") * F.col("weight")).alias("target"),
    )


def odds_rank(id_column: str, p: Column, seed: str = SEED) -> Column:
    """Random odds over inclusion odds; ``u`` is 52 bits of a hash of the id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_size, target, copies to rows that have doc_id, source, size."""
    targets = targets.withColumn(
        "certain",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)),
    ).withColumn(
        "p",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        - F.col("certain"),
    ).withColumn("missing", F.col("target") - F.col("certain") * F.col("source_size"))

    def ranked(table: DataFrame) -> DataFrame:
        t = table.withColumnRenamed("source", "_source")
        rows = sized.join(t, sized["source"].eqNullSafe(t["_source"])).drop("_source")
        rank = F.when(F.col("p") > 0, odds_rank("doc_id", F.col("p")))
        rows = rows.withColumn("rank", rank)
        return rows.withColumn("bin", F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * BINS))

    bins = ranked(targets).groupBy("source", "bin").agg(
        F.sum("size").alias("in_bin"), F.first("missing").alias("missing")
    )
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.where("bin IS NOT NULL").withColumn("upto", F.sum("in_bin").over(running))
    cuts = summed.where("upto >= missing").groupBy("source").agg(
        F.min("bin").alias("cut"),
        F.min_by(F.col("upto") - F.col("in_bin"), "bin").alias("taken_before"),
    )
    c = cuts.withColumnRenamed("source", "_source")
    full = written(
        targets.join(c, targets["source"].eqNullSafe(c["_source"]), "left").drop("_source"), "mix-cuts"
    )
    rows = ranked(full)
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    ahead = F.coalesce(
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) + F.col("taken_before")
    at_cut = rows.where("bin = cut").withColumn(
        "drawn", (ahead + F.col("size") / F.lit(2.0) <= F.col("missing")).cast("long")
    )
    # Without a cut the words missing exceed what is there by rounding alone: all are drawn.
    clear = rows.where("NOT (bin <=> cut) OR bin IS NULL").withColumn(
        "drawn",
        F.when(F.col("p") <= 0, F.lit(0))
        .when(F.col("cut").isNull(), F.lit(1))
        .otherwise((F.col("bin") < F.col("cut")).cast("int"))
        .cast("long"),
    )
    return (
        clear.unionByName(at_cut)
        .withColumn("copies", F.col("certain") + F.col("drawn"))
        .drop("certain", "p", "missing", "cut", "taken_before", "rank", "bin", "drawn")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    sized = written(docs.select("doc_id", "source", words().alias("size")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(cycled_weights(sizes)), "mix-targets")
    return mix(sized, targets)
