"""Audit of how filters interact: what each removes at each step of each order.

Filters are failure conditions on a document; one more fails documents whose text equals
that of a document with a smaller id.  A document is known to the audit by its mask, the
set of filters it fails, so the corpus comes down to at most ``2 ** filters`` cells for
each part (a source).  A cell is folded across the array of all orders, a constant that
every task holds: ``transform`` over the orders, ``aggregate`` along the steps of one.
That makes a struct of counts for each order and step (5 filters: 600 structs), weighted
by the cell's documents; a part's cells are merged by elementwise sums.

Equal texts are found by SHA-256 and never gathered: a text's rows are first aggregated
by part, mask and labels, and only these sums meet.

Defined cases: NULL text is empty and equals other empty texts; NULL source is the part
'' together with empty ones; rows without an id count as later than all others and have
no labels; rows sharing an id are no copies of one another; of several labels of an id
any 1 counts; rows without a label are neither good nor toxic.  A table without rows has
no parts.  Texts are counted whole, however long.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postarchive.llm.common import WORD

LAST_ID = (1 << 63) - 1
SPACES = r"[\x20\x09-\x0D]+"

# Name of a filter -> failure condition, from the text, its number of words and of distinct words.
Rule = Callable[[Column, Column, Column], Column]
RULES: dict[str, Rule] = {
    "A": lambda text, words, distinct: words < 200,
    "B": lambda text, words, distinct: 100 * distinct < 50 * words,
    "C": lambda text, words, distinct: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words, distinct: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def facts(docs: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """id, part, digest and the mask of ``rules``, by document; texts are read here only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    # The ends of a text may give an empty word, no other place does.
    split = F.array_remove(F.split("text", SPACES), "")
    counted = rows.withColumn("words", split).select(
        "id", "part", "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct")
    )
    bits = [
        F.when(rule(F.col("text"), F.col("n"), F.col("distinct")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())
    ]
    mask = sum(bits, F.lit(0))
    return counted.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    labelled = rows.join(flags, "id", "left").select("id", "part", "digest", "mask", *known)
    group = ("digest", "part", "mask", "good", "toxic")
    ids = labelled.groupBy("id", *group).agg(F.count("*").alias("n"))
    ids = ids.withColumn("key", F.coalesce("id", F.lit(LAST_ID)))
    # Of a text, by part, mask and labels: its rows, its smallest id, and the rows of that.
    texts = ids.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min("key").alias("least"), F.min_by("n", "key").alias("of_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least") == first, F.col("of_least")).otherwise(F.lit(0))
    split = texts.withColumn("firsts", firsts).select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("firsts").alias("n")),
                F.struct(F.col("mask").bitwiseOR(F.lit(duplicate_bit)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
            )
        ).alias("cell"),
    )
    n = F.col("cell.n")
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def folded(orders: Column) -> Column:
    """A cell's counts for each step of each order, as one array."""
    n, zero = F.col("n"), F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        here = fails & ~state["gone"]
        counts = F.struct(
            F.when(fails | state["gone"], zero).otherwise(n).alias("kept"),
            F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & state["gone"], n).otherwise(zero).alias("redundant"),
            F.when(F.col("mask") == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, F.col("good")).otherwise(zero).alias("good_lost"),
            F.when(here, F.col("toxic")).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((fails | state["gone"]).alias("gone"), F.array_append(state["steps"], counts).alias("steps"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def added(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS)))


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, duplicate: str = DUPLICATE) -> DataFrame:
    """part, filter_order, step, the counts of :data:`COUNTS` and shapley.

    One row for each part, order of the filters and step.  ``kept`` counts what is left
    after the step, ``removed`` what goes there, ``redundant`` what fails there but went
    before, ``unique_fails`` what fails this filter alone; ``good_lost`` and
    ``toxic_lost`` are the labelled among the removed.  ``shapley`` is what the filter
    removes summed over all orders, its Shapley value times their number.
    """
    names = [*rules, duplicate]
    bits = [1 << i for i in range(len(names))]
    orders = F.array(*(F.array(*map(F.lit, order)) for order in permutations(bits)))
    cell = cells(facts(docs, rules), labels, 1 << len(rules))
    merged = cell.select("part", folded(orders).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("all"))
    flat, zero = F.flatten(orders), F.lit(0).cast("long")

    def removed_by(steps: Column) -> Column:
        def total(bit: Column) -> Column:
            of_filter = F.zip_with(steps, flat, lambda s, b: F.when(b == bit, s["removed"]).otherwise(zero))
            return F.aggregate(of_filter, zero, lambda a, b: a + b)

        numbers = F.array(*map(F.lit, bits))
        return F.map_from_arrays(numbers, F.transform(numbers, total))

    def with_shapley(steps: Column) -> Column:
        # An array of one value, transformed: so the value is computed once.
        held = F.transform(
            F.array(removed_by(steps)),
            lambda totals: F.zip_with(steps, flat, lambda s, b: F.struct(*(s[c].alias(c) for c in COUNTS), totals[b].alias("shapley"))),
        )
        return F.get(held, F.lit(0))

    # A part has 2 ** len(names) cells at most, so that many arrays are merged.
    sums = F.aggregate(F.slice("all", 2, 1 << len(names)), F.get("all", F.lit(0)), added, with_shapley)
    rows = merged.select("part", F.posexplode_outer(sums).alias("at", "counts"))
    labels_of = F.array(*(F.lit("".join(order)) for order in permutations(names)))
    order = F.floor(F.col("at") / len(names)).cast("int")
    return rows.select(
        "part",
        F.get(labels_of, order).alias("filter_order"),
        (F.col("at") % len(names) + 1).cast("int").alias("step"),
        *(F.col(f"counts.{c}").alias(c) for c in (*COUNTS, "shapley")),
    )
