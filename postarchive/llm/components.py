"""Connected components by union-find in tasks and min-label rounds between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import written


def forest(edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its component, by union-find with path halving."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = parent.setdefault(x, x)
        while root != parent[root]:
            parent[root] = parent[parent[root]]
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges as stars: each node with the smallest of its local component."""
    for batch in batches:
        roots = forest(zip(batch["a"].tolist(), batch["b"].tolist(), strict=True))
        rows = [(x, root) for x, root in roots.items() if x != root]
        yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of ``edges`` (a, b long).

    Each batch of edges is first contracted to stars by union-find.  Then rounds of
    two steps repeat until nothing changes: every node's neighbours are tied to its
    smallest neighbour (larger ones, then smaller ones), which halves the depth of
    the trees.  A hub with very many neighbours is only aggregated with partial sums
    and joined, never gathered.
    """
    stars = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = written(stars.mapInPandas(_local, "a long, b long").distinct(), "components")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = tied.union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(step, "components")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
