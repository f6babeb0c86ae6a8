"""What several operators share: tables, written steps and the two word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.session import shared_dir

# ASCII white space parts words; the pattern is for Spark's and DuckDB's SQL,
# and bytes.split() of Python parts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read from there.

    Cuts the lineage, survives lost executors, and tells Catalyst the size, so
    that it broadcasts the table only if it is below the session's threshold.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Stands for a missing id on the way through pandas, which would turn ids into floats.
NO_ID = -(1 << 63)


def utf8(name: str = "text"):
    """A text column as bytes; NULL counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def slices(texts, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` bytes each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
