"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  Timestamps are instants that are shown and
# cut into days and months in UTC; the rest only matters for speed.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side of a join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The fold keeps ~50 values per key, so hashing pays for more than the
    # default 128 keys before the aggregate turns to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Texts may be long: bound what a Python worker is handed at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Id lists of lookups are compared with row-group statistics one by one.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the cluster's shared work folder.

    The folder is the one named by ``spark.checkpoint.dir``; without that setting a
    folder of the warehouse, which driver and executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/postarchive-work"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def held(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written to the shared work folder and read back, for a job of several steps.

    Cuts the lineage, so a lost executor does not repeat the steps before, and tells
    Catalyst the size.
    """
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def held_meanwhile(rows: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``rows`` as :func:`held`, until the block ends: what is read from them must be written by then."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, purpose)
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
