"""The cut of a quick sync over a stream: feeds stop at a run of known posts.

The state of a feed is its run so far, whether it has stopped, and the posts it has
shown that the archive does not hold; it lives in the state store, not in memory, and
its posts are dropped when the feed stops.  A micro-batch holds a feed's records up to
some position, the next one goes on from there, as files are landed newest first; the
split into micro-batches does not matter.  A record that arrives behind a position
that its feed has passed cannot be cut any more and comes out as late.  A task works on
one feed's records of one micro-batch, so ``maxFilesPerTrigger`` bounds what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postarchive import schema as S

TAKEN = "feed_id string, pos bigint, tweet_id string, known boolean, stops boolean, late boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeedCut(StatefulProcessor):
    def __init__(self, boundary: int):
        self.boundary = boundary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "streak bigint, upto bigint, stopped boolean")
        self.shown = handle.getMapState("shown", "tweet_id string", "pos bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, upto, stopped = self.progress.get() if self.progress.exists() else (0, -1, False)
        if stopped:
            return
        batch = pd.concat(list(rows)).sort_values("pos", kind="stable")
        out = []
        for pos, tweet_id, archived in zip(batch["pos"].tolist(), batch["tweet_id"], batch["archived"].tolist(), strict=True):
            if pos <= upto:
                out.append((key[0], pos, tweet_id, None, False, True))
                continue
            known = archived or self.shown.containsKey((tweet_id,))
            if not known:
                self.shown.updateValue((tweet_id,), (pos,))
            streak, upto = streak + 1 if known else 0, pos
            stopped = streak >= self.boundary
            out.append((key[0], pos, tweet_id, known, stopped, False))
            if stopped:
                self.shown.clear()
                break
        self.progress.update((streak, upto, stopped))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TAKEN.split(", ")])

    def close(self) -> None:
        pass


def cut_stream(feed: DataFrame, archive_keys: DataFrame, boundary: int = S.QUICK_BOUNDARY) -> DataFrame:
    """The rows that a quick sync takes of a streaming ``feed`` (feed_id, pos, tweet_id).

    ``archive_keys`` (tweet_id) is the archive as the sync began: a batch frame that stays
    the same, such as a snapshot's.  ``stops`` marks the row that ends its feed.
    """
    held = archive_keys.select("tweet_id", F.lit(True).alias("archived")).dropDuplicates(["tweet_id"])
    marked = feed.join(held, "tweet_id", "left").select(
        "feed_id", "pos", "tweet_id", F.coalesce("archived", F.lit(False)).alias("archived")
    )
    return marked.groupBy("feed_id").transformWithStateInPandas(
        FeedCut(boundary), TAKEN, "Append", "None"
    )


def run_cut(
    feed: DataFrame, archive_keys: DataFrame, path: str, checkpoint: str, boundary: int = S.QUICK_BOUNDARY
) -> DataFrame:
    """Cuts all that is available of a streaming feed, goes on where the last run ended, and
    returns all rows taken so far."""
    spark = feed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        cut_stream(feed, archive_keys, boundary).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(TAKEN).parquet(path)
