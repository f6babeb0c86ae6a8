"""Continuous ingest: every micro-batch of observations becomes one delta version.

A batch is keyed by stream name and batch id.  If the job dies before the commit,
the repeated batch overwrites its own unfinished folders; if it dies after, the
repeated batch finds its commit and does nothing.  Nothing is late: times are
folded by earliest and latest, content by arrival, which is batch order and,
inside a batch, ``seq``: landing, feed and position; with ``order_by="observed_at"`` by the
observed time instead, whatever the order of batches.  The archive itself is the state, so the stream keeps
none and needs no watermark.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.plans.ingest import ARRIVAL, REJECTED, STAGING, import_new_exports, write_merged
from postarchive.sources import exports, feed as feeds
from postarchive.sources.store import DELTA, ArchiveStore


class StreamIngest:
    def __init__(
        self,
        store: ArchiveStore,
        name: str,
        checkpoint: str,
        indexed: bool = True,
        as_of: datetime | None = None,
        order_by: str = ARRIVAL,
    ):
        self.store, self.name, self.checkpoint = store, name, checkpoint
        self.indexed, self.as_of, self.order_by = indexed, as_of, order_by

    def process(
        self, observations: DataFrame, batch_id: int, rejected: DataFrame | None = None
    ) -> None:
        """Merge one micro-batch, store what it sets aside and record its counters."""
        source = f"{self.name}/{batch_id}"
        if self.store.version_of(source) is not None:
            return
        as_of = self.as_of or datetime.now(timezone.utc)
        run = self.store.begin()
        staged = self.store.write(STAGING, run, observations)
        if rejected is not None:
            self.store.write(REJECTED, run, rejected)
        row = write_merged(self.store, run, staged, as_of, self.indexed, self.order_by).counts
        self.store.add_runs(
            run,
            {
                "last_sync_at": as_of.isoformat(),
                "last_sync_mode": "stream",
                "last_sync_summary": " ".join(
                    [f"batch={batch_id}"]
                    + [f"{k}={row[k]}" for k in ("seen", "added", "updated", "unchanged")]
                ),
            },
            as_of,
        )
        self.store.commit(run, DELTA, source)

    def process_feed(self, records: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch of landed feed records."""
        good, bad = feeds.split_valid(records)
        stamped = self.as_of or datetime.now(timezone.utc)
        self.process(feeds.normalise_feed(good, stamped), batch_id, bad)

    def process_exports(self, files: DataFrame, batch_id: int) -> None:
        """Import the export files of one micro-batch that no run has imported yet."""
        source = f"{self.name}/{batch_id}"
        if self.store.version_of(source) is None:
            import_new_exports(self.store, files, self.as_of or datetime.now(timezone.utc), source)

    def _start(self, rows: DataFrame, process) -> None:
        query = (
            rows.writeStream.queryName(self.name)
            .foreachBatch(process)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def run(self, observations: DataFrame) -> None:
        """Process everything available in a streaming frame of observations, then stop."""
        self._start(observations, self.process)

    def run_feed(self, path: str) -> None:
        """Process the landed feed files that are new since the last run."""
        self._start(feeds.stream_feed(self.store.spark, path), self.process_feed)


    def run_exports(self, path: str, files: int = 1) -> None:
        """Import the export files that are new since the last run, ``files`` in a version.

        Every version is a step that is kept: a job that dies goes on with the next file.
        A file that was copied or renamed is applied once.
        """
        self._start(exports.stream_export_files(self.store.spark, path, files), self.process_exports)


def batch_counters(store: ArchiveStore) -> DataFrame:
    """The counters of all stream batches so far."""
    return store.runs().where(F.col("key") == "last_sync_summary").select("ts", "value")
