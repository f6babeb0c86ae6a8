"""Archive tables on shared storage: a base version plus small deltas.

Every run writes to folders of its own, below the version that it will be.  A version
counts once its commit file names a run; the file is created only if it is not there,
so of two runs that started from the same version the second one to end fails with
:class:`ConcurrentRun`, has overwritten nothing, and can be repeated.  (Where a store
cannot create a file exclusively, one writer at a time is up to the user.)  Readers never
see half a write.  A delta holds the full new rows of
the posts it touched.  Reading takes the base without the touched keys (an anti
join with a small key set) plus the newest delta row of each key, so a run costs
what it touches; :meth:`ArchiveStore.compact` folds deltas into a new base.

::

    root/commits/N.json                   version, run, kind, source, ts
    root/runs/                            key, value, ts, version, run     (append only)
    root/posts/version=N/run=R/           post rows
    root/membership_sets/version=N/run=R/ tweet_id, folder_ids
    root/folders/version=N/run=R/         id, name
    root/registers/version=N/run=R/       post states, where runs merge by observed time
    root/postings/version=N/run=R/        index rows by bucket, sorted by term
    root/docs/version=N/run=R/            tweet_id, dl
    root/vocabulary/version=N/run=R/      parts of terms with signed counts of posts
    root/tallies/version=N/run=R/         signed counts of posts by group
    root/imported/version=N/run=R/        digests of the export files read
    root/staging/version=N/run=R/         input of a run as it was read
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.operators import index as ix, registers, rollups
from postarchive.plans.archive import Archive

COMMITS = "version bigint, run string, kind string, source string, ts timestamp"
OF_RUN = ", version bigint, run string"
TABLES = {
    "posts": (S.POSTS, S.KEY),
    "membership_sets": ("tweet_id string, folder_ids array<string>", "tweet_id"),
    "folders": (S.FOLDERS, "id"),
    "registers": (registers.REGISTERS, S.KEY),
}
IMPORTED = "digest string, file_path string"
BASE, DELTA = "base", "delta"


class ConcurrentRun(RuntimeError):
    """Another run has committed the version that this one was to be."""


@dataclass(frozen=True)
class Run:
    """A run that has begun: the version it will be, and its own name."""

    version: int
    name: str


class ArchiveStore:
    def __init__(self, spark: SparkSession, root: str, stem: bool = True):
        self.spark, self.root, self.stem = spark, root.rstrip("/"), stem

    # --- commits ------------------------------------------------------------

    def _read(self, path: str, ddl: str) -> DataFrame:
        """A Parquet folder, or no rows while nothing was written there."""
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{path}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _append(self, name: str, rows: list[tuple], ddl: str) -> None:
        (
            self.spark.createDataFrame(rows, ddl).coalesce(1)
            .write.mode("append").parquet(f"{self.root}/{name}")
        )

    def commits(self) -> list:
        """``version``, ``run``, ``kind``, ``source`` of all commits: one small row per run."""
        try:
            found = self.spark.read.schema(COMMITS).json(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return found.where("version IS NOT NULL").select("version", "run", "kind", "source").collect()

    def begin(self) -> Run:
        """A run that follows the last commit."""
        return Run(max((c["version"] for c in self.commits()), default=-1) + 1, uuid.uuid4().hex)

    def version_of(self, source: str) -> int | None:
        """The committed version that a source, e.g. a stream batch, has produced."""
        return max((c["version"] for c in self.commits() if c["source"] == source), default=None)

    def snapshot(self) -> Snapshot:
        """The state after the last commit; later commits do not change it."""
        commits = self.commits()
        base = max((c["version"] for c in commits if c["kind"] == BASE), default=None)
        deltas = {
            c["version"] for c in commits
            if c["kind"] == DELTA and (base is None or c["version"] > base)
        }
        return Snapshot(self, base, sorted(deltas), {c["version"]: c["run"] for c in commits})

    def commit(self, run: Run, kind: str, source: str | None = None) -> None:
        """Make the run's rows count; :class:`ConcurrentRun` if another run came first."""
        record = {
            "version": run.version, "run": run.name, "kind": kind, "source": source,
            "ts": datetime.now(timezone.utc).isoformat(),
        }
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{run.version:012d}.json")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise ConcurrentRun(f"version {run.version} is another run's") from error
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    # --- writing ------------------------------------------------------------

    def path(self, table: str, run: Run) -> str:
        return f"{self.root}/{table}/version={run.version}/run={run.name}"

    def write(self, table: str, run: Run, rows: DataFrame) -> DataFrame:
        """Write one table of a run and return it as read back."""
        rows.write.mode("overwrite").parquet(self.path(table, run))
        return self.spark.read.parquet(self.path(table, run))

    def write_base(self, table: str, run: Run, rows: DataFrame) -> None:
        """Write a table range-partitioned and sorted by its key.

        Lookups by id then skip files by statistics.  Post ids grow with time, so
        files also cover short ranges of created times.
        """
        key = TABLES[table][1]
        self.write(table, run, rows.repartitionByRange(key).sortWithinPartitions(key))

    def write_index(self, run: Run, posts: DataFrame, before: DataFrame | None = None) -> None:
        """The index rows of ``posts``; of a delta, with what the vocabulary had of them ``before``.

        Keys are those of one post each.
        """
        with ix.held_rows(posts, self.stem) as made:
            ix.write_postings(made.postings(), self.path("postings", run))
            self.write("docs", run, made.docs())
            counts = made.counts()
            if before is not None:
                counts = counts.unionByName(ix.counts_of(before, self.stem, -1))
            self.write("vocabulary", run, ix.summed(counts))

    def add_runs(self, run: Run, values: dict[str, str | None], ts: datetime) -> None:
        rows = [(k, v, ts, run.version, run.name) for k, v in values.items() if v is not None]
        if rows:
            self._append("runs", rows, S.RUNS + OF_RUN)

    def compact(self) -> int:
        """Fold all deltas into a new base version."""
        return self._compacted().version

    def _compacted(self) -> Run:
        run, now = self.begin(), self.snapshot()
        self.write_base("posts", run, now.posts())
        self.write_base("membership_sets", run, now.membership_sets())
        self.write_base("folders", run, now.folders())
        self.write_base("registers", run, now.registers())
        posts = self.spark.read.parquet(self.path("posts", run))
        self.write("tallies", run, rollups.tallies(posts))
        self.write_index(run, posts)
        self.commit(run, BASE)
        return run

    def reindex(self) -> int:
        """Rebuild the index from the posts; returns the number of posts indexed.

        A new base replaces every index row, also those of posts that are gone.
        """
        return self.spark.read.parquet(self.path("docs", self._compacted())).count()

    # --- reading ------------------------------------------------------------

    def posts(self) -> DataFrame:
        return self.snapshot().posts()

    def memberships(self) -> DataFrame:
        return self.snapshot().memberships()

    def folders(self) -> DataFrame:
        return self.snapshot().folders()

    def runs(self) -> DataFrame:
        return self.snapshot().runs()

    def rejected(self, ddl: str) -> DataFrame:
        """What committed runs have set aside, with the run's ``version``.

        ``ddl`` names the columns: those of export quarantines or of rejected feed records.
        """
        rows = self._read("rejected", ddl + OF_RUN)
        return rows.where(F.col("run").isin(list(self.snapshot().runs_by_version.values()))).drop("run")

    def index(self) -> ix.Index:
        return self.snapshot().index()

    def archive(self) -> Archive:
        return self.snapshot().archive()


@dataclass
class Snapshot:
    """The tables of one committed state."""

    store: ArchiveStore
    base: int | None
    deltas: list[int]
    runs_by_version: dict[int, str]

    def _rows(self, table: str, ddl: str, versions: list[int]) -> DataFrame:
        """The given versions of a table, with their ``version``."""
        rows = self.store._read(table, ddl + OF_RUN)
        runs = [self.runs_by_version[v] for v in versions]
        return rows.where(F.col("run").isin(runs) if runs else F.lit(False)).drop("run")

    def _current(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows that count, of ``keys`` only if given: these are told apart before any row is folded."""
        ddl, key = TABLES[table]

        def wanted(rows: DataFrame) -> DataFrame:
            return rows if keys is None else rows.join(keys, key, "left_semi")

        base = wanted(self._rows(table, ddl, [] if self.base is None else [self.base]).drop("version"))
        if not self.deltas:
            return base
        changed = wanted(self._rows(table, ddl, self.deltas))
        latest = (
            changed.groupBy(key)
            .agg(F.max_by(F.struct(*base.columns), "version").alias("row"))
            .select("row.*")
        )
        if self.base is None:
            return latest
        touched = changed.select(key).distinct()
        return base.join(touched, key, "left_anti").unionByName(latest)

    def posts(self, keys: DataFrame | None = None) -> DataFrame:
        """The posts, of ``keys`` only if given."""
        return self._current("posts", keys)

    def keys(self) -> DataFrame:
        """Keys of the posts, without their rows; a key comes once for every version that has it."""
        versions = ([] if self.base is None else [self.base]) + self.deltas
        return self._rows("posts", f"{S.KEY} string", versions).select(S.KEY)

    def membership_sets(self) -> DataFrame:
        return self._current("membership_sets")

    def memberships(self) -> DataFrame:
        return self.membership_sets().select("tweet_id", F.explode("folder_ids").alias("folder_id"))

    def folders(self) -> DataFrame:
        return self._current("folders")

    def registers(self) -> DataFrame:
        return self._current("registers")

    def tallies(self) -> DataFrame:
        """Counts by group, added up over the versions.

        They tell the newest time unless a post that had it has changed; then the posts do.
        """
        versions = ([] if self.base is None else [self.base]) + self.deltas
        total = rollups.added(self._rows("tallies", rollups.TALLIES, versions))
        whole = total.where(F.col("section") == rollups.ALL).first()
        if whole is None:
            return rollups.tallies(self.posts())
        if whole["gone"] is None or whole["newest"] is not None and whole["gone"] < whole["newest"]:
            return total
        posts = self.posts()
        newest = posts.agg(F.max(X.shown_at(posts))).first()[0]
        known = F.when(F.col("section") == rollups.ALL, F.lit(newest)).otherwise(F.col("newest"))
        return total.withColumn("newest", known)

    def imported(self) -> DataFrame:
        """Digests of the export files that committed runs have read."""
        rows = self.store._read("imported", IMPORTED + OF_RUN)
        return rows.where(F.col("run").isin(list(self.runs_by_version.values()))).select("digest").distinct()

    def runs(self) -> DataFrame:
        """Run state of committed versions."""
        rows = self.store._read("runs", S.RUNS + OF_RUN)
        return rows.where(F.col("run").isin(list(self.runs_by_version.values()))).drop("version", "run")

    def index(self) -> ix.Index:
        """The stored index: a base and deltas, in which the newest rows of a post count.

        Which posts a delta has replaced is known from the document lengths, a row per
        post; searches ask for it after they have found their terms.
        """
        versions = ([] if self.base is None else [self.base]) + self.deltas
        docs = self._rows("docs", ix.DOCS, versions)
        stored = self._rows("postings", ix.POSTINGS, versions)
        vocabulary = ix.summed(self._rows("vocabulary", ix.VOCABULARY, versions))
        newest = None
        if self.deltas:
            later = docs.where(F.col("version").isin(self.deltas))
            newest = later.groupBy(S.KEY).agg(F.max("version").alias("newest"))
        return ix.Index(
            ix.live(stored, newest).drop("version", "bucket"), ix.live(docs, newest).drop("version"),
            self.store.stem, vocabulary, stored, newest,
        )

    def archive(self) -> Archive:
        return Archive(
            self.posts(), self.memberships(), self.folders(), self.runs(), self.index(), self.tallies()
        )


def write_json(results: DataFrame, path: str) -> None:
    """Any result as JSON lines, missing values written as null."""
    results.write.option("ignoreNullFields", "false").json(path)
