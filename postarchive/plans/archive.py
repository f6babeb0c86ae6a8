"""The read queries of an archive."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import scalars as X
from postarchive.operators import filters, guard, index as ix, lookup, projections, rollups, selftest
from postarchive.operators.search import rank, require_terms

PASS, WARN, FAIL = "pass", "warn", "fail"


@dataclass
class Archive:
    """Tables of an archive; every method returns a DataFrame and runs nothing large."""

    posts: DataFrame
    memberships: DataFrame
    folders: DataFrame
    runs: DataFrame
    index: ix.Index
    tallies: DataFrame | None = None  # kept with a stored archive, see rollups.tallies

    @property
    def spark(self) -> SparkSession:
        return self.posts.sparkSession

    def search(self, queries: DataFrame, limit: int = 25, **filters_) -> DataFrame:
        """Ranked results of all ``query_id``, ``query`` rows, with post summaries.

        Filters are ``author``, ``folder``, ``since`` and ``until``.
        """
        hits = rank(queries, self.index, limit, self._eligible(**filters_))
        found = projections.summary(self.posts).join(hits, S.KEY)
        return self._with_folders(found, hits)

    def search_one(self, query: str, limit: int = 25, **filters_) -> DataFrame:
        """Results of one query, best first; ValueError when it has no terms.

        The at most ``limit`` hits are fetched, so that their ids reach the scans
        of posts and memberships as literals.
        """
        require_terms(query)
        queries = self.spark.createDataFrame(
            pa.table({"query_id": ["q"], "query": [query]})
        )
        ranked = rank(
            queries, self.index, limit, self._eligible(**filters_), one=True
        ).drop("query_id")
        hits = ranked.toArrow()
        keys = F.col(S.KEY).isin(hits.column(S.KEY).to_pylist())
        local = self.spark.createDataFrame(hits, ranked.schema)
        found = projections.summary(self.posts.where(keys)).join(F.broadcast(local), S.KEY)
        return projections.attach_folders(
            found, local, self.memberships.where(keys), self.folders
        ).orderBy("rank")

    def _eligible(
        self,
        author: str | None = None,
        folder: str | None = None,
        since: str | None = None,
        until: str | None = None,
    ) -> DataFrame | None:
        if not (author or folder or since or until):
            return None
        return filters.select_posts(
            self.posts, self.memberships, self.folders, author, folder, since, until
        )

    def recent(
        self,
        limit: int = 25,
        days: int | None = None,
        author: str | None = None,
        folder: str | None = None,
        as_of: datetime | None = None,
        multiplicity: str = "set",
    ) -> DataFrame:
        """Newest posts by created (else first seen) time."""
        posts = self.posts
        if days:
            posts = posts.where(filters.last_days(days, as_of or datetime.now(timezone.utc)))
        posts = filters.select_posts(
            posts, self.memberships, self.folders, author, folder, multiplicity=multiplicity
        )
        shown = X.shown_at(posts)
        top = (
            projections.summary(posts.withColumn("shown_at", shown), "shown_at", "first_seen_at")
            .orderBy(F.desc_nulls_last("shown_at"), F.desc(S.KEY))
            .limit(filters.at_least_one(limit))
        )
        return self._with_folders(top, top).orderBy(
            F.desc_nulls_last("shown_at"), F.desc(S.KEY)
        )

    def get(self, references: DataFrame) -> DataFrame:
        """Posts for rows of ``ref``, with ``found`` and folder names."""
        asked = lookup.requested(references)
        picked = projections.single_post(lookup.pick(self.posts, asked))
        named = projections.attach_folders(picked, picked, self.memberships, self.folders)
        return lookup.resolve(references, named).withColumn(
            "folders", X.items(F.col("folders"))
        )

    def list_folders(self) -> DataFrame:
        return rollups.folder_counts(self.memberships, self.folders)

    def top_authors(self, limit: int = 25, min_posts: int = 2) -> DataFrame:
        return rollups.top_authors(self.posts, limit, min_posts)

    def status(self, months: int = S.MONTHS_SHOWN, authors: int = S.AUTHORS_SHOWN) -> DataFrame:
        """The status report; of a stored archive from its tallies, without a scan of the posts."""
        tallied = rollups.tallies(self.posts) if self.tallies is None else self.tallies
        return rollups.status_report(tallied, self.folders, self.runs, months, authors)

    def sql(self, statement: str, limit: int = 200) -> DataFrame:
        """A read-only statement over the views bookmarks, folders, bookmark_folders, meta."""
        views = {
            "bookmarks": self.posts,
            "folders": self.folders,
            "bookmark_folders": self.memberships,
            "meta": rollups.latest_values(self.runs),
        }
        return guard.query(self.spark, statement, views).limit(filters.at_least_one(limit))

    def integrity(self) -> DataFrame:
        return ix.integrity(self.posts, self.index.docs)

    def self_test(self, size: int | None = selftest.SAMPLE, seed: int = 0) -> DataFrame:
        return selftest.self_test(self.posts, self.index, size, seed)

    def health(self, size: int | None = selftest.SAMPLE, seed: int = 0) -> DataFrame:
        """Checks as rows of ``check``, ``state``, ``detail``."""

        def check(rows: DataFrame, name: str, state, *detail) -> DataFrame:
            return rows.select(
                F.lit(name).alias("check"), state.alias("state"),
                F.concat(*detail).alias("detail"),
            )

        def text(column: str):
            return F.col(column).cast("string")

        def passes(condition, otherwise: str):
            return F.when(condition, PASS).otherwise(otherwise)

        size_check = check(
            rollups.counts(self.posts, self.folders), "archive", F.lit(PASS),
            text("total"), F.lit(" posts ("), text("available"), F.lit(" available), "),
            text("folders"), F.lit(" folders"),
        )
        index_check = check(
            self.integrity(), "search index", passes(F.col("in_sync"), FAIL),
            F.lit("indexed="), text("indexed"), F.lit(" orphaned="), text("orphaned"),
            F.lit(" missing="), text("missing"),
        )
        tested = self.self_test(size, seed).agg(
            F.count("*").alias("tested"),
            F.count_if("found").alias("found"),
            F.count_if("ok").alias("ok"),
        )
        retrieval = check(
            tested, "retrieval",
            passes((F.col("tested") > 0) & (F.col("tested") == F.col("ok")), FAIL),
            F.lit("tested="), text("tested"), F.lit(" found="), text("found"),
            F.lit(" ok="), text("ok"),
        )
        dangling = check(
            self.memberships.join(
                self.folders, self.memberships["folder_id"] == self.folders["id"], "left_anti"
            ).agg(F.count("*").alias("n")),
            "folder links", passes(F.col("n") == 0, WARN),
            F.lit("memberships of unknown folders="), text("n"),
        )
        def last(key: str):
            newest = F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.struct("ts", "value")))
            return newest.alias(key)

        synced = self.runs.agg(last("last_sync_at"), last("last_sync_mode"))
        freshness = check(
            synced, "freshness", passes(F.col("last_sync_at").isNotNull(), WARN),
            F.lit("last sync "), F.coalesce("last_sync_at", F.lit("never")),
            F.lit(" (mode "), F.coalesce("last_sync_mode", F.lit("-")), F.lit(")"),
        )
        checks = (
            size_check.unionByName(index_check).unionByName(retrieval)
            .unionByName(dangling).unionByName(freshness)
        )
        # Failures and warnings of the checks above, in the same job.
        totals = check(
            checks.agg(
                F.count_if(F.col("state") == FAIL).alias("failures"), F.count_if(F.col("state") == WARN).alias("warnings")
            ),
            "summary",
            F.when(F.col("failures") > 0, FAIL).when(F.col("warnings") > 0, WARN).otherwise(PASS),
            F.lit("failures="), text("failures"), F.lit(" warnings="), text("warnings"),
        )
        return checks.unionByName(totals)

    def _with_folders(self, results: DataFrame, keys: DataFrame) -> DataFrame:
        return projections.attach_folders(results, keys, self.memberships, self.folders)
