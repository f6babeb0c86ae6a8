"""The keyword index: tokens of seven text columns as relational tables.

``postings(term, tweet_id, col, pos, dl, bucket)`` has one row per token.  ``dl``, the
token count of the whole post, rides along so that scoring needs no join with
the document lengths.  ``docs(tweet_id, dl)`` has one row per post, also for
posts without tokens.  ``vocabulary(part, posts, term_posts)`` has a row for every
leading part of every term: the posts with a term that begins so, and the posts with
the part itself as a term.  A search takes its terms and the document frequencies of
its prefixes from there, so it knows before it reads any postings which of them are
frequent.  Counts add up: a delta stores what its posts have now with a plus and what
they had before with a minus, and reading sums them.

Stored postings are partitioned by bucket, a hash of a term's first letters, so all
terms that begin with a token of two letters or more share a bucket.  A batch of
queries reads the buckets of its terms only, by dynamic partition pruning.  Inside, they
are sorted by term and post: a file covers a short range of terms, so a search for a
few terms skips all other files by their statistics, and a term that makes up much of
the text is cut into many files by post.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import parts, postings as made, text as T
from postarchive.functions.stem import stem as stemmed, stems
from postarchive.session import held_meanwhile

POSTINGS = "term string, tweet_id string, col int, pos int, dl bigint, bucket int"
DOCS = "tweet_id string, dl bigint"
VOCABULARY = "part string, posts bigint, term_posts bigint"
# Leading parts of terms are listed up to this length, whole terms of any.
PART = 32
BUCKETS = 64
BUCKET_LETTERS = 2
# Posts of a task that keeps all tokens of its posts together.
POSTS_AT_ONCE = 4096


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, BUCKET_LETTERS)), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """``postings`` are the live rows.  A stored index also has ``stored``, all rows with
    their bucket, and under deltas ``newest`` (tweet_id, newest): the version whose rows count.
    An index computed from posts knows them as ``source``.
    """

    postings: DataFrame
    docs: DataFrame
    stemmed: bool
    vocabulary: DataFrame
    stored: DataFrame | None = None
    newest: DataFrame | None = None
    source: DataFrame | None = None

    def dealt(self, n_posts: int) -> DataFrame:
        """The postings, of an index computed from posts with all of a post in one task.

        The posts are dealt out before they are taken apart: a shuffle of texts instead
        of tokens, after which nothing that is grouped by post moves again.
        """
        if self.source is None:
            return self.postings
        tasks = max(self.source.sparkSession.sparkContext.defaultParallelism, -(-n_posts // POSTS_AT_ONCE))
        return tokenise(self.source.repartition(tasks, S.KEY), self.stemmed)

    @property
    def corpus(self) -> Column:
        """``n``, the number of posts, and ``mean_length``, as one scalar subquery."""
        return self.docs.agg(
            F.struct(F.count("*").alias("n"), F.avg("dl").alias("mean_length"))
        ).scalar()

    def terms_by_post(self) -> DataFrame:
        """``tweet_id``, ``groups`` (dl, terms): the different terms of each post, a row a post.

        Rows of one post are one group if they have the same length.
        """
        if self.source is None:
            rows = self.postings.groupBy(S.KEY, "dl").agg(F.collect_set("term").alias("terms"))
        else:
            every = F.flatten(F.transform("cols", lambda c: c["tokens"]))
            rows = _tokenised(self.source, self.stemmed).select(S.KEY, "dl", F.array_distinct(every).alias("terms"))
        posts = rows.groupBy(S.KEY).agg(F.collect_list(F.struct("dl", "terms")).alias("all"))

        def group(dl: Column) -> Column:
            same = F.transform(F.filter("all", lambda row: row["dl"] == dl), lambda row: row["terms"])
            return F.struct(dl.alias("dl"), F.array_distinct(F.flatten(same)).alias("terms"))

        return posts.select(S.KEY, F.transform(F.array_distinct("all.dl"), group).alias("groups"))

    def terms(self) -> DataFrame:
        """``term``, each once."""
        if self.stored is None:
            return self.postings.select("term").distinct()
        return self.vocabulary.where("term_posts > 0").select(F.col("part").alias("term"))

    def rows_of(self, terms: DataFrame, pushed: list[str] | None = None) -> DataFrame:
        """The live postings of ``terms``.

        Of a stored index only the terms' buckets are read; they are at most
        :data:`BUCKETS`, so their list is broadcast.  Rows that a later version replaced
        are looked for among the terms' rows only.  ``pushed``, the tokens of a single
        query, reach the scan as literal prefixes.
        """
        if self.stored is None:
            return self.postings.join(terms.select("term"), "term", "left_semi")
        rows = self.stored
        if pushed:
            rows = rows.where(reduce(Column.__or__, [F.col("term").startswith(token) for token in pushed]))
        buckets = terms.select(bucket_of("term").alias("bucket")).distinct()
        found = rows.join(F.broadcast(buckets), "bucket", "left_semi").join(terms.select("term"), "term", "left_semi")
        return live(found, self.newest).select("term", S.KEY, "col", "pos", "dl")


def live(rows: DataFrame, newest: DataFrame | None) -> DataFrame:
    """``rows`` (tweet_id, version, ...) that no later version has replaced."""
    if newest is None:
        return rows
    current = F.col("newest").isNull() | (F.col("newest") == F.col("version"))
    return rows.join(newest, S.KEY, "left").where(current).drop("newest")


def searchable(posts: DataFrame) -> DataFrame:
    """Key and the indexed text columns; links become one text."""
    links = F.array_join(F.filter("links", lambda u: u.isNotNull() & (u != "")), " ")
    return posts.select(
        S.KEY, *[links.alias(c) if c == "links_text" else F.col(c) for c in S.SEARCH_COLUMNS]
    )


def _tokenised(posts: DataFrame, stem: bool = False) -> DataFrame:
    """Per post: ``cols``, the non-empty columns with their tokens, and ``dl``.

    Tokens are stemmed where they stand, an array a post: Python works on the different
    words of a batch, and no token is shuffled to meet its stem.
    """
    cols = F.array(
        *[
            F.struct(F.lit(i).alias("col"), T.tokens(F.col(name)).alias("tokens"))
            for i, name in enumerate(S.SEARCH_COLUMNS)
        ]
    )
    filled = searchable(posts).select(
        S.KEY, F.filter(cols, lambda c: F.size(c["tokens"]) > 0).alias("cols")
    )
    length = F.aggregate(
        "cols", F.lit(0).cast("bigint"), lambda total, c: total + F.size(c["tokens"])
    )
    if not stem:
        return filled.withColumn("dl", length)
    every = filled.withColumn("every", stems(F.flatten(F.transform("cols", lambda c: c["tokens"]))))

    def own(c: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("cols", F.lit(1), i), F.lit(0), lambda n, earlier: n + F.size(earlier["tokens"]))
        return F.struct(c["col"].alias("col"), F.slice("every", before + 1, F.size(c["tokens"])).alias("tokens"))

    return every.select(S.KEY, F.transform("cols", own).alias("cols"), length.alias("dl"))


def doc_lengths(posts: DataFrame) -> DataFrame:
    return _tokenised(posts).select(S.KEY, "dl")


def stem_table(terms: DataFrame) -> DataFrame:
    """``term``, ``stem`` of the different ``terms``; only they go through Python."""
    return terms.select("term").distinct().select("term", stemmed("term").alias("stem"))


def tokenise(posts: DataFrame, stem: bool) -> DataFrame:
    """Postings of the given posts.

    The outer forms of the generators keep the optimiser from adding a filter on
    the array size below them, which would tokenise every text a second time.
    """
    return _postings(_tokenised(posts, stem))


def _postings(rows: DataFrame) -> DataFrame:
    columns = rows.select(S.KEY, "dl", F.inline_outer("cols"))
    return (
        columns.select(S.KEY, "dl", "col", F.posexplode_outer("tokens").alias("pos", "term"))
        .where(F.col("term").isNotNull())
        .select("term", S.KEY, "col", "pos", "dl")
    )


def post_terms(posts: DataFrame, stem: bool) -> DataFrame:
    """``tweet_id``, ``terms``: the different terms of each post."""
    every = F.flatten(F.transform("cols", lambda c: c["tokens"]))
    distinct = _tokenised(posts).select(S.KEY, F.array_distinct(every).alias("terms"))
    if not stem:
        return distinct
    # Rows of one post count once; their arrays of terms meet, not the terms.
    own = distinct.withColumn("terms", stems("terms")).groupBy(S.KEY).agg(F.collect_list("terms").alias("terms"))
    return own.select(S.KEY, F.array_distinct(F.flatten("terms")).alias("terms"))


def leading_parts(terms: Column, shortest: int, longest: int) -> Column:
    """The different leading parts of ``terms`` from ``shortest`` to ``longest`` letters."""

    def parts(term: Column) -> Column:
        sizes = F.sequence(F.lit(shortest), F.least(F.length(term), F.lit(longest)))
        return F.transform(sizes, lambda size: F.substring(term, F.lit(1), size))

    return F.array_distinct(F.flatten(F.transform(F.filter(terms, lambda t: F.length(t) >= shortest), parts)))


def part_counts(per_post: DataFrame, sign: int = 1) -> DataFrame:
    """Vocabulary rows of ``per_post`` (tweet_id, terms): counted by task, then by part."""
    counted = per_post.select("terms").mapInArrow(parts.counts(PART), VOCABULARY)
    return summed(counted.select("part", *[(F.col(c) * sign).alias(c) for c in ("posts", "term_posts")]))


def summed(rows: DataFrame) -> DataFrame:
    """Vocabulary rows added up, parts that no post has any more left out."""
    total = rows.groupBy("part").agg(F.sum("posts").alias("posts"), F.sum("term_posts").alias("term_posts"))
    return total.where("posts <> 0 OR term_posts <> 0")


def vocabulary(posts: DataFrame, stem: bool) -> DataFrame:
    return part_counts(post_terms(posts, stem))


def build_index(posts: DataFrame, stem: bool = True) -> Index:
    """An index that is computed from the posts whenever it is used."""
    return Index(tokenise(posts, stem), doc_lengths(posts), stem, vocabulary(posts, stem), source=posts)


def write_postings(postings: DataFrame, path: str) -> None:
    """Store postings by bucket, sorted by term and post."""
    placed = postings.withColumn("bucket", bucket_of("term"))
    ordered = placed.repartitionByRange("bucket", "term", S.KEY).sortWithinPartitions(
        "bucket", "term", S.KEY, "col", "pos"
    )
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass
class IndexRows:
    """The rows of all tables of an index, made in one pass over its posts and written together."""

    rows: DataFrame

    def postings(self) -> DataFrame:
        return self._of(made.POSTING).select("term", S.KEY, "col", "pos", "dl")

    def docs(self) -> DataFrame:
        return self._of(made.DOC).select(S.KEY, "dl")

    def counts(self) -> DataFrame:
        """Vocabulary rows, which are to be added up."""
        return self._of(made.PART).select(F.col("term").alias("part"), "posts", "term_posts")

    def _of(self, kind: int) -> DataFrame:
        return self.rows.where(F.col("kind") == kind)


@contextmanager
def held_rows(posts: DataFrame, stem: bool) -> Iterator[IndexRows]:
    """The index rows of ``posts``, which have a row for each key, for as long as the block takes."""
    rows = _tokenised(posts).select(S.KEY, "cols", "dl").mapInArrow(made.rows(stem, PART, BUCKETS, BUCKET_LETTERS), made.ROWS)
    with held_meanwhile(rows, "index-rows") as written:
        yield IndexRows(written)


def counts_of(posts: DataFrame, stem: bool, sign: int = 1) -> DataFrame:
    """Vocabulary rows of ``posts``, which have a row for each key."""
    every = F.flatten(F.transform("cols", lambda c: c["tokens"]))
    return part_counts(_tokenised(posts, stem).select(S.KEY, F.array_distinct(every).alias("terms")), sign)


def write_index(posts: DataFrame, path: str, stem: bool = True) -> None:
    """Store the index of ``posts`` below ``path``, replacing what is there."""
    write_postings(tokenise(posts, stem), f"{path}/postings")
    doc_lengths(posts).write.mode("overwrite").parquet(f"{path}/docs")
    vocabulary(posts, stem).write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str, stem: bool = True) -> Index:
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return Index(
        stored.drop("bucket"),
        spark.read.schema(DOCS).parquet(f"{path}/docs"),
        stem,
        spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary"),
        stored,
    )


def refresh(index: Index, touched_posts: DataFrame) -> Index:
    """The index after the given posts changed or arrived: their rows are replaced."""
    keys = touched_posts.select(S.KEY)
    fresh = build_index(touched_posts, index.stemmed)
    gone = index.postings.join(keys, S.KEY, "left_semi").groupBy(S.KEY).agg(F.collect_set("term").alias("terms"))
    return Index(
        fresh.postings.unionByName(index.postings.join(keys, S.KEY, "left_anti")),
        fresh.docs.unionByName(index.docs.join(keys, S.KEY, "left_anti")),
        index.stemmed,
        summed(index.vocabulary.unionByName(fresh.vocabulary).unionByName(part_counts(gone, -1))),
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    """Posts per term; tokens of a post are counted together before terms meet."""
    per_post = postings.groupBy("term", S.KEY).agg(F.count("*").alias("tf"))
    return per_post.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences")
    )


def integrity(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether posts and index hold the same keys.

    One full outer join of the two key sets gives all four counts.
    """
    both = (
        posts.select(S.KEY, F.lit(True).alias("in_posts"))
        .join(docs.select(S.KEY, F.lit(True).alias("in_index")), S.KEY, "full")
    )
    return both.agg(
        F.count("in_posts").alias("bookmarks"),
        F.count("in_index").alias("indexed"),
        F.count_if(F.col("in_posts").isNull()).alias("orphaned"),
        F.count_if(F.col("in_index").isNull()).alias("missing"),
    ).withColumn(
        "in_sync",
        (F.col("bookmarks") == F.col("indexed"))
        & (F.col("orphaned") == 0)
        & (F.col("missing") == 0),
    )
