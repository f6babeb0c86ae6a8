"""Retrieval self-test: does a search for a post's own word bring the post back?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import text as T
from postarchive.operators.index import PART, Index, leading_parts
from postarchive.operators.search import matching_terms, query_phrases
from postarchive.session import held

# Text length and sample of the test.
MIN_LENGTH, SAMPLE = 80, 20

UNIQUE, FALLBACK, UNTESTABLE = "unique-token", "fallback", "no-token"


def sample(posts: DataFrame, size: int | None = SAMPLE, seed: int = 0) -> DataFrame:
    """Posts long enough to test; a repeatable random choice of ``size``, or all for None."""
    eligible = posts.where(F.length("full_text") > MIN_LENGTH)
    if size is None:
        return eligible
    return eligible.orderBy(F.xxhash64(S.KEY, F.lit(seed)), S.KEY).limit(size)


def prefix_posts(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase``, ``posts``: the rows of ``posts`` (terms) with a term that begins so.

    Counted inside a post by leading parts of its terms, no shorter and no longer than
    the ``phrases``, then by part: no post and no token is shuffled.
    """
    sizes = phrases.agg(F.min(F.length("phrase")), F.max(F.length("phrase"))).first()
    shortest, longest = (min(size or 1, PART) for size in sizes)
    asked = phrases.select("phrase").distinct()
    parts = leading_parts(F.col("terms"), shortest, longest)
    listed = posts.select(F.explode_outer(parts).alias("phrase")).where(F.col("phrase").isNotNull())
    found = listed.groupBy("phrase").agg(F.count("*").alias("posts")).join(
        asked.where(F.length("phrase") <= PART), "phrase", "left_semi"
    )
    if (sizes[1] or 0) <= PART:
        return found
    # Very long words, which few terms are long enough for.
    terms = posts.select(
        F.monotonically_increasing_id().alias("row"), F.filter("terms", lambda t: F.length(t) > PART).alias("terms")
    ).select("row", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    tokens = asked.where(F.length("phrase") > PART).select(F.col("phrase").alias("token"), F.lit(True).alias("is_prefix"))
    several = matching_terms(terms, tokens).groupBy(F.col("token").alias("phrase")).agg(F.count_distinct("row").alias("posts"))
    return found.unionByName(several)


def unique_tokens(posts: DataFrame, index: Index, by_post: DataFrame | None = None) -> DataFrame:
    """``tweet_id``, ``token``: the first word of each post that only this post matches.

    A word is searched as a prefix, so it must be unique as a prefix: one post has terms
    that begin so.  ``by_post`` are the index's terms by post, if they are at hand.
    """
    by_post = held(index.terms_by_post(), "self-test-terms") if by_post is None else by_post
    words = posts.select(
        S.KEY, F.posexplode_outer(T.candidate_words(F.col("full_text"))).alias("place", "raw")
    ).where(F.col("raw").isNotNull()).select(S.KEY, "place", F.lower("raw").alias("word"))
    distinct = words.select(F.col("word").alias("query_id"), F.col("word").alias("query")).distinct()
    phrases = held(
        query_phrases(distinct, index.stemmed).select(F.col("query_id").alias("word"), "phrase"), "self-test-words"
    )
    terms = by_post.where(F.col(S.KEY).isNotNull()).select(F.array_distinct(F.flatten("groups.terms")).alias("terms"))
    unique = prefix_posts(terms, phrases).where("posts = 1")
    chosen = phrases.join(unique, "phrase", "left_semi").select("word")
    return (
        words.join(chosen, "word", "left_semi")
        .groupBy(S.KEY)
        .agg(F.min_by("word", "place").alias("token"))
    )


def self_test(
    posts: DataFrame, index: Index, size: int | None = SAMPLE, seed: int = 0
) -> DataFrame:
    """One row per tested post: ``mode``, ``token``, ``hits``, ``found``, ``author_filter_ok``, ``ok``.

    A post without a unique word is tested by its longest word, without the author
    check.  Each different word is searched once: its posts are counted by the leading
    parts of their terms, and whether a search brings a post back is decided by that
    post's terms, so neither a frequent word nor a long ranking costs more than others.
    The terms by post, the words and the plan are written to the work folder.
    """
    tested = sample(posts, size, seed)
    by_post = held(index.terms_by_post(), "self-test-terms")
    plan = (
        tested.join(unique_tokens(tested, index, by_post), S.KEY, "left")
        .select(
            S.KEY,
            "author_handle",
            F.when(F.col("token").isNotNull(), UNIQUE)
            .when(T.distinctive_word(F.col("full_text")).isNotNull(), FALLBACK)
            .otherwise(UNTESTABLE)
            .alias("mode"),
            F.coalesce("token", T.distinctive_word(F.col("full_text"))).alias("token"),
        )
    )
    plan = held(plan, "self-test-plan")
    words = plan.where(F.col("token").isNotNull()).select(
        F.col("token").alias("query_id"), F.col("token").alias("query")
    ).distinct()
    phrases = held(query_phrases(words, index.stemmed).select(F.col("query_id").alias("token"), "phrase"), "self-test-words")
    groups = by_post.select(S.KEY, F.inline_outer("groups"))
    searched = groups.join(posts.select(S.KEY), S.KEY, "left_semi")
    hits = prefix_posts(searched, phrases).join(phrases, "phrase").select("token", F.col("posts").alias("hits"))
    own = plan.select("token", S.KEY).distinct().join(phrases, "token").join(groups, S.KEY)
    brought = F.exists("terms", lambda t: t.startswith(F.col("phrase")))
    mine = own.where(brought).select("token", S.KEY, F.lit(True).alias("found"))
    # The own author's posts are among the matches: the filter brings the post back if
    # its author is the one asked for.
    authors = posts.select(S.KEY, F.col("author_handle").alias("shown_author"))
    found = F.coalesce("found", F.lit(False))
    author_ok = F.when(
        (F.col("mode") == UNIQUE) & F.col("author_handle").isNotNull(),
        found & (F.col("shown_author") == F.col("author_handle")),
    )
    return (
        plan.join(hits, "token", "left").join(mine, ["token", S.KEY], "left").join(authors, S.KEY, "left")
        .select(
            S.KEY, "mode", "token",
            F.coalesce("hits", F.lit(0)).alias("hits"),
            found.alias("found"),
            author_ok.alias("author_filter_ok"),
            (found & F.coalesce(author_ok, F.lit(True))).alias("ok"),
        )
    )
