"""Ranked keyword search for a whole batch of queries in one job.

A query is split into terms; a term's tokens form a phrase whose last token is a
prefix (``durable-obj`` finds "durable objects").  Posts matching all phrases of
a query win; only when no post does, posts matching any phrase are returned.
The ranking is BM25 over all columns.

Plan: the query tokens are matched to the vocabulary, and the terms found to the
postings.  The matching rows are shuffled once, by post.  Phrase matching, term frequencies and scores
are all computed per post in that partitioning, and each task cuts its own top k
before the k rows per query are brought together.  A frequent term is spread
over the posts that contain it, so no task holds one term or one query.

Frequent phrases add little to a score and most of the work, so they are left for last
(MaxScore).  The vocabulary tells the document frequency of each phrase, hence the most it
can add to any score.  The phrases that together can add less than a query's rarest one
are put aside, and posts are scored by the others, the essential ones.  The k-th best of
these sums is a threshold that the result cannot fall below.  If what was put aside stays
below it too, no post without an essential phrase can get into the result; posts that
cannot reach the threshold with all that is left go, but for those that may match every
phrase; for the few that remain the frequent phrases are looked up, in their posts only.
Queries for which it does not stay below are scored by all their phrases.  The result is
that of scoring everything, which is what a search does that has no stored vocabulary
(posts are dealt out by key before their texts are taken apart, and again, as frequencies,
before scores are summed: no token and no score is shuffled), or where the vocabulary tells that all sums together have no more than :data:`AT_ONCE` parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.functions import text as T
from postarchive.functions.stem import stems
from postarchive.operators.filters import at_least_one
from postarchive.operators.index import PART, Index
from postarchive.session import held

# BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Scores are rounded before they are compared, so posts with equal text tie.
SCORE_DIGITS = 6

# Scores are summed at once where they have no more parts than this; their number is known beforehand.
AT_ONCE = 200_000_000
# Scores of a task of a search without a stored index.
SCORES_AT_ONCE = 1_000_000
# Sums may differ in their last digits by the order of adding.
MARGIN = 1e-5

MATCH_ALL, MATCH_ANY = "all", "any"


def require_terms(query: str) -> None:
    """ValueError for a query without any term character."""
    if not re.search(r"[\w@#.\-]", query or ""):
        raise ValueError("empty search query")


def query_phrases(queries: DataFrame, stem: bool) -> DataFrame:
    """``query_id``, ``phrase``, ``mult``, ``n_phrases``: the phrases of every query.

    A phrase is its tokens joined by blanks.  ``mult`` counts how often the query
    repeats it; ``n_phrases`` counts the different ones, including a phrase
    without tokens, which nothing matches.  An ``author`` column of the queries
    is passed on.
    """
    extra = [c for c in ("author",) if c in queries.columns]
    terms = queries.select(
        "query_id", *extra, F.explode(T.query_terms(F.col("query"))).alias("term")
    )
    tokens = terms.select("query_id", *extra, T.tokens(F.col("term")).alias("tokens"))
    if stem:
        tokens = tokens.withColumn("tokens", stems("tokens"))
    per_query = tokens.groupBy("query_id", *extra).agg(
        F.collect_list(F.array_join("tokens", " ")).alias("phrases")
    )
    return (
        per_query.select(
            "query_id", *extra, "phrases",
            F.explode(F.array_distinct("phrases")).alias("phrase"),
        )
        .select(
            "query_id", *extra, "phrase",
            F.size(F.filter("phrases", lambda p: p == F.col("phrase"))).alias("mult"),
            F.size(F.array_distinct("phrases")).alias("n_phrases"),
        )
        .where(F.col("phrase") != "")
    )


def phrase_tokens(phrases: DataFrame) -> DataFrame:
    """``phrase``, ``n_tokens``, ``offset``, ``token``, ``is_prefix`` of different phrases."""
    split = phrases.select("phrase").distinct().select(
        "phrase", F.split("phrase", " ").alias("tokens")
    )
    return split.select(
        "phrase", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("offset", "token")
    ).withColumn("is_prefix", F.col("offset") == F.col("n_tokens") - 1)


def tokens_of(phrases: DataFrame) -> list[str]:
    """The different tokens of the phrases of one query, fetched."""
    rows = phrases.select(F.explode(F.split("phrase", " ")).alias("token")).distinct().collect()
    return sorted(r["token"] for r in rows)


def matching_terms(terms: DataFrame, tokens: DataFrame, longest: int = PART) -> DataFrame:
    """Rows of ``terms`` with each ``token`` that matches the term.

    ``tokens`` has ``token`` and ``is_prefix``.  Each term is repeated for its leading
    parts up to :data:`~postarchive.operators.index.PART` letters, or ``longest`` where no
    token is longer, which makes prefix matching an equi-join.  Postings are repeated only
    for the few tokens of queries, which come to them; else it is the vocabulary.
    """
    most = F.lit(min(longest, PART))
    sizes = F.sequence(F.lit(1), F.greatest(F.least(F.length("term"), most), F.lit(1)))
    parts = terms.select("*", F.explode_outer(sizes).alias("part_size")).withColumn(
        "part", F.col("term").substr(F.lit(1), F.col("part_size"))
    )
    asked = tokens.select("token", "is_prefix", F.substring("token", 1, PART).alias("head")).distinct()
    fits = F.when(F.col("is_prefix"), F.col("term").startswith(F.col("token"))).otherwise(F.col("term") == F.col("token"))
    return parts.join(asked, (F.col("part") == F.col("head")) & fits).drop("part", "part_size", "head")


def phrase_frequencies(
    index: Index,
    phrases: DataFrame,
    pushed: list[str] | None = None,
    posts: DataFrame | None = None,
    words_only: bool = False,
) -> DataFrame:
    """``tweet_id``, ``dl``, ``phrase``, ``tf``: occurrences of each phrase in each post.

    The vocabulary is matched first.  The postings of matching terms are shuffled once,
    by post.  One-token phrases add up the frequencies of their terms; for longer ones
    the postings of a post are laid side by side, and neighbours are matched to the word
    pairs of the phrases.  ``pushed``, the tokens of a single query, reach the scan of a
    stored index as literal prefixes and skip its files.  With ``posts`` (tweet_id) only
    the postings of these are shuffled.  ``words_only`` says that all phrases are of one token.
    """
    tokens = phrase_tokens(phrases)
    terms = matching_terms(index.terms(), tokens)
    rows = index.rows_of(terms.select("term").distinct(), pushed)
    if posts is not None:
        rows = rows.join(posts.select(S.KEY), S.KEY, "left_semi")
    rows = rows.repartition(S.KEY)

    single = tokens.where(F.col("n_tokens") == 1).select(F.col("token").alias("phrase")).distinct()
    word_terms = terms.where("is_prefix").join(single, F.col("token") == F.col("phrase"), "left_semi")
    words = (
        rows.groupBy(S.KEY, "dl", "term").agg(F.count("*").alias("n"))
        .join(word_terms.select("term", F.col("token").alias("phrase")).distinct(), "term")
        .groupBy(S.KEY, "dl", "phrase").agg(F.sum("n").alias("tf"))
    )

    if words_only:
        return words

    along = Window.partitionBy(S.KEY, "col").orderBy("pos")
    pairs = (
        rows.withColumn("next_pos", F.lead("pos").over(along))
        .withColumn("next_term", F.lead("term").over(along))
        .where(F.col("next_pos") == F.col("pos") + 1)
    )
    after = tokens.where("offset > 0").select(
        "phrase", (F.col("offset") - 1).alias("offset"), F.col("token").alias("second"),
        F.col("is_prefix").alias("cut"),
    )
    wanted = (
        tokens.select("phrase", "n_tokens", "offset", F.col("token").alias("first"))
        .join(after, ["phrase", "offset"])
        .join(terms, (F.col("second") == F.col("token")) & (F.col("cut") == F.col("is_prefix")))
        .select("phrase", "n_tokens", "offset", "first", F.col("term").alias("second_term"))
    )
    occurrences = (
        pairs.join(wanted, (F.col("term") == F.col("first")) & (F.col("next_term") == F.col("second_term")))
        .groupBy(
            S.KEY, "dl", "col", "phrase", "n_tokens", (F.col("pos") - F.col("offset")).alias("start")
        )
        .agg(F.count("*").alias("n_pairs"))
        .where(F.col("n_pairs") == F.col("n_tokens") - 1)
    )
    several = occurrences.groupBy(S.KEY, "dl", "phrase").agg(F.count("*").alias("tf"))
    return words.unionByName(several)


def computed_frequencies(rows: DataFrame, phrases: DataFrame, words_only: bool = False) -> DataFrame:
    """What :func:`phrase_frequencies` tells, for an index that has no stored vocabulary.

    ``rows`` are postings, best those of :meth:`Index.dealt`.  Tokens meet the phrases
    where they are: leading parts of a token, or of a token's neighbour, are looked up
    among the tokens of the queries, which do not grow with the posts.
    """
    tokens = phrase_tokens(phrases)
    longest = tokens.agg(F.max(F.length("token"))).first()[0] or 1
    alone = tokens.where("n_tokens = 1")
    words = (
        matching_terms(rows.select(S.KEY, "dl", "term"), alone, longest)
        .groupBy(S.KEY, "dl", F.col("token").alias("phrase")).agg(F.count("*").alias("tf"))
    )
    if words_only:
        return words
    along = Window.partitionBy(S.KEY, "col").orderBy("pos")
    after = tokens.where("offset > 0").select(
        "phrase", (F.col("offset") - 1).alias("offset"), F.col("token").alias("second"), "is_prefix"
    )
    wanted = tokens.select("phrase", "n_tokens", "offset", F.col("token").alias("first")).join(after, ["phrase", "offset"])
    pairs = (
        rows.withColumn("next_pos", F.lead("pos").over(along)).withColumn("next_term", F.lead("term").over(along))
        .where(F.col("next_pos") == F.col("pos") + 1)
        .join(wanted.select(F.col("first").alias("term")).distinct(), "term", "left_semi")
        .select(S.KEY, "dl", "col", "pos", F.col("term").alias("before"), F.col("next_term").alias("term"))
    )
    seconds = wanted.select(F.col("second").alias("token"), "is_prefix")
    found = matching_terms(pairs, seconds, longest).join(
        wanted.withColumnRenamed("is_prefix", "cut"),
        (F.col("before") == F.col("first")) & (F.col("token") == F.col("second")) & (F.col("is_prefix") == F.col("cut")),
    )
    start = (F.col("pos") - F.col("offset")).alias("start")
    several = (
        found.groupBy(S.KEY, "dl", "col", "phrase", "n_tokens", start).agg(F.count("*").alias("n_pairs"))
        .where(F.col("n_pairs") == F.col("n_tokens") - 1)
        .groupBy(S.KEY, "dl", "phrase").agg(F.count("*").alias("tf"))
    )
    return words.unionByName(several)


def idf(df: Column, n_docs: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def bm25(tf: Column, dl: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_length))


def statistics(index: Index, phrases: DataFrame, pushed: list[str] | None) -> tuple[DataFrame, DataFrame | None]:
    """``phrase``, ``df`` of the phrases that some post has, and frequencies already found.

    The vocabulary knows the frequencies of single tokens.  Phrases of several tokens, or
    of a very long one, are looked up in the postings.
    """
    looked_up = F.col("phrase").contains(" ") | (F.length("phrase") > PART)
    known = index.vocabulary.select(F.col("part").alias("phrase"), F.col("posts").alias("df"))
    single = phrases.where(~looked_up).select("phrase").distinct().join(known, "phrase")
    several = phrases.where(looked_up)
    if several.isEmpty():
        return single, None
    found = held(phrase_frequencies(index, several, pushed), "search-phrases-found")
    return single.unionByName(found.groupBy("phrase").agg(F.count("*").alias("df"))), found


def rank(
    queries: DataFrame,
    index: Index,
    k: int = 25,
    eligible: DataFrame | None = None,
    one: bool = False,
) -> DataFrame:
    """``query_id``, ``rank``, ``tweet_id``, ``score``, ``match_mode``.

    ``queries`` has ``query_id`` and ``query``, and may have ``author``, a handle
    that restricts that query alone.  ``eligible`` (``tweet_id``, and
    ``author_handle`` for author queries) restricts the posts of all queries.
    Restrictions play a part in the choice between all and any, but not in the
    term statistics.  ``one`` says that there is one query; its tokens are fetched and
    reach the scan.  Thresholds and candidates are computed at once and written to the
    work folder; the last step is left to the result.
    """
    per_author = "author" in queries.columns
    k = at_least_one(k)
    corpus = index.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean_length")).first()
    n_docs, mean_length = F.lit(corpus["n"]), F.lit(corpus["mean_length"])
    phrases = held(query_phrases(queries, index.stemmed), "search-phrases")
    pushed = tokens_of(phrases) if one else None
    if index.stored is None:
        words_only = phrases.where(F.col("phrase").contains(" ")).isEmpty()
        rows = index.dealt(corpus["n"])
        found = held(computed_frequencies(rows, phrases, words_only), "search-phrases-found")
        frequencies = found.groupBy("phrase").agg(F.count("*").alias("df"))
    else:
        frequencies, found = statistics(index, phrases, pushed)
    weight = F.col("mult") * idf(F.col("df"), n_docs)
    of_query = Window.partitionBy("query_id")
    least_first = of_query.orderBy("weight", F.desc("df"), "phrase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = (
        phrases.join(frequencies, "phrase")
        .withColumn("weight", weight)
        .withColumn("most", F.col("weight") * (K1 + 1))
        .withColumn("essential", F.sum("most").over(least_first) >= F.max("weight").over(of_query))
    )
    asked = held(asked, "search-asked")
    if index.stored is None or (asked.agg(F.sum("df")).first()[0] or 0) <= AT_ONCE:
        asked = asked.withColumn("essential", F.lit(True))
    facts = None
    if eligible is not None:
        facts = eligible.select(S.KEY, *(["author_handle"] if per_author else []))

    def occurrences(of: DataFrame, posts: DataFrame | None = None) -> DataFrame:
        """Frequencies of the phrases of ``of``: those already found, and the others."""
        wanted = of.select("phrase").distinct()
        if found is None:
            return phrase_frequencies(index, wanted, pushed, posts, words_only=True)
        if index.stored is None:
            # All of a post in one task, in so many that the scores of one are few.
            scores = corpus["n"] * (asked.agg(F.count_distinct("query_id")).first()[0] or 1)
            tasks = max(found.sparkSession.sparkContext.defaultParallelism, -(-scores // SCORES_AT_ONCE))
            return found.join(wanted, "phrase", "left_semi").repartition(tasks, S.KEY)
        known = found.select("phrase").distinct()
        words = wanted.join(known, "phrase", "left_anti")
        rest = phrase_frequencies(index, words, pushed, posts, words_only=True)
        return rest.unionByName(found.join(wanted, "phrase", "left_semi"))

    def added(tf: DataFrame, of: DataFrame, *keys: str, own: Column | None = None) -> DataFrame:
        """``query_id``, ``tweet_id``, ``sum``, ``n``: what the phrases of ``of`` add, and their number."""
        matches = tf.join(of, [*keys, "phrase"])
        if own is not None:
            matches = matches.where(own)
        part = F.col("weight") * bm25(F.col("tf"), F.col("dl"), mean_length)
        return matches.groupBy("query_id", S.KEY).agg(F.sum(part).alias("sum"), F.count("*").alias("n"))

    def matched(of: DataFrame) -> DataFrame:
        tf = occurrences(of)
        if facts is not None:
            tf = tf.join(facts, S.KEY, "inner" if per_author else "left_semi")
        if not per_author:
            return added(tf, of)
        handle, wanted = F.col("author_handle"), F.col("author")
        own = wanted.isNull() | (handle == wanted) | (handle == F.ltrim(wanted, F.lit("@")))
        return added(tf, of, own=own)

    essential, others = asked.where("essential"), asked.where("NOT essential")

    def with_threshold() -> DataFrame:
        """Sums of the posts that can get into the result; frequent phrases are looked up for few."""
        sums = held(matched(essential), "search-sums")
        order = Window.partitionBy("query_id").orderBy(F.desc("sum"))
        best = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        kth = best.where(F.col("place") == k).select("query_id", (F.col("sum") - MARGIN).alias("threshold"))
        plan = asked.groupBy("query_id").agg(
            F.max("n_phrases").alias("n_phrases"), F.count_if("essential").alias("n_essential"),
            F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("left"),
        ).join(kth, "query_id", "left")
        # Where nothing was put aside, the sums are the scores.
        proven = (F.col("left") == 0) | F.coalesce(F.col("left") < F.col("threshold"), F.lit(False))
        plan = held(plan.withColumn("proven", proven), "search-plan")
        may_reach = F.col("threshold").isNull() | (F.col("sum") + F.col("left") >= F.col("threshold"))
        candidates = sums.join(plan.where("proven"), "query_id")
        scored = candidates.where(may_reach | (F.col("n") == F.col("n_essential"))).select(
            "query_id", S.KEY, "sum", "n", "n_phrases"
        )
        if not others.join(plan.where("proven"), "query_id", "left_semi").isEmpty():
            scored = held(scored, "search-candidates")
            tf = occurrences(others, scored.select(S.KEY).distinct())
            asked_of = scored.select("query_id", S.KEY).join(others.select("query_id", "phrase", "weight"), "query_id")
            more = added(tf, asked_of, S.KEY).withColumnsRenamed({"sum": "more", "n": "n_more"})
            scored = scored.join(more, ["query_id", S.KEY], "left").select(
                "query_id", S.KEY, (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"),
                (F.col("n") + F.coalesce("n_more", F.lit(0))).alias("n"), "n_phrases",
            )
        rest = plan.where("NOT proven")
        if not rest.isEmpty():
            whole = matched(asked.join(rest.select("query_id"), "query_id", "left_semi"))
            scored = scored.unionByName(whole.join(rest.select("query_id", "n_phrases"), "query_id"))
        return scored

    if others.isEmpty():
        scored = matched(asked).join(asked.groupBy("query_id").agg(F.max("n_phrases").alias("n_phrases")), "query_id")
    else:
        scored = with_threshold()
    scored = scored.select(
        "query_id", S.KEY, F.round("sum", SCORE_DIGITS).alias("score"),
        (F.col("n") == F.col("n_phrases")).alias("all_matched"),
    )
    # Posts matching all phrases sort first, so the top k hold one if any exists
    # and the choice between all and any can be made among k rows per query.
    best_first = Window.partitionBy("query_id").orderBy(
        F.desc("all_matched"), F.desc("score"), S.KEY
    )
    top = scored.withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= k
    )
    any_full = F.max("all_matched").over(Window.partitionBy("query_id"))
    return (
        top.withColumn("any_full", any_full)
        .where(F.col("all_matched") | ~F.col("any_full"))
        .select(
            "query_id", "rank", S.KEY, "score",
            F.when(F.col("all_matched"), MATCH_ALL).otherwise(MATCH_ANY).alias("match_mode"),
        )
    )
