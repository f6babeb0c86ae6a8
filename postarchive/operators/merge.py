"""Merging observations into the archive without losing content.

The merge is an order-dependent fold over the observations of a post, written
as one grouped aggregate.  The archived row, if any, takes part as the first
observation (``_archived``).  ``seq`` may be a number or a struct, such as landing, feed
and position.  Because every function has a map-side partial, a
post observed millions of times reaches the reducer as one row per map task.

Rules
-----
* Content: the last non-empty value by ``seq`` wins; empty is NULL, ``''`` or an
  empty array, 0 is a value.  A made-up ``/i/status/`` address never replaces a
  real one.
* Status: the last one given; the first observation defaults to available.
* Reason: set by an unavailable observation that carries one, cleared by an
  available one; an available post never keeps a reason.
* Origin: the set of all origins, joined by ``+``.
* ``first_seen_at``/``last_seen_at`` are the earliest/latest of all, whatever
  the order; ``content_updated_at`` the latest, else the time the first content
  was seen.

One row per post is returned with its *net* outcome; ``n_observations`` tells
how many observations were folded into it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive import schema as S

ORIGIN_SEPARATOR = "+"


def nonempty(name: str) -> str:
    """SQL condition that a column holds a value."""
    kind = S.POST_TYPES[name]
    if kind == "string":
        return f"{name} <> ''"
    if kind.startswith("array"):
        return f"size({name}) > 0"
    return f"{name} IS NOT NULL"


def last(value: str, condition: str, alias: str) -> str:
    """The value of the last row for which ``condition`` holds, NULL included."""
    return f"max_by({value}, _order) FILTER (WHERE {condition}) AS {alias}"


def fold(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Fold observations to one row per post.

    ``rows`` has the columns of ``OBSERVATIONS``, and ``_archived`` where archived rows
    are among them.  The result has the post
    columns plus ``n_observations`` and ``_prior``, the archived row as a struct
    (NULL for a new post).
    """
    content = [last(c, nonempty(c), c) for c in S.CONTENT if c != "url"]
    made_up = f"url = concat('{S.URL_WITHOUT_HANDLE}', {S.KEY})"
    has_content = f"({nonempty('full_text')} OR {nonempty('media')})"
    gone = f"status = '{S.UNAVAILABLE}'"
    back = f"status = '{S.AVAILABLE}'"
    aggregates = [
        *content,
        last("url", f"url <> '' AND NOT {made_up}", "_real_url"),
        last("url", made_up, "_made_up_url"),
        last("status", nonempty("status"), "_status"),
        last(
            f"CASE WHEN {gone} THEN unavailable_reason END",
            f"{back} OR ({gone} AND {nonempty('unavailable_reason')})",
            "_reason",
        ),
        f"flatten(collect_set(split(origin, '[+]')) FILTER (WHERE {nonempty('origin')})) AS _origins",
        f"min_by(coalesce({nonempty('origin')}, false), _order) AS _origin_known",
        "min_by(coalesce(first_seen_at, _observed), _order) AS _first_row_seen",
        "min(first_seen_at) AS _first_seen",
        "max(_observed) AS last_seen_at",
        "max(content_updated_at) AS _updated",
        "min(_order) FILTER (WHERE content_updated_at IS NOT NULL) AS _updated_seq",
        f"min(_order) FILTER (WHERE {has_content}) AS _content_seq",
        f"min_by(_observed, _order) FILTER (WHERE {has_content}) AS _content_seen",
        "count_if(NOT _archived) AS n_observations",
        f"max_by(struct({', '.join(S.POST_COLUMNS)}), _order) FILTER (WHERE _archived) AS _prior",
    ]
    observed = F.coalesce("last_seen_at", F.lit(as_of))
    if "_archived" not in rows.columns:
        rows = rows.withColumn("_archived", F.lit(False))
    order = F.struct((~F.col("_archived")).alias("observed"), F.col("seq").alias("seq"))
    folded = (
        rows.withColumns({"_observed": observed, "_order": order})
        .groupBy(S.KEY)
        .agg(*[F.expr(a) for a in aggregates])
    )
    status = f"coalesce(_status, '{S.AVAILABLE}')"
    origins = f"IF(_origin_known, _origins, array_append(_origins, '{S.ORIGIN_UNKNOWN}'))"
    # Content that arrived before any stated update time dates the update itself.
    own_update = (
        "CASE WHEN _updated_seq IS NULL OR _content_seq < _updated_seq THEN _content_seen END"
    )
    derived = {
        "url": "coalesce(_real_url, _made_up_url)",
        "status": status,
        "unavailable_reason": f"CASE WHEN {status} <> '{S.AVAILABLE}' THEN _reason END",
        "origin": f"array_join(array_sort(array_distinct({origins})), '{ORIGIN_SEPARATOR}')",
        "first_seen_at": "least(_first_row_seen, _first_seen)",
        "content_updated_at": f"greatest(_updated, {own_update})",
    }
    return folded.selectExpr(
        *[f"{derived.get(c, c)} AS {c}" for c in S.POST_COLUMNS], "n_observations", "_prior"
    )


def touched(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, S.KEY, "left_semi")


def untouched(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, S.KEY, "left_anti")


def merge_observations(archive: DataFrame, observations: DataFrame, as_of: datetime) -> DataFrame:
    """Merged rows of the observed posts, with what happened to them.

    Adds ``outcome`` (added, updated, unchanged), ``content_changed`` and
    ``n_observations``.  Posts without an observation are not in the result, so
    the cost follows the batch, not the archive.
    """
    keys = observations.select(S.KEY).distinct()
    prior_rows = touched(archive, keys).withColumns(
        {"seq": F.lit(None).cast(observations.schema["seq"].dataType), "_archived": F.lit(True)}
    )
    observed = observations.withColumn("_archived", F.lit(False))
    folded = fold(prior_rows.unionByName(observed), as_of)

    def same(columns: list[str]) -> str:
        then = [f"_prior.{c}" for c in columns]
        return f"struct({', '.join(columns)}) <=> struct({', '.join(then)})"

    return folded.selectExpr(
        *S.POST_COLUMNS,
        f"""CASE WHEN _prior IS NULL THEN 'added' WHEN {same(S.POST_COLUMNS)} THEN 'unchanged'
            ELSE 'updated' END AS outcome""",
        f"_prior IS NULL OR NOT ({same(list(S.CONTENT))}) AS content_changed",
        "n_observations",
    )


def apply_merge(archive: DataFrame, merged: DataFrame) -> DataFrame:
    """The whole archive after a merge: untouched rows plus merged rows."""
    keys = merged.select(S.KEY)
    return untouched(archive, keys).unionByName(merged.select(*S.POST_COLUMNS))


def outcome_counts(merged: DataFrame) -> DataFrame:
    """Run counters: posts per outcome and the observations behind them."""
    return merged.groupBy("outcome").agg(
        F.count("*").alias("posts"), F.sum("n_observations").alias("observations")
    )
