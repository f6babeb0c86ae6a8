"""Merging by observed time: the same archive for any order of arrival.

The fold of :mod:`postarchive.operators.merge` takes observations as they arrive.  Here
each content column of a post is a register, the last non-empty value with the time it
was observed, and two states of a post are merged column by column by the later time;
of values observed at the same time the larger one wins.  That is commutative,
associative and idempotent, so landings and micro-batches may come in any order, twice or
in parts.  Registers are kept beside the post rows; a merge of a column is one ``max``,
with a map-side partial.

Rules: empty never replaces a value; a made-up ``/i/status/`` address never replaces a
real one; the status is the last one observed, unstated at first means available; the reason
is that of the last observation which states one or is available again, and an available post
has none; origins are a set, with ``unknown`` where the earliest observations state none;
first and last seen are the earliest and latest; ``content_updated_at`` is the latest
stated, else the time the first content was seen.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive import schema as S
from postarchive.operators.merge import ORIGIN_SEPARATOR, nonempty

CONTENT = [c for c in S.CONTENT if c != "url"]
MADE_UP = f"url = concat('{S.URL_WITHOUT_HANDLE}', {S.KEY})"
# Columns that are merged by their largest value, all of them (time, value) but the last.
LATEST = [*CONTENT, "real_url", "made_up_url", "status", "reason"]


def _kind(name: str) -> str:
    value = "string" if name in ("real_url", "made_up_url", "status", "reason") else S.POST_TYPES[name]
    return f"struct<at:timestamp,value:{value}>"


TYPES = {
    S.KEY: "string", **{c: _kind(c) for c in LATEST}, "origins": "array<string>",
    "origin_known": "struct<at:timestamp,value:boolean>", "first_seen": "timestamp", "last_seen": "timestamp",
    "updated": "timestamp", "first_content": "timestamp",
}
REGISTERS = S.ddl(TYPES)


def registers(observations: DataFrame, as_of: datetime) -> DataFrame:
    """One row per observation, each as the state of a post that knows only this."""
    rows = observations.withColumn("_at", F.coalesce("last_seen_at", F.lit(as_of)))

    def register(name: str, value: str, condition: str) -> str:
        return f"CASE WHEN {condition} THEN struct(_at AS at, {value} AS value) END AS {name}"

    gone, back = f"status = '{S.UNAVAILABLE}'", f"status = '{S.AVAILABLE}'"
    has_content = f"({nonempty('full_text')} OR {nonempty('media')})"
    known = f"coalesce({nonempty('origin')}, false)"
    return rows.selectExpr(
        S.KEY,
        *[register(c, c, nonempty(c)) for c in CONTENT],
        register("real_url", "url", f"url <> '' AND NOT {MADE_UP}"),
        register("made_up_url", "url", MADE_UP),
        register("status", "status", nonempty("status")),
        register(
            "reason", f"CASE WHEN {gone} THEN unavailable_reason END",
            f"{back} OR ({gone} AND {nonempty('unavailable_reason')})",
        ),
        f"CASE WHEN {known} THEN split(origin, '[+]') ELSE array() END AS origins",
        f"struct(_at AS at, {known} AS value) AS origin_known",
        "coalesce(first_seen_at, _at) AS first_seen",
        "_at AS last_seen",
        "content_updated_at AS updated",
        f"CASE WHEN {has_content} THEN _at END AS first_content",
    )


def merged(states: DataFrame) -> DataFrame:
    """One state per post from any number of states."""
    aggregates = [f"max({c}) AS {c}" for c in LATEST] + [
        "array_sort(array_distinct(flatten(collect_set(origins)))) AS origins",
        "min(origin_known) AS origin_known", "min(first_seen) AS first_seen", "max(last_seen) AS last_seen",
        "max(updated) AS updated", "min(first_content) AS first_content",
    ]
    return states.groupBy(S.KEY).agg(*[F.expr(a) for a in aggregates])


def post_rows(states: DataFrame) -> DataFrame:
    """Post rows of merged states."""
    status = f"coalesce(status.value, '{S.AVAILABLE}')"
    origins = f"IF(origin_known.value, origins, array_append(origins, '{S.ORIGIN_UNKNOWN}'))"
    derived = {
        "url": "coalesce(real_url.value, made_up_url.value)",
        "status": status,
        "unavailable_reason": f"CASE WHEN {status} <> '{S.AVAILABLE}' THEN reason.value END",
        "origin": f"array_join(array_sort(array_distinct({origins})), '{ORIGIN_SEPARATOR}')",
        "first_seen_at": "first_seen",
        "last_seen_at": "last_seen",
        "content_updated_at": "coalesce(updated, first_content)",
    }
    values = {c: f"{c}.value" for c in CONTENT} | derived
    return states.selectExpr(*[f"{values.get(c, c)} AS {c}" for c in S.POST_COLUMNS])


def merge_states(
    posts: DataFrame, states: DataFrame, observations: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """New states of the observed posts, and their rows with the outcome.

    ``posts`` and ``states`` are what the archive holds; a post without a state, which
    was merged by arrival so far, enters with its row as one observation.
    """
    observed = registers(observations, as_of)
    keys = observed.select(S.KEY).distinct()
    prior = posts.join(keys, S.KEY, "left_semi")
    held = states.join(keys, S.KEY, "left_semi")
    stateless = registers(prior.join(states.select(S.KEY), S.KEY, "left_anti"), as_of)
    counted = observed.groupBy(S.KEY).agg(F.count("*").alias("n_observations"))
    new = merged(observed.unionByName(held).unionByName(stateless))

    before = prior.select(S.KEY, F.struct(*S.POST_COLUMNS).alias("_prior"))
    rows = post_rows(new).join(before, S.KEY, "left").join(counted, S.KEY)

    def same(columns: list[str]) -> str:
        return f"struct({', '.join(columns)}) <=> struct({', '.join(f'_prior.{c}' for c in columns)})"

    outcome = f"CASE WHEN _prior IS NULL THEN 'added' WHEN {same(S.POST_COLUMNS)} THEN 'unchanged' ELSE 'updated' END"
    changed = f"_prior IS NULL OR NOT ({same(list(S.CONTENT))})"
    return new, rows.selectExpr(
        *S.POST_COLUMNS, f"{outcome} AS outcome", f"{changed} AS content_changed", "n_observations"
    )
