"""Scalar column expressions shared by the normalisers and the read queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postarchive import schema as S

_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?"
_OFFSET = r"[+-]\d{2}(:?\d{2})?"
# 8 digits are a compact date; any other bare number is seconds since 1970.
_EPOCH = r"^-?(\d{1,7}|\d{9,12})(\.\d+)?$"
_CLASSIC = r"^[A-Za-z]{3} [A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"


def text(c: Column) -> Column:
    """Text, with the empty string read as missing."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_text(*cols: Column) -> Column:
    """The first argument that is neither NULL nor empty."""
    return F.coalesce(*[text(c) for c in cols])


def whole_number(c: Column) -> Column:
    """Counter text to BIGINT; anything that is not an integer becomes NULL."""
    return c.try_cast("bigint")


def items(c: Column) -> Column:
    """An array with NULL read as empty."""
    return F.coalesce(c, F.array().cast("array<string>"))


def or_null(array: Column) -> Column:
    """An array, with the empty array read as missing."""
    return F.when(F.size(array) > 0, array)


def instant(c: Column) -> Column:
    """Timestamp text to an instant; text without an offset is taken as UTC.

    Reads ISO dates and date-times, compact dates, seconds since 1970 and the
    classic ``Wed Jan 06 18:40:40 +0000 2021`` form.  Other text becomes NULL.
    """
    t = F.trim(c)
    iso = F.regexp_replace(F.regexp_replace(t, "[Zz]$", "+00:00"), ",", ".")
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    padded = F.regexp_replace(iso, r"([T ]\d{2})(?=$|[+-])", "$1:00")
    padded = F.regexp_replace(padded, r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1:00")
    with_offset = F.when(
        iso.rlike(rf"^{_DATE}[T ]{_CLOCK}$"), F.concat(padded, F.lit("+00:00"))
    ).otherwise(padded)
    return (
        F.when(t.rlike(rf"^{_DATE}$"), F.try_to_timestamp(F.concat(t, F.lit("T00:00:00+00:00"))))
        .when(
            t.rlike(rf"^{_DATE}[T ]{_CLOCK}({_OFFSET}|[Zz])?$"), F.try_to_timestamp(with_offset)
        )
        .when(
            t.rlike(r"^\d{8}$"),
            F.try_to_timestamp(
                F.concat(
                    t.substr(1, 4), F.lit("-"), t.substr(5, 2), F.lit("-"), t.substr(7, 2),
                    F.lit("T00:00:00+00:00"),
                )
            ),
        )
        .when(
            t.rlike(_EPOCH),
            F.timestamp_micros((t.try_cast("decimal(28,6)") * 1_000_000).try_cast("bigint")),
        )
        .when(
            t.rlike(_CLASSIC),
            F.try_to_timestamp(F.substring(t, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy")),
        )
    )


def iso_text(ts: Column) -> Column:
    """An instant as ISO text in UTC (needs a UTC session)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def json_text(c: Column, empty: Column) -> Column:
    """JSON text of a nested value, NULL when ``empty`` holds."""
    return F.when(~empty, F.to_json(c, {"ignoreNullFields": "false"}))


def post_url(key: Column, handle: Column) -> Column:
    before, after = S.URL_WITH_HANDLE.format(handle="|", id="").split("|")
    return F.when(
        text(handle).isNotNull(), F.concat(F.lit(before), handle, F.lit(after), key)
    ).otherwise(F.concat(F.lit(S.URL_WITHOUT_HANDLE), key))


def reference_id(c: Column) -> Column:
    """The post id inside an id or URL: its first run of 6 to 25 digits."""
    return text(F.regexp_extract(c, r"(\d{6,25})", 1))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def shown_at(posts) -> Column:
    """The time a post is ordered by: created, else first seen."""
    return F.coalesce(posts["created_at"], posts["first_seen_at"])
