r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, that reply alone trainable.  A conversation that does not end with an
assistant turn gets one more example without a target, so that its last turns
are not lost from the output.

A turn is written as ``<turn ROLE>TEXT</turn>`` and a newline.  In roles and
texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no
text can forge a mark and :func:`read_conversations` gets every text back.

Defined cases: NULL roles and texts are empty.  Rows of a conversation go by
``turn`` (NULL first), ties by role, then text; repeated rows stay.  Rows
without ``conv_id`` form one conversation.  Other columns are ignored.  A
conversation is one row in between, as its digest needs all its turns in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (index of its last turn), formatted, loss_start, loss_end.

    The loss mask is the half-open range of characters of ``formatted`` that
    holds the reply; NULL where an example has no target.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    marked = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.concat(F.lit("<turn "), escape(t.role), F.lit(">"), escape(t.text), F.lit(TURN_END)),
        ).alias("pieces"),
        F.transform("turns", lambda t: t.role == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.length(escape(t.text))).alias("lengths"),
    )
    last = F.size("replies") - 1
    targets = F.filter(
        F.sequence(F.lit(0), last), lambda i: F.get("replies", i) | (i == last)
    )
    one = marked.select("conv_id", "pieces", "replies", "lengths", F.explode(targets).alias("example"))
    formatted = one.select(
        "conv_id",
        "example",
        F.array_join(F.slice("pieces", F.lit(1), F.col("example") + 1), "").alias("formatted"),
        F.get("replies", F.col("example")).alias("reply"),
        F.get("lengths", F.col("example")).alias("chars"),
    )
    end = F.length("formatted") - F.lit(len(TURN_END))
    return formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("reply"), end - F.col("chars")).alias("loss_start"),
        F.when(F.col("reply"), end).alias("loss_end"),
    )


def read_conversations(examples: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the examples alone.

    conv_id, turns (role and text of all turns), losses (the texts under the loss
    masks in order), formatted_chars (characters of all its examples).
    """
    masked = F.col("formatted").substr(
        F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")
    )
    loss = F.when(
        F.col("loss_start").isNotNull(),
        F.struct(F.col("example"), unescape(masked).alias("text")),
    )
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = F.split("longest", TURN_END, -1)
    turns = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.split(part, ">", 2)
    )
    return whole.select(
        "conv_id",
        F.transform(
            turns,
            lambda t: F.struct(
                unescape(F.replace(t[0], F.lit("<turn "))).alias("role"), unescape(t[1]).alias("text")
            ),
        ).alias("turns"),
        F.transform("losses", lambda x: x.text).alias("losses"),
        "formatted_chars",
    )


def digests(conversations: DataFrame) -> DataFrame:
    """The columns of a conversation that a comparison needs: counts and hashes."""
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    loss = F.array_join("losses", "")
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
