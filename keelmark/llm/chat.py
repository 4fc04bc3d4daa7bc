"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. No escaped text holds one, as it has neither "<" nor ">" without a backslash before it.
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<>])", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Training examples (conv_id, example, formatted, loss_start, loss_chars) of rows (conv_id, turn, role, text).

    Every assistant turn becomes an example: all turns before it are its context, and only its own
    text lies under the loss mask, which is ``loss_chars`` characters from ``loss_start`` (from 0). Turns
    after the last reply make one more example without a mask, so nothing is lost. A turn is written as
    ``<turn>role<says>text</turn>`` and a line feed; backslashes and angle brackets in roles and texts get a backslash.

    Turns are ordered by number (nulls last), then role and text; null roles and texts are empty; rows of a null conv_id are one
    conversation; other columns are ignored. An example holds its whole conversation up to the
    reply, so a conversation's turns are gathered in one row and its examples are made one by one from it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(SAYS))
    body = escaped(text)
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("unnumbered"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
            head.alias("head"), body.alias("body"), (role == TRAINED_ROLE).alias("trained"),
        ).alias("turn"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # position of each example's last turn: the assistant turns, and the last turn of all
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.element_at("turns", i).trained | (i == F.size("turns")),
    )
    examples = gathered.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    whole = F.concat_ws("", F.transform(
        F.slice("turns", 1, F.col("last")), lambda t: F.concat(t.head, t.body, F.lit(CLOSE))
    ))
    target = F.element_at("turns", F.col("last"))
    return examples.select("conv_id", "example", whole.alias("formatted"), target.trained.alias("trained"), target.body.alias("body")).select(
        "conv_id", "example", "formatted",
        F.when(F.col("trained"), F.length("formatted") - F.length("body") - len(CLOSE)).alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example."""
    parts = F.split(formatted, CLOSE)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2_147_483_647), SAYS, 1)).alias("role"),
        unescaped(F.substring_index(p, SAYS, -1)).alias("text"),
    ))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped; empty without a mask."""
    return F.coalesce(unescaped(F.substring(formatted, start + 1, chars)), F.lit(""))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What a reader of the examples finds, per conversation: its turns, and all text under its loss masks."""
    read = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"), "formatted",
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.sum("chars").alias("formatted_chars"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss)).alias("loss"),
    )
    turns = read_turns(F.col("formatted"))
    return whole.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
