"""Chat formatting by prefix-target expansion.

``expand`` turns a table of turns into training examples: each assistant turn gives one example whose context is
all turns before it and whose only trainable text is that reply. Turns after the last reply, and conversations
without one, give one more row without trainable text, so every turn can be read back.

A turn is written ``### role: text</turn>`` and a line feed. In roles and texts backslash, ``<`` and ``#`` (in
roles the colon, too) become a backslash and a letter, so no text can look like a mark, and ``unescape`` restores
each exactly. Places are code points, ends exclusive.

The turns of a conversation are brought together by one shuffle and sorted inside their row; examples are made
row by row from that array. A conversation must fit into a row, as must each example; the output grows
with the square of a conversation's turns, as the method has it. Conversations are shuffled by id, so many
conversations with an equal first turn are not a hot key.

Defined results: a null text or role is empty. Turns are ordered by turn, role and text, null turns first; equal
rows stay, each as a turn. Rows without conversation id form one conversation without id. An empty table gives
no examples. Columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import column, sha256, whole

ASSISTANT = "assistant"
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"

#: What is escaped, and the letter that stands for it; the backslash comes first when escaping, last when restoring.
ESCAPES = (("\\", "s"), ("<", "l"), ("#", "h"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, letter in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    for char, letter in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conversation id (by its own name), example (from 0), n_turns in it, last (the conversation's
    last row), formatted, and loss_start and loss_stop (null if nothing is trainable)."""
    one = F.struct(column(turn).alias("turn"), whole(column(role)).alias("role"), whole(column(text)).alias("text"))
    grouped = turns.select(column(conv).alias("conv"), one.alias("one")).groupBy("conv")
    rows = grouped.agg(F.sort_array(F.collect_list("one")).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escape(t["role"], True), F.lit(MIDDLE))
    rows = rows.select(
        "conv",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(TAIL))).alias("parts"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.filter(
            F.transform("turns", lambda t, i: F.when((t["role"] == ASSISTANT) | (i == F.size("turns") - 1),
                F.struct(i.alias("at"), (t["role"] == ASSISTANT).alias("reply")))),
            lambda x: x.isNotNull(),
        ).alias("targets"),
    )
    # outer, as a filter on the array's size would compute the array a second time; no array is empty
    rows = rows.select("conv", "parts", "heads", F.size("targets").alias("many"), F.posexplode_outer("targets").alias("example", "target"))
    at = F.col("target.at")
    context = F.array_join(F.slice("parts", 1, at), "")
    rows = rows.select(
        "conv", "example", (at + 1).alias("n_turns"), (F.col("example") == F.col("many") - 1).alias("last"),
        context.alias("context"), F.get("parts", at).alias("part"), F.get("heads", at).alias("head"), "target.reply",
    )
    start = F.length("context") + F.col("head")
    stop = F.length("context") + F.length("part") - len(TAIL)
    return rows.select(
        F.col("conv").alias(conv), "example", "n_turns", "last", F.concat("context", "part").alias("formatted"),
        F.when(F.col("reply"), start).alias("loss_start"), F.when(F.col("reply"), stop).alias("loss_stop"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, TAIL)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(part: Column) -> Column:
        cut = F.instr(part, MIDDLE)
        role = F.substring(part, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD))
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring(part, cut + len(MIDDLE), F.length(part))).alias("text")
        )

    return F.transform(parts, one)


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read back from examples, for each conversation: its turns, and all text under the loss mask."""
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_stop") - F.col("loss_start"))
    turns = parse(F.col("formatted"))
    shown = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        column(conv).alias("conv"), "example", F.length("formatted").cast("bigint").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), unescape(masked)).alias("loss"),
        F.when(F.col("last"), F.size(turns)).cast("bigint").alias("n_turns"),
        F.when(F.col("last"), sha256(F.array_join(shown, ""))).alias("turns_sha256"),
    )
    losses = F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    totals = read.groupBy("conv").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"), losses.alias("losses"),
    )
    return totals.select(
        F.col("conv").alias(conv), "n_turns", "turns_sha256", F.length(loss).cast("bigint").alias("loss_chars"),
        sha256(loss).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
