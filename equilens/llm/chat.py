"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a
block, and blocks are concatenated::

    <s>role[INST]text[/INST][INST]text of the same role[/INST]</s><s>other role[INST]text[/INST]</s>

Inside roles and texts a backslash is doubled, and one is put after the first character of anything that looks
like one of the four marks; so no text can end a turn, and reading back restores every character.  ``segments``
holds the pieces of the formatted text in order, each with a flag: the flag is the loss mask, set on the texts of
the learned role alone.

Defined results: null role or text counts as empty; turns are ordered by (turn, role, text), nulls first, and
repeated rows stay; rows with a null conversation id form one conversation; an empty table gives no rows; columns
other than the four named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TURN, END = "<s>", "</s>", "[INST]", "[/INST]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=/?s>|/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merged(turns: Column) -> Column:
    """Blocks of a sorted array of turns: role and texts of adjacent turns of that role."""

    def blocks(starts: Column) -> Column:
        def block(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(turns))
            return F.struct(turns[start]["role"].alias("role"), F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"]).alias("texts"))

        return F.transform(starts, block)

    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))
    return let(starts, blocks)


def segments(blocks: Column, learned: str) -> Column:
    """Pieces of the formatted text, flagged where the loss counts."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    fixed = lambda text: piece(F.lit(text), F.lit(False))

    def of_block(b: Column) -> Column:
        texts = F.flatten(F.transform(b["texts"], lambda t: F.array(fixed(TURN), piece(escape(t), b["role"] == learned), fixed(END))))
        return F.concat(F.array(fixed(OPEN), piece(escape(b["role"]), F.lit(False))), texts, F.array(fixed(CLOSE)))

    return F.flatten(F.transform(blocks, of_block))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """One row per conversation: ``id_col``, formatted, segments."""
    turn = F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    chats = turns.groupBy(turns[id_col].alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = chats.select("id", merged(F.col("turns")).alias("blocks")).select("id", segments(F.col("blocks"), learned).alias("segments"))
    return out.select(F.col("id").alias(id_col), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    split = lambda text, mark: let(F.split(text, mark, -1), lambda parts: F.slice(parts, 1, F.size(parts) - 1))

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), TURN, 1))
        return F.transform(split(block, r"\[/INST\]"), lambda t: F.struct(role.alias("role"), unescape(F.substring_index(t, TURN, -1)).alias("text")))

    return F.flatten(F.transform(split(formatted, CLOSE), turns_of))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
