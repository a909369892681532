"""Conversations as training text: one marked, escaped string per conversation, and back.

A conversation's turns are collected as structs, sorted by turn, and adjacent turns of one role are
merged into one block. The text of a conversation is the concatenation of its blocks:

    <|im_start|>ROLE<|im_sep|>TEXT(<|im_next|>TEXT)*<|im_end|>

Every control string begins with "<|". In roles and texts a backslash is doubled and "<|" becomes
"<\\|", so that no text can hold a control string and ``unescaped`` restores every text exactly.

Defined cases: a null or empty text is an empty text; a null role is an empty role; turns of the same
number (repeated rows, null numbers first) are ordered by role and text and all kept; rows of a null
``conv_id`` are one conversation; no rows give no conversations. Other columns are ignored.
A conversation is one value, so it must fit a row, as its output must; nothing else is gathered. Work grows
with its length times the logarithm of its turns, whatever their roles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
SPANS = "array<struct<start:int,length:int>>"
#: Code points of the pieces in which loss texts are looked up.
PIECE = 256


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it in every step of a loop."""
    return F.transform(F.array(value), body)[0]


def _begins(turns: Column, i: Column) -> Column:
    """Whether turn ``i`` (from 0) begins a block: the one before is missing or has another role."""
    return F.coalesce(F.get(turns, i - 1)["role"] != F.get(turns, i)["role"], F.lit(True))


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: an array of arrays of turns, cut where blocks begin."""
    places = F.filter(F.transform(turns, lambda _, i: i), lambda i: _begins(turns, i))
    return _let(
        places,
        lambda starts: F.transform(
            starts,
            lambda at, n: F.slice(turns, at + 1, F.coalesce(F.get(starts, n + 1), F.size(turns)) - at),
        ),
    )


def _block_text(block: Column) -> Column:
    texts = F.array_join(F.transform(block, lambda t: escaped(t["text"])), NEXT)
    return F.concat(F.lit(START), escaped(F.get(block, F.lit(0))["role"]), F.lit(SEP), texts, F.lit(END))


def _running_sums(numbers: Column) -> Column:
    """Inclusive running sums: every pass adds the number twice as far back, so there are log2(size) passes."""
    powers = F.array(*(F.lit(1 << n) for n in range(31)))

    def summed(first: Column) -> Column:
        return F.aggregate(
            F.filter(powers, lambda step: step < F.size(first)),
            first,
            lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))),
        )

    return _let(numbers, summed)


def _loss_spans(turns: Column, loss_role: str) -> Column:
    """Start (from 0) and length, in code points of the formatted text, of every text of ``loss_role``."""

    def width(turn: Column, i: Column) -> Column:
        opened = F.length(escaped(turn["role"])) + len(START) + len(SEP) + F.when(i == 0, 0).otherwise(len(END))
        return F.when(_begins(turns, i), opened).otherwise(len(NEXT)) + F.length(escaped(turn["text"]))

    def spans(ends: Column) -> Column:
        def span(turn: Column, i: Column) -> Column:
            length = F.length(escaped(turn["text"]))
            place = F.struct((F.get(ends, i) - length).alias("start"), length.alias("length"))
            return F.when(turn["role"] == loss_role, place)

        return F.filter(F.transform(turns, span), lambda s: s.isNotNull())

    return _let(_running_sums(F.transform(turns, width)), spans).cast(SPANS)


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, turn, role, text`` rows -> ``conv_id, formatted, loss_spans``, a row per conversation.

    ``loss_spans`` holds the places of the texts that ``loss_role`` wrote, escaped as they stand there.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = (
        conversations.select("conv_id", turn.alias("one"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("one")).alias("turns"))
    )

    def written(turns: Column) -> Column:
        text = F.array_join(F.transform(_merged(turns), _block_text), "")
        return F.struct(text.alias("formatted"), _loss_spans(turns, loss_role).alias("loss_spans"))

    return gathered.select("conv_id", _let(F.col("turns"), written).alias("out")).select("conv_id", "out.*")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")

    def turns(parts: Column) -> Column:
        def read(role: Column) -> Column:
            texts = F.split(F.get(parts, F.lit(1)), _quoted(NEXT))
            return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

        return _let(unescaped(F.get(parts, F.lit(0))), read)

    return F.flatten(
        F.transform(
            blocks,
            lambda block: _let(F.split(F.substring(block, len(START) + 1, 2147483647), _quoted(SEP)), turns),
        )
    )


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between.

    A span is cut out of the few pieces it lies in, as finding a place in a text means walking to it.
    """

    def read(pieces: Column) -> Column:
        def cut(span: Column) -> Column:
            first = F.floor(span["start"] / PIECE).cast("int")
            last = F.floor((span["start"] + span["length"]) / PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            # Column.substr takes places that are columns
            return unescaped(near.substr(span["start"] - first * PIECE + 1, span["length"]))

        return F.array_join(F.transform(loss_spans, cut), "")

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), read)


def _quoted(mark: str) -> str:
    return mark.replace("|", "\\|")


def digest(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations`` wrote, read back and hashed."""
    back = formatted.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
