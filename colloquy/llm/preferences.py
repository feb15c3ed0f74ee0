"""Preference formatting: a shared prompt and two masked completions from chosen and rejected chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["branch_pairs", "conversations_from_turns", "format_preferences"]

#: How a turn is written: opening of its role, text, close. Losses cover text and close.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations_from_turns(turns: DataFrame) -> DataFrame:
    """One row (conv_id, turns: array of role and text) for each conversation, in turn order.

    Rows with equal turn numbers are ordered by role and text, null roles and texts count as empty, and
    rows without a conversation id belong to none.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    placed = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    gathered = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    return gathered.select("conv_id", F.transform("placed", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def branch_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected) for chats without recorded preferences, one for each conversation.

    A whole conversation is chosen. Rejected leaves it after some of its turns (its id modulo their number)
    and goes on with its sibling's turns from there, the sibling being the conversation whose id differs in
    the last bit. Without a sibling, or past the sibling's end, rejected ends there. An empty conversation
    is left at its start. Conversation ids are unique.
    """
    other = conversations.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turns").alias("theirs"))
    depth = F.pmod(F.col("conv_id"), F.greatest(F.size("turns"), F.lit(1))).cast("int")
    both = conversations.select("conv_id", "turns", depth.alias("depth")).join(other, "conv_id", "left")
    theirs = F.coalesce(F.col("theirs"), F.slice("turns", 1, 0))
    rest = F.slice(theirs, F.col("depth") + 1, F.greatest(F.size(theirs) - F.col("depth"), F.lit(0)))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("depth")), rest).alias("rejected"))


def _written(turn: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), turn.role, F.lit(after), turn.text, F.lit(CLOSE))


def _spans(turns: Column, role: str) -> Column:
    """Character ranges [start, end) that ``role``'s texts and closes take in the written turns."""
    opening = F.lit(len(OPEN) - len("{role}"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc.at + opening + F.length(turn.role)
        end = start + F.length(turn.text) + len(CLOSE)
        mine = F.when(turn.role == role, F.array(F.struct(start.alias("start"), end.alias("end"))))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(end.alias("at"), F.concat(acc.spans, F.coalesce(mine, empty)).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc.spans)


def format_preferences(pairs: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """One row for each pair: pair_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``pairs`` has pair_id and two arrays of turns (role, text), chosen and rejected. ``prompt`` is their
    longest common prefix of turns, written once; ``chosen`` and ``rejected`` are the rest of each. The
    spans are the character ranges of a completion that are trained on: text and close of turns by
    ``role``; everything else, the prompt included, is masked.

    Equal conversations are all prompt, with empty completions; null arrays count as empty, null roles
    and texts as empty strings. Repeated pairs give repeated rows. Other columns are not read.
    """

    def clean(c: str) -> Column:
        text = lambda x: F.coalesce(x, F.lit(""))
        turns = F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>"))
        return F.transform(turns, lambda t: F.struct(text(t.role).alias("role"), text(t.text).alias("text")))

    rows = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    apart = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    rows = rows.withColumn("prefix_turns", F.when(apart > 0, apart - 1).otherwise(F.size("c")).cast("long"))
    n = F.col("prefix_turns").cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    rows = rows.select("pair_id", "prefix_turns", F.slice("c", F.lit(1), n).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    written = lambda c: F.array_join(F.transform(c, _written), "")
    return rows.select(
        "pair_id",
        "prefix_turns",
        written("p").alias("prompt"),
        written("c").alias("chosen"),
        written("r").alias("rejected"),
        _spans(F.col("c"), role).alias("chosen_spans"),
        _spans(F.col("r"), role).alias("rejected_spans"),
    )
