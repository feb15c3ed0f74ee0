"""Conversation metrics over turns: conv_id, turn, speaker, side (seller, client or null), text, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import count_words, fold, once

__all__ = ["SELLER", "CLIENT", "followup_depth", "interruptions", "longest_monologue", "questions", "talk_ratio", "turns_from_roles", "words_before_question"]

SELLER, CLIENT = "seller", "client"

# Openings of an open question, and connectives that may stand before them (folded).
OPENINGS = (
    "como", "por que", "porque", "o que", "qual", "quais", "quando", "onde", "quem", "me conta", "me fala", "me explica",
    "de que forma", "o quanto", "quanto", "quantos", "quantas", "quanta",
)
LEAD_INS = r"^(?:e|mas|entao|ai|ok|ta|bom|olha|agora|so que|so)\s+"


def turns_from_roles(messages: DataFrame, seller: str = "assistant", client: str = "user") -> DataFrame:
    """Turns of chat messages (conv_id, turn, role, text); other roles belong to no side and are left out."""
    side = F.when(F.col("role") == seller, SELLER).when(F.col("role") == client, CLIENT)
    rows = messages.select("conv_id", "turn", F.col("role").alias("speaker"), side.alias("side"), "text")
    return rows.where("side is not null").withColumn("words", count_words(F.col("text")))


def talk_ratio(turns: DataFrame) -> DataFrame:
    """conv_id, turn_count, seller_words, client_words, talk_ratio_seller and _client.

    Ratios are null unless both sides speak.
    """
    spoken = lambda side: F.sum(F.when(F.col("side") == side, F.col("words")).otherwise(0)).cast("long")
    there = lambda side: F.max(F.when(F.col("side") == side, 1).otherwise(0)) == 1
    sums = turns.groupBy("conv_id").agg(
        F.count("*").alias("turn_count"), spoken(SELLER).alias("seller_words"), spoken(CLIENT).alias("client_words"), (there(SELLER) & there(CLIENT)).alias("both")
    )
    total = F.col("seller_words") + F.col("client_words")
    ratio = lambda c: F.when(F.col("both") & (total > 0), F.col(c) / total)
    return sums.select("*", ratio("seller_words").alias("talk_ratio_seller"), ratio("client_words").alias("talk_ratio_client")).drop("both")


def longest_monologue(turns: DataFrame, side: str = SELLER) -> DataFrame:
    """conv_id, longest_monologue_words: most words of one speaker of ``side`` in turns without another between."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    breaks = F.coalesce((F.col("side") != F.lag("side").over(order)) | (F.col("speaker") != F.lag("speaker").over(order)), F.lit(True))
    islands = turns.withColumn("island", F.sum(breaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = islands.groupBy("conv_id", "island").agg(F.sum(F.when(F.col("side") == side, F.col("words")).otherwise(0)).alias("w"))
    return blocks.groupBy("conv_id").agg(F.max("w").cast("long").alias("longest_monologue_words"))


def _questions(text: Column, mark: str) -> Column:
    """Interrogative sentences: what stands before ``mark`` since the last mark, full stop or exclamation."""
    found = F.regexp_extract_all(text, F.lit(rf"[^.!{mark}]*[{mark}]"), F.lit(0))
    return F.filter(F.transform(found, lambda q: F.trim(q)), lambda q: F.length(q) > 1)


def _open(question: Column, openings: tuple[str, ...]) -> Column:
    def starts(part: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(part, r"^[^\p{L}]+", ""), LEAD_INS, "")
        return bare.rlike("^(?:" + "|".join(openings) + ")")

    def either(folded: Column) -> Column:
        return starts(F.element_at(F.split(folded, "[:,;]", -1), -1)) | starts(folded)

    return once(fold(question), either)


def questions(turns: DataFrame, mark: str = "?", openings: tuple[str, ...] = OPENINGS) -> DataFrame:
    """conv_id, seller_questions, open_questions, closed_questions of the seller's turns."""
    found = F.when(F.col("side") == SELLER, _questions(F.col("text"), mark)).otherwise(F.array().cast("array<string>"))
    per_turn = turns.select("conv_id", F.size(found).alias("n"), F.size(F.filter(found, lambda q: _open(q, openings))).alias("open"))
    sums = per_turn.groupBy("conv_id").agg(F.sum("n").alias("seller_questions"), F.sum("open").alias("open_questions"))
    return sums.withColumn("closed_questions", F.col("seller_questions") - F.col("open_questions"))


def words_before_question(turns: DataFrame, mark: str = "?") -> DataFrame:
    """conv_id, words_before_first_question: the seller's words before their first question, null if none."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = turns.where(F.col("side") == SELLER).withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    first = F.regexp_extract("text", rf"(?s)^(.*?)[^.!{mark}]*[{mark}]", 1)
    asked = own.where(F.size(_questions(F.col("text"), mark)) > 0).groupBy("conv_id").agg(F.min_by(F.col("before") + count_words(first), "turn").alias("n"))
    return turns.select("conv_id").distinct().join(asked, "conv_id", "left").select("conv_id", F.col("n").cast("long").alias("words_before_first_question"))


def interruptions(turns: DataFrame, endings: str = ".!?…", least_words: int = 3) -> DataFrame:
    """conv_id, interruptions: changes of speaker after ``least_words`` words without a final mark."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = lambda c: F.lag(c).over(order)
    finished = F.trim(before("text")).rlike(rf"""[{endings}]["')\]]?$""")
    cut = (before("speaker") != F.col("speaker")) & (before("words") >= least_words) & ~finished
    return turns.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("long")).groupBy("conv_id").agg(F.sum("cut").alias("interruptions"))


def followup_depth(turns: DataFrame, mark: str = "?") -> DataFrame:
    """conv_id, followup_depth: the longest chain of seller questions with a client's answer between."""
    asks = F.instr("text", mark) > 0
    step = F.struct("turn", F.when(F.col("side") == CLIENT, "c").when(asks, "q").otherwise("s").alias("kind"))
    chains = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chain"), F.lit(False).alias("waiting"))

    def merge(a: Column, t: Column) -> Column:
        chain = F.when(t.kind == "q", F.when(a.waiting, a.chain + 1).otherwise(1)).otherwise(a.chain)
        waiting = F.when(t.kind == "c", a.chain > 0).otherwise(False)
        return F.struct(F.greatest(a.depth, F.when(t.kind == "q", chain).otherwise(0)).alias("depth"), chain.alias("chain"), waiting.alias("waiting"))

    return chains.select("conv_id", F.aggregate("steps", start, merge, lambda a: a.depth).cast("long").alias("followup_depth"))
