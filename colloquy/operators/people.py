"""Who speaks for the client and what the client says about the product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import bounded, matches
from colloquy.operators.extract import Entry, first_per_label, lexicon_hits

__all__ = ["persona", "voice"]


def voice(client: DataFrame, entries: list[Entry], aspects: list[Entry]) -> DataFrame:
    """doc_id, kind, target, quote, start of the client's sentences: praise, complaints and so on (an entry's
    label), once a kind and sentence; the target is the first aspect, in the list's order, that is named."""
    hits = first_per_label(lexicon_hits(client, entries))
    named = [F.when(F.col("search").rlike(bounded(a.pattern)), a.label) for a in aspects]
    target = F.coalesce(*named) if named else F.lit(None).cast("string")
    return hits.select("doc_id", F.col("label").alias("kind"), target.alias("target"), "quote", "start")


def persona(sentences: DataFrame, roles: list[Entry], superior: str, third_party: str, turns: DataFrame | None = None) -> DataFrame:
    """doc_id, role, power, quote, name: the first role in the list's order that the speaker may hold.

    A role inside a mention of a superior ("my CFO"), or shortly after words about a third party, is
    someone else's. Mention of a superior makes an influencer; else the role's group is the power, and
    without a role it is unknown. The name is the first client's of ``turns`` (doc_id, turn, speaker, side).
    """
    hits = lexicon_hits(sentences, roles)
    at = F.col("start")
    inside = F.exists(matches(F.col("search"), bounded(superior)), lambda m: (at + m.start <= F.col("hit_start")) & (F.col("hit_end") <= at + m.end))
    first = F.greatest(F.lit(0), F.col("hit_start") - at - 40)
    before = F.substring("search", (first + 1).cast("int"), (F.col("hit_start") - at - first).cast("int"))
    own = hits.where(~inside & ~before.rlike(bounded(third_party)))
    best = own.groupBy("doc_id").agg(F.min_by(F.struct("label", "grp", "quote"), F.struct("ordinal", "hit_start")).alias("r"))
    above = sentences.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("search").rlike(bounded(superior)), F.lit(False))).alias("above"))
    rows = above.join(best, "doc_id", "left")
    power = F.when(F.col("above"), "influencer").otherwise(F.coalesce("r.grp", F.lit("unknown")))
    rows = rows.select("doc_id", F.col("r.label").alias("role"), power.alias("power"), F.col("r.quote").alias("quote"))
    if turns is None:
        return rows.withColumn("name", F.lit(None).cast("string"))
    names = turns.where("side = 'client'").groupBy("doc_id").agg(F.min_by("speaker", "turn").alias("name"))
    return rows.join(names, "doc_id", "left")
