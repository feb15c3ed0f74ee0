"""Captions (VTT, SRT, SBV) and pasted layouts into lines ``Name: speech``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["caption_cues", "captions_to_text", "merged_turns", "normalised_speakers"]

# A cue's times, and the pause in seconds that begins a new paragraph.
TIMES = r"(?m)^\s*(?:\d+\s*\n)?\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*(?:-->|,)\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n"
PAUSE = 2.0


def _seconds(stamp: Column) -> Column:
    parts = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)


def caption_cues(files: DataFrame, text_col: str = "text") -> DataFrame:
    """path, cue, start, end, speaker, line of every cue: voice tags and ``Name:`` become speakers, tags go,
    and a line that repeats the cue before (rolling captions) is left out."""
    starts = F.regexp_extract_all(text_col, F.lit(TIMES), F.lit(1))
    ends = F.regexp_extract_all(text_col, F.lit(TIMES), F.lit(2))
    bodies = F.slice(F.split(text_col, TIMES, -1), 2, F.size(starts))
    rows = files.select("path", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"), bodies.alias("b"))).alias("cue", "c"))
    body = F.regexp_replace("c.b", r"\n\s*\d+\s*$", "")
    voice = F.regexp_extract(body, r"<v(?:\.[^ >]*)?\s+([^>]+)>", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", ""), r"\s+", " "))
    inline = F.regexp_extract(bare, r"^(\p{Lu}[\p{L}.'’ -]{0,40}):\s", 1)
    speaker = F.when(F.length(voice) > 0, F.trim(voice)).when(F.length(inline) > 0, inline)
    line = F.when((F.length(voice) == 0) & (F.length(inline) > 0), F.regexp_replace(bare, r"^[^:]+:\s+", "")).otherwise(bare)
    rows = rows.select("path", "cue", _seconds(F.col("c.s")).alias("start"), _seconds(F.col("c.e")).alias("end"), speaker.alias("speaker"), line.alias("line"))
    rows = rows.where(F.length("line") > 0)
    before = F.lag("line").over(Window.partitionBy("path").orderBy("cue"))
    rolling = before.isNotNull() & F.startswith(F.col("line"), before)
    return rows.withColumn("line", F.when(rolling, F.trim(F.substring("line", F.length(before) + 1, F.length("line")))).otherwise(F.col("line"))).where(F.length("line") > 0)


def captions_to_text(cues: DataFrame, pause: float = PAUSE) -> DataFrame:
    """path, text: a line for each speaker's stretch (``Name: speech``), or for each stretch without a pause
    of ``pause`` seconds where nobody is named."""
    order = Window.partitionBy("path").orderBy("cue")
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & F.col("speaker").isNotNull()
    paused = F.col("speaker").isNull() & (F.col("start") - F.lag("end").over(order) >= pause)
    fresh = F.coalesce(changed | paused, F.lit(False)).cast("int")
    rows = cues.withColumn("block", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), by)
    blocks = rows.withColumn("k", F.col("cue")).groupBy("path", "block").agg(F.min_by("speaker", "cue").alias("speaker"), joined("line", " ").alias("line"))
    said = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "line")).otherwise(F.col("line"))
    return blocks.select("path", F.col("block").alias("k"), said.alias("said")).groupBy("path").agg(joined("said", "\n").alias("text"))


def _letters(rank: Column) -> Column:
    """1, 2, ... as A to Z, AA, AB and so on: every rank has letters of its own."""
    places = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.floor((rank - _before(k)) / F.pow(F.lit(26.0), k)))
    digits = F.transform(F.filter(places, lambda d: d >= 0), lambda d: F.char(d % 26 + 65))
    return F.array_join(F.reverse(digits), "")


def _before(k: Column) -> Column:
    """Ranks that have fewer than k + 1 letters, and one: the first rank with k + 1 letters."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0).cast("double"), lambda a, i: a + F.pow(F.lit(26.0), i))


def normalised_speakers(turns: DataFrame) -> DataFrame:
    """Adds name: e-mails by their local part, generic labels as ``Falante A`` by first appearance in the
    document (after ``Z`` come ``AA``, ``AB``), more than three words as first and last."""
    raw = F.trim("speaker")
    generic = raw.rlike(r"(?i)^(?:speaker|falante|participante|locutor|spk)[ _-]*\d*[a-z]?$|^\d+$")
    firsts = turns.where(F.coalesce(generic, F.lit(False))).groupBy("doc_id", F.lower(raw).alias("label")).agg(F.min("turn").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "label"))
    letters = firsts.withColumn("letter", _letters(rank)).drop("at")
    rows = turns.withColumn("label", F.lower(raw)).join(letters, ["doc_id", "label"], "left").drop("label")
    local = F.initcap(F.regexp_replace(F.regexp_extract(raw, r"^([^@\s]+)@", 1), r"[._]+", " "))
    words = F.split(raw, r"\s+")
    short = F.when(F.size(words) > 3, F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))).otherwise(raw)
    name = F.when(F.col("letter").isNotNull(), F.concat(F.lit("Falante "), "letter")).when(F.contains(raw, F.lit("@")), local).otherwise(short)
    return rows.withColumn("name", name).drop("letter")


def merged_turns(turns: DataFrame, speaker: str = "name") -> DataFrame:
    """doc_id, turn, speaker, text: consecutive turns of one speaker made one."""
    order = Window.partitionBy("doc_id").orderBy("turn")
    fresh = (~F.col(speaker).eqNullSafe(F.lag(speaker).over(order))) | F.lag("turn").over(order).isNull()
    rows = turns.withColumn("block", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), " ")
    return rows.groupBy("doc_id", "block").agg(F.min("turn").alias("turn"), F.min_by(speaker, "turn").alias("speaker"), text.alias("text")).drop("block")
