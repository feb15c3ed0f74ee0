"""Captions, speaker names, tables and time stamps: the driver's chats written as such files and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.transcripts import clean_text
from colloquy.plans.driver_tables import table
from colloquy.sources import captions as C
from colloquy.sources import tables as T

__all__ = ["QUERIES", "SQL"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


def _joined(rows: DataFrame, line: Column, by: str, head: str = "") -> DataFrame:
    """path, text: the lines of a conversation as one file."""
    lines = rows.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return lines.select("path", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r.line), by)).alias("text"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WebVTT: a cue a turn, nine seconds apart and four to eight long; users' cues have no voice."""
    rows = _turns(spark, sf_dir)
    stamp = lambda s: F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"), F.lit(".500"))
    start = F.col("turn") * 9
    voice = F.when(F.col("role") == "user", "").otherwise(F.concat(F.lit("<v "), "role", F.lit(">")))
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), stamp(start), F.lit(" --> "), stamp(start + 4 + F.col("conv_id") % 5), F.lit("\n"), voice, F.regexp_replace("text", r"\n\s*", "\n"))
    return _joined(rows, cue, "\n\n", "WEBVTT\n\n")


def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with times, voices and lines."""
    rows = C.caption_cues(_captions(spark, sf_dir))
    return rows.select("path", F.col("cue").cast("long").alias("cue"), F.col("start").alias("from_second"), F.col("end").alias("to_second"), "speaker", F.md5(F.col("line").cast("binary")).alias("line_md5"))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as text, a line for each stretch of a voice, or without a pause where nobody is named."""
    return C.captions_to_text(C.caption_cues(_captions(spark, sf_dir))).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic labels by first appearance, mail addresses and long names, and the turns of one name made one."""
    raw = F.when(F.col("role") == "user", F.concat(F.lit("Speaker "), (F.col("conv_id") % 4).cast("string"))).when(F.col("role") == "system", "maria.da_silva@example.com").when(F.col("conv_id") % 2 == 0, "Locutor").otherwise("Ana Clara de Souza")
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", raw.alias("speaker"), "text")
    merged = C.merged_turns(C.normalised_speakers(rows))
    return merged.select("doc_id", "turn", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files with quoted fields, recognised as meetings or as utterances by their header and cells."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    files = _joined(_turns(spark, sf_dir), F.concat(F.col("role"), F.lit(";"), quote(F.concat("text", F.lit('; "sim"')))), "\n", "Falante;Texto\n")
    rows = T.tables_to_texts(T.delimited_rows(files))
    return rows.select("path", F.col("row").cast("long").alias("row"), "shape", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to read, without time stamps, double blanks and empty lines."""
    stamp = F.concat(F.lit("["), F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"), F.lit(":05] "), F.lit("(1:02:33)\t\t"))
    text = F.concat(stamp, F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ".\n\n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text(text).cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (caption_cues, caption_texts, speaker_names, table_texts, clean_texts)}

_CUES = r"""said AS (
  SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue, turn * 9 + 0.5::DOUBLE AS s, turn * 9 + 4 + conv_id % 5 + 0.5::DOUBLE AS e,
    CASE WHEN role <> 'user' THEN role END AS speaker, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS line FROM conversations
), cues AS (
  SELECT * REPLACE (CASE WHEN starts_with(line, coalesce(before, chr(0))) THEN trim(substr(line, length(before) + 1)) ELSE line END AS line)
  FROM (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY cue) AS before FROM said WHERE line <> '')
)"""

SQL = {
    "caption_cues": f"WITH {_CUES} SELECT path, CAST(cue AS BIGINT) AS cue, s AS from_second, e AS to_second, speaker, md5(line) AS line_md5 FROM cues WHERE line <> ''",
    "caption_texts": f"""WITH {_CUES}, marked AS (
  SELECT *, CASE WHEN speaker IS NOT NULL AND speaker IS DISTINCT FROM lag(speaker) OVER w OR speaker IS NULL AND s - lag(e) OVER w >= 2.0 THEN 1 ELSE 0 END AS fresh FROM cues WHERE line <> '' WINDOW w AS (PARTITION BY path ORDER BY cue)
), blocks AS (
  SELECT path, block, arg_min(speaker, cue) FILTER (WHERE speaker IS NOT NULL) AS any_speaker, arg_min({{'s': speaker}}, cue).s AS speaker, string_agg(line, ' ' ORDER BY cue) AS line
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY cue) AS block FROM marked) GROUP BY path, block
)
SELECT path, md5(string_agg(CASE WHEN speaker IS NULL THEN line ELSE speaker || ': ' || line END, chr(10) ORDER BY block)) AS text_md5 FROM blocks GROUP BY path""",
    "speaker_names": r"""WITH raw AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN role = 'user' THEN 'speaker ' || conv_id % 4 WHEN role = 'system' THEN 'maria.da_silva@example.com' WHEN conv_id % 2 = 0 THEN 'locutor' ELSE 'Ana Clara de Souza' END AS raw FROM conversations
), named AS (
  SELECT r.*, CASE WHEN k IS NOT NULL THEN 'Falante ' || chr(CAST(64 + k AS INT)) WHEN contains(r.raw, '@') THEN 'Maria Da Silva' ELSE 'Ana Souza' END AS name
  FROM raw r LEFT JOIN (SELECT conv_id, raw, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS k FROM raw WHERE raw IN ('locutor') OR starts_with(raw, 'speaker ') GROUP BY conv_id, raw) g ON g.conv_id = r.conv_id AND g.raw = r.raw
), blocks AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS fresh FROM named))
SELECT conv_id AS doc_id, min(turn) AS turn, min(name) AS speaker, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM blocks GROUP BY conv_id, block""",
    "table_texts": r"""WITH said AS (
  SELECT CAST(conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, coalesce(text, '') || '; "sim"' AS said FROM conversations
), shaped AS (SELECT *, avg(length(said)) OVER (PARTITION BY path) >= 150 AS long FROM said)
SELECT path, CAST(k AS BIGINT) AS row, 'meetings' AS shape, md5(said) AS text_md5 FROM shaped WHERE long
UNION ALL SELECT path, 1, 'utterances', md5(string_agg(role || ': ' || said, chr(10) ORDER BY k)) FROM shaped WHERE NOT long GROUP BY path""",
    "clean_texts": r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('[' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':05] (1:02:33)' || chr(9) || chr(9) || regexp_replace(coalesce(text, ''), '\. ', '.' || repeat(chr(10), 4), 'g'),
  '\[?\(?\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\b\)?\]?', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS text_md5 FROM documents""",
}
