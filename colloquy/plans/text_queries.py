"""Text preparation and interpretation over whole documents, with lexicons of words that occur there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import sentiment as E
from colloquy.operators.scores import quality_index
from colloquy.plans.driver_tables import table

__all__ = ["QUERIES", "SQL"]

POSITIVE = {"the": 0.5, "der": 0.6, "la": 0.4, "de": 0.3}
NEGATIVE = {"of": -0.5, "und": -0.6, "que": -0.4, "en": -0.2}
FACTORS = {"is": -1.0, "to": 1.5, "le": 0.5, "die": -1.0}
LEXICON = E.SentimentLexicon(POSITIVE | NEGATIVE, FACTORS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts (as digests) and what was masked."""
    email = tuple(r for r in X.REDACTION_RULES if r[0] == "email")
    docs = _docs(spark, sf_dir)
    found = X.matches(F.col("text"), email[0][1])
    return docs.select(
        "doc_id", F.md5(X.redact(F.col("text"), email).cast("binary")).alias("masked"), F.size(found).alias("n"), F.array_join(F.transform(found, lambda m: m.start.cast("string")), ",").alias("starts")
    )


def fold_and_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, T9."""
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"), X.count_words(F.col("text")).alias("words"))


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 with runs of digits for marks."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.blank(F.col("text"), "[0-9]+").cast("binary")).alias("blanked"))


def quality_index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: reliability from words, fillers, marks, sentences."""
    docs = _docs(spark, sf_dir)
    words = X.count_words(F.col("text"))
    fillers = F.regexp_count(F.lower("text"), F.lit(X.bounded("the|de|der"))).cast("long")
    sentences = F.regexp_count("text", F.lit("[.]")).cast("long")
    marks = F.regexp_count("text", F.lit("[0-9]+")).cast("long")
    k = F.col("doc_id")
    return docs.select("doc_id", quality_index(words, fillers, marks, sentences, k % 3 != 0, k % 11, k % 2).alias("reliability"))


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups of patterns a text mentions as whole words."""
    folded = X.fold(F.col("text"))
    groups = {"articles": "der|the|la|el", "links": "and|und|y|et"}
    return _docs(spark, sf_dir).select("doc_id", *(X.mentions(folded, p).alias(g) for g, p in groups.items()))


def lexicon_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a pattern, each with its context."""
    folded = X.fold(F.col("text"))
    hits = F.explode(X.matches(folded, "with[a-z]+")).alias("m")
    rows = _docs(spark, sf_dir).select("doc_id", "text", hits)
    return rows.select("doc_id", "m.start", "m.end", "m.text", X.context(F.col("text"), F.col("m.start"), F.col("m.end"), 10).alias("context"))


def clause_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of a text cut before connectives."""
    folded = X.fold(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(X.clauses(folded, ("the", "und", "que"))).cast("long").alias("clauses"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.posexplode(F.split(X.fold(F.col("text")), r"[.]", -1)).alias("k", "text")
    return _docs(spark, sf_dir).select("doc_id", parts)


def sentiment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: scores of sentences with three-token windows."""
    rows = E.clause_scores(_sentences(spark, sf_dir), LEXICON)
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), F.round(F.col("score") + 1e-12, 9).alias("score"), F.col("terms").cast("long").alias("terms"))


def sentiment_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by their sentences."""
    rows = E.overall_sentiment(E.clause_scores(_sentences(spark, sf_dir), LEXICON))
    return rows.select("doc_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "positive", "negative", "sentiment")


_ALL = (redact_email, fold_and_wordcount, blanked, quality_index_scores, lexicon_hits, lexicon_offsets, clause_count, sentiment_window, sentiment_overall)
QUERIES = {f.__name__: f for f in _ALL}

FOLD = f"translate(replace(lower(replace(text, 'İ', chr(57344))), chr(57344), 'İ'), '{X.ACCENTED}', '{X.UNACCENTED}')"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]"


def _zipped(pattern: str, by: str, text: str = "text") -> str:
    """SQL that replaces each match m of a pattern by an expression, piece by piece."""
    hits = f"regexp_extract_all({text}, '{pattern}')"
    return f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), {hits}), lambda z: z[1] || coalesce({by.format(m='z[2]')}, '')), '')"


_SCORES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (POSITIVE | NEGATIVE).items())
_FACTORS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FACTORS.items())
TERMS = f"""s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS text FROM (SELECT doc_id, string_split({FOLD}, '.') AS p FROM documents)),
t AS (SELECT doc_id, k, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, k, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM s)),
f AS (SELECT *, CASE token {_SCORES} END AS base, CASE token {_FACTORS} ELSE 1.0 END AS factor FROM t),
g AS (SELECT doc_id, k, base * coalesce(lag(factor, 3) OVER w, 1.0) * coalesce(lag(factor, 2) OVER w, 1.0) * coalesce(lag(factor, 1) OVER w, 1.0) AS x FROM f WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
c AS (SELECT doc_id, k, greatest(-1.0, least(1.0, avg(x::DOUBLE))) AS score, count(*) AS terms FROM g WHERE x IS NOT NULL GROUP BY 1, 2)"""

SQL = {
    "redact_email": f"""
SELECT doc_id, md5({_zipped(EMAIL, "regexp_replace({m}, '[^.\\-/() ]', '#', 'g')")}) AS masked, len(regexp_extract_all(text, '{EMAIL}')) AS n,
  coalesce((SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) FROM (
    SELECT i, sum(length(b)) OVER (ORDER BY i) + coalesce(sum(length(h)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM (SELECT unnest(string_split_regex(text, '{EMAIL}')[:len(regexp_extract_all(text, '{EMAIL}'))]) AS b, unnest(regexp_extract_all(text, '{EMAIL}')) AS h, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) AS i))), '') AS starts
FROM documents
""",
    "fold_and_wordcount": f"SELECT doc_id, md5({FOLD}) AS folded, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')) AS words FROM documents",
    "blanked": f"SELECT doc_id, md5({_zipped('[0-9]+', 'repeat(chr(32), length({m}))')}) AS blanked FROM documents",
    "quality_index_scores": r"""
WITH w AS (
  SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}''-]*')) AS words, len(regexp_extract_all(text, '[0-9]+')) AS marks, len(regexp_extract_all(text, '[.]')) AS sentences,
    len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x IN ('the', 'de', 'der'))) AS fillers, doc_id % 3 <> 0 AS diarised, doc_id % 11 AS speakers, doc_id % 2 AS unknown FROM documents
)
SELECT doc_id, CAST(greatest(0, least(100, 100 - CASE WHEN NOT diarised THEN 25 ELSE 0 END - least(30, floor(CASE WHEN sentences > 0 THEN marks / sentences ELSE 0 END * 200 + 0.5)) - CASE WHEN words < 150 THEN 15 ELSE 0 END
  - CASE WHEN words > 0 AND fillers / words > 0.08 THEN 10 ELSE 0 END - CASE WHEN diarised AND speakers < 2 THEN 10 ELSE 0 END
  - CASE WHEN diarised AND speakers > 6 THEN least(45, 15 + (speakers - 6) * 2) WHEN diarised AND unknown > 0 THEN 8 ELSE 0 END)) AS INTEGER) AS reliability FROM w
""",
    "lexicon_hits": f"""
WITH f AS (SELECT doc_id, ' ' || {FOLD} || ' ' AS t FROM documents)
SELECT doc_id, regexp_matches(t, '[^\\p{{L}}\\p{{N}}](?:der|the|la|el)[^\\p{{L}}\\p{{N}}]') AS articles, regexp_matches(t, '[^\\p{{L}}\\p{{N}}](?:and|und|y|et)[^\\p{{L}}\\p{{N}}]') AS links FROM f
""",
    "lexicon_offsets": f"""
WITH f AS (SELECT doc_id, text, {FOLD} AS t FROM documents),
h AS (SELECT doc_id, text, unnest(regexp_extract_all(t, 'with[a-z]+')) AS hit, unnest(string_split_regex(t, 'with[a-z]+')[:len(regexp_extract_all(t, 'with[a-z]+'))]) AS before, generate_subscripts(regexp_extract_all(t, 'with[a-z]+'), 1) AS i FROM f),
p AS (SELECT doc_id, text AS whole, hit, CAST(sum(length(before)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, start, CAST(start + length(hit) AS INTEGER) AS "end", hit AS text, substr(whole, greatest(0, start - 10) + 1, start + length(hit) + 10 - greatest(0, start - 10)) AS context FROM p
""",
    "clause_count": f"""
WITH RECURSIVE f AS (SELECT doc_id, {FOLD} AS t FROM documents),
m AS (SELECT doc_id, t, string_split_regex(regexp_replace(t, '\\b(the|und|que)\\b', chr(1) || '\\1', 'g'), chr(1)) AS c FROM f)
SELECT doc_id, len(list_filter(c, lambda x: length(x) >= 3)) AS clauses FROM m
""",
    "sentiment_window": f"WITH {TERMS} SELECT doc_id, k, round(score + 1e-12::DOUBLE, 9) AS score, terms FROM c",
    "sentiment_overall": f"""
WITH {TERMS}, d AS (
  SELECT doc_id, greatest(-1.0, least(1.0, sum(score * terms) / sum(terms))) AS score, count(*) FILTER (WHERE score >= 0.22) AS positive, count(*) FILTER (WHERE score <= -0.22) AS negative FROM c GROUP BY 1
)
SELECT doc_id, round(score + 1e-9::DOUBLE, 6) AS score, positive, negative,
  CASE WHEN least(positive, negative) * 4 >= positive + negative AND (least(positive, negative) >= 2 OR (positive + negative <= 6 AND least(positive, negative) >= 1)) THEN 'mixed'
    WHEN score >= 0.22 THEN 'positive' WHEN score <= -0.22 THEN 'negative' ELSE 'neutral' END AS sentiment FROM d
""",
}
