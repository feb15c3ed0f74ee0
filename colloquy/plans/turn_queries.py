"""Queries over ``conversations`` as sellers' (assistant) and clients' (user) turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import turns as T
from colloquy.plans.driver_tables import turns

__all__ = ["QUERIES", "SQL"]

#: The driver's chats have no question mark; "the" words of their openings stand in for one.
MARK = ","
OPENINGS = ("th", "an", "on", "er", "de", "en")


def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: talk ratio, turn count and longest monologue of every conversation."""
    rows = turns(spark, sf_dir)
    ratio = T.talk_ratio(rows).select("conv_id", "turn_count", "seller_words", "client_words", F.round("talk_ratio_seller", 6).alias("talk_ratio_seller"))
    return ratio.join(T.longest_monologue(rows), "conv_id")


def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4 with a comma for the question mark."""
    rows = turns(spark, sf_dir)
    return T.questions(rows, MARK, OPENINGS).join(T.words_before_question(rows, MARK), "conv_id")


def interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 with only some full stops as final marks."""
    return T.interruptions(turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(e|n)\.$", "$1")), ".!?")


def followup_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 with a word for the question mark."""
    return T.followup_depth(turns(spark, sf_dir), " the ")


QUERIES = {f.__name__: f for f in (turn_metrics, question_metrics, interruptions, followup_depth)}

WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*'))"

TURNS = f"""
t AS (
  SELECT conv_id, turn, role AS speaker, CASE role WHEN 'assistant' THEN 'seller' ELSE 'client' END AS side, text, {WORDS.format("text")} AS words
  FROM conversations WHERE role IN ('assistant', 'user')
)"""

SQL = {
    "turn_metrics": f"""
WITH {TURNS}, i AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (
    SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM t)
), m AS (
  SELECT conv_id, CAST(max(w) AS BIGINT) AS longest_monologue_words FROM (
    SELECT conv_id, island, sum(CASE WHEN side = 'seller' THEN words ELSE 0 END) AS w FROM i GROUP BY conv_id, island) GROUP BY conv_id
), r AS (
  SELECT conv_id, count(*) AS turn_count, CAST(sum(CASE WHEN side = 'seller' THEN words ELSE 0 END) AS BIGINT) AS seller_words,
    CAST(sum(CASE WHEN side = 'client' THEN words ELSE 0 END) AS BIGINT) AS client_words, count(DISTINCT side) AS sides FROM t GROUP BY conv_id
)
SELECT conv_id, turn_count, seller_words, client_words,
  CASE WHEN sides = 2 AND seller_words + client_words > 0 THEN round(seller_words / (seller_words + client_words), 6) END AS talk_ratio_seller, longest_monologue_words
FROM r JOIN m USING (conv_id)
""",
    "question_metrics": rf"""
WITH {TURNS}, q AS (
  SELECT conv_id, turn, words, text,
    CASE WHEN side = 'seller' THEN list_filter(list_transform(regexp_extract_all(text, '[^.!,]*[,]'), lambda x: trim(x)), lambda x: length(x) > 1) ELSE [] END AS found, side FROM t
), f AS (
  SELECT *, list_transform(found, lambda x: lower(strip_accents(x))) AS folded FROM q
), n AS (
  SELECT conv_id, sum(len(found)) AS seller_questions,
    sum(len(list_filter(folded, lambda x: regexp_matches(regexp_replace(regexp_replace(x, '^[^\p{{L}}]+', ''), '^(?:e|mas|entao|ai|ok|ta|bom|olha|agora|so que|so)\s+', ''), '^(?:th|an|on|er|de|en)')
      OR regexp_matches(regexp_replace(regexp_replace(regexp_extract(x, '([^:,;]*)$', 1), '^[^\p{{L}}]+', ''), '^(?:e|mas|entao|ai|ok|ta|bom|olha|agora|so que|so)\s+', ''), '^(?:th|an|on|er|de|en)')))) AS open_questions
  FROM f GROUP BY conv_id
), b AS (
  SELECT conv_id, turn, found, text, coalesce(sum(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q WHERE side = 'seller'
), w AS (
  SELECT conv_id, arg_min(before + {WORDS.format("regexp_extract(text, '(?s)^(.*?)[^.!,]*[,]', 1)")}, turn) AS n FROM b WHERE len(found) > 0 GROUP BY conv_id
)
SELECT n.conv_id, CAST(seller_questions AS BIGINT) AS seller_questions, CAST(open_questions AS BIGINT) AS open_questions,
  CAST(seller_questions - open_questions AS BIGINT) AS closed_questions, CAST(w.n AS BIGINT) AS words_before_first_question
FROM n LEFT JOIN w ON w.conv_id = n.conv_id
""",
    "interruptions": rf"""
WITH {TURNS}, x AS (SELECT * REPLACE (regexp_replace(text, '(e|n)\.$', '\1') AS text) FROM t), l AS (
  SELECT *, lag(speaker) OVER w AS s, lag(words) OVER w AS n, lag(text) OVER w AS p FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, CAST(sum(CASE WHEN s <> speaker AND n >= 3 AND NOT regexp_matches(trim(p), '[.!?]["'')\]]?$') THEN 1 ELSE 0 END) AS BIGINT) AS interruptions
FROM l GROUP BY conv_id
""",
    "followup_depth": f"""
WITH RECURSIVE {TURNS}, s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
    CASE WHEN side = 'client' THEN 'c' WHEN contains(text, ' the ') THEN 'q' ELSE 's' END AS kind FROM t
), r AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS depth, 0 AS chain, false AS waiting FROM s GROUP BY conv_id
  UNION ALL
  SELECT s.conv_id, s.k, greatest(depth, CASE WHEN kind = 'q' THEN CASE WHEN waiting THEN chain + 1 ELSE 1 END ELSE 0 END),
    CASE WHEN kind = 'q' THEN CASE WHEN waiting THEN chain + 1 ELSE 1 END ELSE chain END, CASE WHEN kind = 'c' THEN chain > 0 ELSE false END
  FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1
)
SELECT conv_id, CAST(max(depth) AS BIGINT) AS followup_depth FROM r GROUP BY conv_id
""",
}
