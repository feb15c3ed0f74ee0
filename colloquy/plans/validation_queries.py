"""Validation queries: document labels as gold, arithmetic on ids as what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import validation as V
from colloquy.plans.driver_tables import table

__all__ = ["QUERIES", "SQL"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = labels.join(docs, "doc_id")
    found = F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") > 800)
    return rows.select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("gold"), found.alias("found"), "toxic")


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: items are the topics of users, found ones those with an even event."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("field"), F.col("user_id").alias("sample"), (F.col("event_id") % 7).alias("item"), "event_id")
    return V.set_scores(rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0"))


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 by language."""
    return V.binary_scores(_pairs(spark, sf_dir), ("lang",))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: accuracy without abstentions."""
    return V.accuracy(_pairs(spark, sf_dir), ("lang",))


def band_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: mean distance from the middle of a gold range."""
    rows = _pairs(spark, sf_dir).select("lang", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 101).alias("score"), (F.col("doc_id") % 50).alias("low"), (F.col("doc_id") % 50 + 20).alias("high"))
    return V.band_error(rows, ("lang",))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: three bands against three bands."""
    band = lambda c: F.when(c % 101 >= 67, "high").when(c % 101 >= 34, "medium").otherwise("low")
    rows = table(spark, sf_dir, "orders").select(band(F.col("o_orderkey") * 7).alias("gold"), band(F.col("o_custkey") * 3).alias("found"))
    return V.confusion(rows, ("low", "medium", "high"))


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 of document lengths by language."""
    return V.nearest_rank(table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("value")), (50, 95, 100), ("lang",))


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: events of users that should have none."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.col("user_id").alias("sample"))
    return V.false_positives(e, e.where("sample % 5 = 0"))


def role_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the roles of chats against the side of their turn's parity."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    side = lambda b: F.when(b, "seller").otherwise("client")
    rows = c.select(F.col("conv_id").alias("sample"), F.col("turn").alias("position"), side(F.col("role") == "assistant").alias("gold"), side(F.col("turn") % 2 == 1).alias("found"), (F.length("text") > 40).alias("decided"))
    return V.role_accuracy(rows)


def holdout_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: event values by type in two parts."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("field"), F.when(F.col("event_id") % 5 < 3, "dev").otherwise("holdout").alias("part"), ((F.col("event_id") % 100) / 100).alias("f1"))
    out = V.holdout_gap(rows)
    return out.select("field", *(F.round(c, 9).alias(c) for c in ("dev", "holdout", "gap")), "suspect")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotated samples."""
    k = F.col("o_orderkey")
    some = lambda test, value: F.when(test, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))
    part = F.when(F.col("o_orderstatus") == "F", "holdout").otherwise("dev").alias("part")
    objections = F.when(k % 4 == 0, F.array(F.lit("price"))).when(k % 4 == 1, F.array(F.lit("time"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(
        part, some(k % 3 == 0, "rival").alias("rivals"), objections.alias("objections"), some(k % 11 == 0, "finance").alias("units"), (k % 5 == 0).alias("churn"), (k % 7 == 0).alias("upsell"),
        F.when(k % 2 == 0, F.col("o_totalprice")).alias("budget"), F.col("o_orderpriority").alias("scenario"),
    )
    return V.corpus_coverage(rows, "price", ("finance",))


QUERIES = {
    f"validation_{f.__name__}": f
    for f in (set_scores, binary_scores, accuracy, band_error, confusion, percentile_nearest, false_positives, role_accuracy, holdout_gap, coverage)
}

PAIRS = """p AS (
  SELECT doc_id, lang, n_chars, quality = 1 AS gold, CASE WHEN doc_id % 11 <> 0 THEN n_chars > 800 END AS found
  FROM labels JOIN documents USING (doc_id)
)"""
SCORES = """CASE WHEN hits + extra = 0 THEN 1.0 ELSE hits / (hits + extra) END AS precision,
  CASE WHEN hits + missed = 0 THEN 1.0 ELSE hits / (hits + missed) END AS recall"""
F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1"

SQL = {
    "validation_set_scores": f"""
WITH e AS (SELECT event_type AS field, user_id AS sample, event_id % 7 AS item, event_id FROM events),
g AS (SELECT DISTINCT field, sample, item FROM e WHERE event_id % 3 <> 0), f AS (SELECT DISTINCT field, sample, item FROM e WHERE event_id % 2 = 0),
s AS (
  SELECT coalesce(g.field, f.field) AS field, CAST(sum(CASE WHEN g.field IS NOT NULL AND f.field IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits,
    CAST(sum(CASE WHEN g.field IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN f.field IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed
  FROM g FULL JOIN f ON g.field = f.field AND g.sample = f.sample AND g.item = f.item GROUP BY 1
), r AS (SELECT *, {SCORES} FROM s) SELECT *, {F1} FROM r
""",
    "validation_binary_scores": f"""
WITH {PAIRS}, s AS (
  SELECT lang, CAST(count(*) FILTER (WHERE gold AND found) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE NOT gold AND found) AS BIGINT) AS extra,
    CAST(count(*) FILTER (WHERE gold AND NOT found) AS BIGINT) AS missed FROM p GROUP BY lang
), r AS (SELECT *, {SCORES} FROM s) SELECT *, {F1} FROM r
""",
    "validation_accuracy": f"""
WITH {PAIRS} SELECT lang, count(*) AS judged, CAST(count(*) FILTER (WHERE found = gold) AS BIGINT) AS right, count(*) FILTER (WHERE found = gold) / count(*) AS accuracy
FROM p WHERE found IS NOT NULL GROUP BY lang
""",
    "validation_band_error": f"""
WITH {PAIRS} SELECT lang, count(*) AS judged, avg(abs(n_chars % 101 - (doc_id % 50 + doc_id % 50 + 20) / 2)) AS mae FROM p WHERE doc_id % 11 <> 0 GROUP BY lang
""",
    "validation_confusion": """
WITH b AS (SELECT CASE WHEN o_orderkey * 7 % 101 >= 67 THEN 'high' WHEN o_orderkey * 7 % 101 >= 34 THEN 'medium' ELSE 'low' END AS gold,
  CASE WHEN o_custkey * 3 % 101 >= 67 THEN 'high' WHEN o_custkey * 3 % 101 >= 34 THEN 'medium' ELSE 'low' END AS found FROM orders)
SELECT gold, count(*) FILTER (WHERE found = 'low') AS low, count(*) FILTER (WHERE found = 'medium') AS medium, count(*) FILTER (WHERE found = 'high') AS high FROM b GROUP BY gold
""",
    "validation_percentile_nearest": """
WITH r AS (SELECT lang, n_chars AS value, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, CAST(percent AS INTEGER) AS percent, value FROM r, (SELECT unnest([50, 95, 100]) AS percent) WHERE i = least(n - 1, percent * n // 100)
""",
    "validation_false_positives": "SELECT event_type AS field, count(*) AS false_positives FROM events WHERE user_id % 5 = 0 GROUP BY 1",
    "validation_role_accuracy": """
WITH t AS (SELECT conv_id AS sample, turn, CASE role WHEN 'assistant' THEN 'seller' ELSE 'client' END AS gold, CASE turn % 2 WHEN 1 THEN 'seller' ELSE 'client' END AS found, length(text) > 40 AS decided
  FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT sample, count(*) AS judged, count(*) FILTER (WHERE gold = found) AS ok, count(*) FILTER (WHERE (turn = 0) = (gold = 'seller')) AS first_right,
  coalesce(bool_and(gold <> found) FILTER (WHERE decided), false) AS inverted FROM t GROUP BY sample)
SELECT CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(ok) AS BIGINT) AS right, CAST(sum(first_right) AS BIGINT) AS first_right, CAST(sum(inverted::INT) AS BIGINT) AS inverted FROM s
""",
    "validation_coverage": """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS dev, count(*) FILTER (WHERE o_orderstatus = 'F') AS holdout, count(*) FILTER (WHERE k % 3 = 0) AS with_rival, count(*) FILTER (WHERE k % 4 = 0) AS with_price, count(*) FILTER (WHERE k % 5 = 0) AS with_churn,
  count(*) FILTER (WHERE k % 7 = 0) AS with_upsell, count(*) FILTER (WHERE k % 2 = 0) AS with_budget, count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 NOT IN (0, 1) AND k % 5 <> 0 AND k % 7 <> 0 AND k % 2 <> 0) AS without_signal,
  count(*) FILTER (WHERE k % 11 = 0) AS unit_finance, count(DISTINCT o_orderpriority) AS scenarios FROM (SELECT *, o_orderkey AS k FROM orders)
""",
    "validation_holdout_gap": """
WITH r AS (SELECT event_type AS field, avg((event_id % 100) / 100) FILTER (WHERE event_id % 5 < 3) AS dev, avg((event_id % 100) / 100) FILTER (WHERE event_id % 5 >= 3) AS holdout FROM events GROUP BY 1)
SELECT field, round(dev, 9) AS dev, round(holdout, 9) AS holdout, round(abs(dev - holdout), 9) AS gap, abs(dev - holdout) > 0.15 AS suspect FROM r
""",
}
