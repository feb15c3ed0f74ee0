"""Ingestion queries over documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.storage import ensure_checkpoint_dir
from colloquy.functions.text import matches
from colloquy.operators import ingest as I
from colloquy.operators.store import MeetingStore, keyed
from colloquy.plans.driver_tables import table

__all__ = ["QUERIES", "SQL"]


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16."""
    rows = I.batch_duplicates(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return rows.select("doc_id", "first_id", "kind", "reason")


def meeting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all documents, and whether an earlier one already has the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", I.meeting_key(F.col("source"), F.col("lang"), F.col("text")).alias("meeting_key"))
    again = docs.groupBy("meeting_key").agg(F.min("doc_id").alias("first_id"))
    later = docs.join(again, "meeting_key").where("doc_id > first_id")
    new = I.new_meetings(docs.withColumn("own", F.struct("doc_id", "meeting_key")), later.select(F.struct("doc_id", "meeting_key").alias("own")), "own")
    return new.select("doc_id", "meeting_key", F.lit(False).alias("known")).unionByName(later.select("doc_id", "meeting_key", F.lit(True).alias("known")))


def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages' URLs against a manifest of base names."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    manifest = pages.select(name.alias("file"), F.col("page_id").alias("ordinal"), F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("title"))
    return I.manifest_join(pages.select("path").distinct(), manifest).select("path", "ordinal", "title")


def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of quoted words."""
    docs = table(spark, sf_dir, "documents")
    quoted = lambda p: docs.select("doc_id", F.posexplode(matches(F.lower("text"), p)).alias("ordinal", "m")).select("doc_id", "ordinal", F.col("m.text").alias("quote"), "m.start", "m.end")
    return I.evidence_index({"mail": quoted("[a-z0-9.]+@"), "number": quoted("[0-9]+")})


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines of a batch."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", I.csv_line([F.col("doc_id"), F.col("source"), F.col("text"), F.col("n_chars")]).alias("line"))


def ingested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as meetings of customers by language and source, through three commits: the English ones, all, all again."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("lang").alias("organisation"), F.col("source").alias("customer"), F.col("n_chars").cast("string").alias("title"), F.lit("2024-01-01").alias("meeting_date"), "text", F.length("text").alias("size")
    )
    meetings = keyed(rows)
    store = MeetingStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    for batch, some in (("english", meetings.where("organisation = 'en'")), ("all", meetings), ("all", meetings)):
        store.ingest(batch, some.drop("size"), {"sizes": some.select("meeting_key", "size").distinct()})
    sizes = store.table("sizes").join(store.meetings().select("meeting_key", "customer_key"), "meeting_key").groupBy("customer_key").agg(F.sum("size").cast("long").alias("characters"))
    return store.customers().join(sizes, "customer_key", "left").select("organisation", "customer", "meetings", "characters")


QUERIES = {f.__name__: f for f in (ingested_customers, content_dedup, meeting_keys, manifest_join, evidence_index, batch_report)}


def _offsets(kind: str, pattern: str) -> str:
    hits, pieces = f"regexp_extract_all(lower(text), '{pattern}')", f"string_split_regex(lower(text), '{pattern}')"
    return f"""SELECT '{kind}' AS kind, doc_id, i - 1 AS ordinal, hit AS quote, start, start + length(hit) AS "end" FROM (
  SELECT doc_id, i, hit, sum(length(b)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest({hits}) AS hit, unnest({pieces}[:len({hits})]) AS b, generate_subscripts({hits}, 1) AS i FROM documents))"""


SQL = {
    "ingested_customers": """
SELECT lang AS organisation, source AS customer, count(*) AS meetings, CAST(sum(length(text)) AS BIGINT) AS characters
FROM (SELECT DISTINCT lang, source, n_chars, text FROM documents) GROUP BY lang, source
""",
    "content_dedup": r"""
WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS k FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first_id FROM k)
SELECT doc_id, first_id, CASE WHEN doc_id <> first_id THEN 'ignored' ELSE 'text' END AS kind, CASE WHEN doc_id <> first_id THEN 'duplicate' END AS reason FROM f
""",
    "meeting_keys": """
WITH k AS (SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) AS meeting_key FROM documents)
SELECT doc_id, meeting_key, doc_id > min(doc_id) OVER (PARTITION BY meeting_key) AS known FROM k
""",
    "manifest_join": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), m AS (SELECT string_split(path, '/')[-1] AS file, page_id AS ordinal, 'title ' || page_id AS title FROM p),
forms AS (
  SELECT ordinal, title, lower(file) AS form FROM m UNION SELECT ordinal, title, regexp_replace(lower(file), '\.[^.]*$', '') FROM m
), l AS (
  SELECT path, 0 AS rank, lower(path) AS form FROM p UNION SELECT path, 1, string_split(lower(path), '/')[-1] FROM p UNION SELECT path, 2, regexp_replace(string_split(lower(path), '/')[-1], '\.[^.]*$', '') FROM p
), j AS (SELECT l.path, ordinal, title FROM l JOIN forms USING (form) QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY rank, ordinal) = 1)
SELECT DISTINCT p.path, ordinal, title FROM p LEFT JOIN j ON j.path = p.path
""",
    "evidence_index": _offsets("mail", "[a-z0-9.]+@") + " UNION ALL " + _offsets("number", "[0-9]+"),
    "batch_report": """
SELECT doc_id, doc_id || ';' || coalesce(source, '') || ';' || CASE WHEN regexp_matches(text, '[;"' || chr(13) || chr(10) || ']') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END || ';' || coalesce(CAST(n_chars AS VARCHAR), '') AS line FROM documents
""",
}
