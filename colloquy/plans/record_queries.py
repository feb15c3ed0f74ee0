"""Queries over tables that change: re-analysis, portraits, the log of corrections, samples, the triage queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.storage import ensure_checkpoint_dir
from colloquy.operators import memory as M
from colloquy.operators import records as R
from colloquy.operators.portrait_table import PortraitTable
from colloquy.plans import driver_tables as D

__all__ = ["QUERIES", "SQL"]


def reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings that abstained are analysed anew, as the mean of the customer's other meetings."""
    seen = R.memory_without_self(D.meetings(spark, sf_dir).select("meeting_id", "customer_id", "meeting_date", "interest_score"), "interest_score")
    again = seen.where("interest_score is null")
    fresh = again.where("others > 0").select("meeting_id", F.lit(0).cast("long").alias("run"), F.floor(F.col("others_sum") / F.col("others")).cast("double").alias("score"))
    derived = D.analyses(spark, sf_dir).select("meeting_id", F.col("run").cast("long").alias("run"), F.col("score").cast("double").alias("score"))
    return R.reanalysed(derived, again, fresh)


def _portraits(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """Portraits of all customers or of ``keys``, from all meetings or those before a day."""
    some = lambda rows: rows if keys is None else rows.join(keys, "customer_id", "left_semi")
    early = lambda rows, day: rows if before is None else rows.where(F.to_date(day) < before)
    li = early(D._lines(spark, sf_dir), "o_orderdate")
    meetings = some(early(D.meetings(spark, sf_dir), "meeting_date"))
    offers = some(D.opportunities(spark, sf_dir))
    if before is not None:
        offers = offers.join(meetings.select("meeting_id"), "meeting_id", "left_semi")
    status = F.element_at(F.array(*map(F.lit, M.STATUSES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    products = li.select(F.col("o_custkey").alias("customer_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string")).alias("product"), status.alias("status"))
    objections = li.select(
        F.col("o_custkey").alias("customer_id"), F.col("l_orderkey").alias("meeting_id"), F.to_date("o_orderdate").alias("meeting_date"), F.col("l_linenumber").alias("ordinal"),
        (F.col("l_partkey") % 5).cast("string").alias("text"), (F.col("l_quantity") > 25).alias("resolved"),
    )
    rows = R.portraits(some(D.accounts(spark, sf_dir)), meetings, some(products), some(objections), offers)
    lists = (F.array_join(c, ", ").alias(c) for c in ("stack", "open_objections"))
    return rows.select("customer_id", "health", *lists, "trust_level", "upsell_potential")


def customer_portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portrait of every customer."""
    return _portraits(spark, sf_dir)


def portraits_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portraits of all customers from the meetings before a day, then of those who met on it or later."""
    day = "2001-07-15"
    table = PortraitTable(spark, f"{ensure_checkpoint_dir(spark)}/portraits-{uuid.uuid4().hex}", buckets=32)
    table.refresh(D.accounts(spark, sf_dir), lambda keys: _portraits(spark, sf_dir, keys, day))
    later = D.meetings(spark, sf_dir).where(F.col("meeting_date") >= day)
    table.refresh(later, lambda keys: _portraits(spark, sf_dir, keys))
    return table.rows()


def corrections_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as corrections, sent twice, some invalid: the log after both batches."""
    e, action = D.table(spark, sf_dir, "events"), F.array(*map(F.lit, (*R.ACTIONS, "drop")))[(F.col("event_id") % 5).cast("int")]
    field = F.when(F.col("user_id") % 7 > 0, F.concat(F.lit(" "), "event_type"))
    value = lambda c, name: (F.col(c) % 3).cast("string").alias(name)
    batch = e.select(F.col("event_id").alias("analysis_id"), "user_id", F.col("ts").alias("created_at"), field.alias("field"), action.alias("action"), value("user_id", "before_value"), value("event_id", "after_value"))
    log = R.new_corrections(batch, spark.createDataFrame([], "correction_key string"))
    log = log.unionByName(R.new_corrections(batch.unionByName(batch), log))
    return log.select("analysis_id", "user_id", "field", "action", "before_value", "after_value")


def corpus_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, titled by priority and day; titles with a pending order are loaded already."""
    o = D.table(spark, sf_dir, "orders")
    title = F.concat_ws(" ", "o_orderpriority", F.to_date("o_orderdate").cast("string"))
    corpus = o.select(title.alias("title"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").alias("sample_id"))
    return R.new_samples(corpus, o.where("o_orderstatus = 'P'").select(title.alias("title")))


def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines; those labelled good are judged already."""
    docs = D.table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "customer").otherwise("internal")
    lines = docs.select(F.concat(F.to_json(F.struct(F.col("doc_id").alias("id"), kind.alias("kind"), "text")), F.lit(",")).alias("value"))
    judged = D.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    queue = R.triage_queue(R.triage_records(lines, "id long, kind string, text string"), judged)
    return queue.select("id", F.length("text").cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (reanalysis, customer_portraits, portraits_by_change, corrections_log, corpus_samples, triage_queue)}

STRONGEST = ", ".join(f"'{s}'" for s in M.STATUSES)
SQL = {
    "reanalysis": """
WITH m AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 7 % 101 END AS s FROM orders),
k AS (SELECT id, s, count(s) OVER w AS n, sum(s) OVER w AS total FROM m WINDOW w AS (PARTITION BY c ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_orderkey AS meeting_id, CAST(l_linenumber AS BIGINT) AS run, CAST(l_quantity AS DOUBLE) AS score FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM m WHERE s IS NULL)
UNION ALL SELECT id, 0, CAST(floor(total / n) AS DOUBLE) FROM k WHERE s IS NULL AND n > 0
""",
    "customer_portraits": f"""
WITH li AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey AS c, 'p' || (l_suppkey % 7) || ': ' || ([{STRONGEST}])[min(l_partkey % 4) + 1] AS item FROM li GROUP BY o_custkey, l_suppkey % 7),
b AS (SELECT o_custkey AS c, CAST(l_partkey % 5 AS VARCHAR) AS item FROM li GROUP BY 1, 2 HAVING NOT arg_max(l_quantity > 25, (d, l_orderkey, l_linenumber, l_quantity > 25))),
m AS (SELECT o_custkey AS c, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS id FROM orders GROUP BY 1),
u AS (SELECT l_orderkey AS id, CAST(floor(sum(l_extendedprice * l_discount * 8) + 0.5) AS BIGINT) AS upsell FROM lineitem GROUP BY 1)
SELECT c_custkey AS customer_id, CAST(c_custkey * 37 % 101 AS INTEGER) AS health, coalesce((SELECT string_agg(item, ', ' ORDER BY item) FROM p WHERE c = c_custkey), '') AS stack,
  coalesce((SELECT string_agg(item, ', ' ORDER BY item) FROM b WHERE c = c_custkey), '') AS open_objections, CAST(coalesce(m.id * 11 % 101, 50) AS INTEGER) AS trust_level, CASE WHEN upsell > 0 THEN upsell END AS upsell_potential
FROM customer LEFT JOIN m ON m.c = c_custkey LEFT JOIN u ON u.id = m.id
""",
    "corrections_log": """
SELECT DISTINCT event_id AS analysis_id, user_id, trim(event_type) AS field, (['add', 'edit', 'remove', 'confirm'])[event_id % 5 + 1] AS action, CAST(user_id % 3 AS VARCHAR) AS before_value, CAST(event_id % 3 AS VARCHAR) AS after_value
FROM events WHERE event_id % 5 < 4 AND user_id % 7 > 0 AND length(trim(event_type)) BETWEEN 1 AND 60
""",
    "corpus_samples": """
WITH s AS (SELECT o_orderpriority || ' ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS title, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS customer, o_orderkey AS sample_id, o_orderstatus AS status FROM orders)
SELECT title, date, customer, sample_id FROM s WHERE title NOT IN (SELECT title FROM s WHERE status = 'P') QUALIFY row_number() OVER (PARTITION BY title ORDER BY date, sample_id) = 1
""",
    "triage_queue": "SELECT doc_id AS id, length(text) AS chars FROM documents WHERE lang = 'en' AND length(text) >= 2000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
}
SQL["portraits_by_change"] = SQL["customer_portraits"]
