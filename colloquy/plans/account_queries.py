"""Queries across accounts: customers, their orders as meetings, order lines as tasks and opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import accounts as A
from colloquy.operators import export as E
from colloquy.operators import memory as M
from colloquy.operators import scores as S
from colloquy.plans import driver_tables as D

__all__ = ["QUERIES", "SQL"]

TOWER_COLUMNS = ("customer_id", "contract_value", "meetings", "last_contact", "interest_score", "churn_risk", "trust_score", "cycle_competitors", "open_tasks")


def _tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (f(spark, sf_dir) for f in (D.accounts, D.meetings, D.tasks, D.competitors))
    return A.control_tower(*parts).select(*TOWER_COLUMNS)


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest analysis of each meeting."""
    return M.latest_analyses(D.analyses(spark, sf_dir), "meeting_id", ("created_at", "run"))


def memory_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each meeting knows of earlier ones."""
    rows = M.memory_before(D.meetings(spark, sf_dir))
    return rows.select("meeting_id", "prior_meetings", F.col("prior_interest_count").cast("int").alias("n_interests"), "prior_interest_last", "has_memory")


def churn_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over the memory window: churn from signals, the interest's fall, objections and overdue tasks."""
    rows = M.memory_before(D.meetings(spark, sf_dir))
    k = F.col("meeting_id")
    risk = S.churn_risk(k % 60, F.when(k % 4 == 0, 20).when(k % 4 == 1, 12).otherwise(0), F.col("prior_interests"), k % 3, k % 2, k % 5)
    return rows.select("meeting_id", risk.alias("churn_risk"), S.band(risk).alias("band"))


def interest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and factor sum from facts, abstained for one status."""
    m = D.meetings(spark, sf_dir)
    facts = {name: F.col("meeting_id") % (i + 2) == 0 for i, name in enumerate(S.INTEREST)}
    rows = m.select("meeting_id", "churn_risk", S.interest_factors(facts, F.col("meeting_id") % 4).alias("f"))
    rows = rows.select("meeting_id", F.size("f").alias("factors"), S.interest_score(F.col("f")).alias("interest_score"), "churn_risk")
    return S.with_abstention(rows, F.col("churn_risk").isNotNull(), ("interest_score",)).select("meeting_id", "factors", "interest_score")


def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 from deltas and the client's share."""
    m = D.meetings(spark, sf_dir)
    k = F.col("meeting_id")
    deltas = F.array_compact(F.array(F.when(k % 2 == 0, 8), F.when(k % 3 == 0, -12), F.when(k % 5 == 0, 10), F.when(k % 7 == 0, -25)))
    return m.select("meeting_id", S.trust_score(deltas, F.col("talk_ratio")).alias("trust"))


def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 of every customer."""
    series = M.score_series(D.meetings(spark, sf_dir))
    last = D.meetings(spark, sf_dir).groupBy("customer_id").agg(F.max("meeting_date").alias("last"), F.count("*").alias("n"))
    task = M.task_status(D.tasks(spark, sf_dir), F.lit(D.AS_OF))
    rows = D.accounts(spark, sf_dir).select("customer_id").join(series, "customer_id", "left").join(last, "customer_id", "left").join(task, "customer_id", "left")
    k = F.col("customer_id")
    interests = F.coalesce("interests", F.array().cast("array<int>"))
    score = S.health_score(
        interests, F.datediff(F.lit(D.AS_OF), "last"), k % 4, k % 3, F.coalesce("done", F.lit(0)), F.coalesce("overdue", F.lit(0)), k % 2 == 0, F.coalesce("n", F.lit(0)) > 0
    )
    return rows.select("customer_id", score.alias("health"), S.band(score).alias("band"))


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types mentioned by customers, once for each order."""
    li = D._lines(spark, sf_dir)
    rows = li.select(
        F.col("o_custkey").alias("customer_id"), F.col("l_orderkey").alias("meeting_id"), F.to_date("o_orderdate").alias("meeting_date"), F.col("l_linenumber").alias("ordinal"),
        F.concat_ws("/", "l_returnflag", (F.col("l_partkey") % 5).cast("string")).alias("text"), (F.col("l_quantity") > 25).alias("resolved"),
    )
    return M.mention_counts(rows, F.split("text", "/")[1])


def stack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest status of a product with a customer."""
    li = D._lines(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, M.STATUSES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    return M.strongest_stack(li.select(F.col("o_custkey").alias("customer_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string")).alias("product"), status.alias("status")))


def competitor_portrait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return M.competitor_portrait(D.competitors(spark, sf_dir))


def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5."""
    return M.task_status(D.tasks(spark, sf_dir), F.lit(D.AS_OF))


def bant_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    k = F.col("meeting_id")
    rows = D.meetings(spark, sf_dir).select("customer_id", *((k % (i + 5) == 0).alias(c) for i, c in enumerate(("budget", "authority", "need", "timing"))))
    return M.bant_cycle(rows)


def tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return _tower(spark, sf_dir)


def accounts_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return A.at_risk(_tower(spark, sf_dir)).select("customer_id", "contract_value", "churn_risk", "cycle_competitors")


def revenue_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return A.revenue_at_risk(_tower(spark, sf_dir)).select("accounts", F.round("value", 2).alias("value"), "without_value")


def pipeline_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return A.pipeline_by_unit(D.opportunities(spark, sf_dir))


def idle_upsell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    last = D.meetings(spark, sf_dir).groupBy("customer_id").agg(F.max("meeting_date").alias("last_contact"))
    rows = A.idle_upsell(D.opportunities(spark, sf_dir), D.tasks(spark, sf_dir), last, D.AS_OF)
    return rows.select("customer_id", F.round("upsell", 2).alias("upsell"), "days_idle")


def hours_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return A.hours_returned(D.meetings(spark, sf_dir))


def radar_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the last 30 days."""
    return A.pain_radar(D.signals(spark, sf_dir), D.AS_OF_SIGNALS, 30)


def pain_radar_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar of one segment's customers and one unit's topics."""
    customers = D.accounts(spark, sf_dir).where("segment = 'BUILDING'")
    return A.pain_radar(D.signals(spark, sf_dir), D.AS_OF_SIGNALS, 30, customers, ("click", "view"))


POWERS = ("user", "influencer", "decider")


def customer_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most powerful persona and latest budget of each customer."""
    power = F.array(*map(F.lit, ("unknown", *POWERS)))[(F.col("meeting_id") * 3 % 5).cast("int")]
    rows = D.meetings(spark, sf_dir).withColumn("power", F.when(F.col("meeting_id") * 3 % 5 < 4, power))
    return M.customer_peaks(rows.withColumn("budget", F.when(F.col("churn_risk").isNotNull(), F.col("budget"))), POWERS)


def crm_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each meeting as a JSON and a CSV document."""
    rows = E.crm_rows(*(f(spark, sf_dir) for f in (D.meetings, D.opportunities, D.competitors)))
    return rows.select("meeting_id", E.json_document(rows.columns).alias("json"), E.csv_document(rows.columns).alias("csv"))


def radar_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six newest signals of each topic."""
    return A.pain_examples(D.signals(spark, sf_dir), D.AS_OF_SIGNALS).select("topic", "rank", "signal_id", "customer_id")


def radar_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by unit."""
    return A.pain_units(A.pain_radar(D.signals(spark, sf_dir), D.AS_OF_SIGNALS), {"click": "web", "view": "web", "purchase": "sales"})


def alerts_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return A.alerts(D.meetings(spark, sf_dir), D.competitors(spark, sf_dir), D.opportunities(spark, sf_dir))


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """managers' alerts."""
    return A.alert_counts(alerts_top1(spark, sf_dir), audience="manager")


def coaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    rows = A.coaching(D.meetings(spark, sf_dir))
    return rows.select("seller_id", "meetings", *(F.round(c, 6).alias(c) for c in ("talk_ratio", "monologue", "questions", "ideal_share")), "verdict")


def overdue_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return A.overdue_tasks(D.tasks(spark, sf_dir), D.AS_OF).select("task_id", "days_late")


def worst_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's six accounts of worst health."""
    return D.accounts(spark, sf_dir).orderBy("health", "customer_id").limit(6).select("customer_id", "health")


def latest_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's eight newest meetings."""
    return A.latest_meetings(D.meetings(spark, sf_dir)).select("meeting_id", "customer_id", "meeting_date")


def treatment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was treated in all."""
    rows = D.meetings(spark, sf_dir).select("reliability", F.col("monologue").alias("words"), F.col("questions").alias("turns"), F.col("talk_ratio").isNotNull().alias("diarised"))
    return A.treatment_totals(rows).withColumn("reliability", F.round("reliability", 6))


def customer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return A.customer_list(D.accounts(spark, sf_dir), D.meetings(spark, sf_dir)).select("customer_id", "health", "meetings", "last_contact")


def reliability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    rows = D.meetings(spark, sf_dir).select("reliability", F.col("monologue").alias("words"), F.col("questions").alias("turns"), F.col("talk_ratio").isNotNull().alias("diarised"))
    return A.reliability_histogram(rows)


def warnings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent warnings."""
    e = D.table(spark, sf_dir, "events")
    return A.top_warnings(e.select(F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("warning")))


def correction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return A.correction_rates(D.corrections(spark, sf_dir))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return A.table_counts({name: D.table(spark, sf_dir, name) for name in ("customer", "orders", "lineitem", "events", "conversations")})


_ALL = (
    latest_per_key, memory_prior, churn_pass, interest_scores, trust_scores, health_scores, mention_counts, stack_status, competitor_portrait, task_status, bant_cycle, tower,
    accounts_at_risk, revenue_at_risk, pipeline_by_unit, idle_upsell, hours_returned, customer_peaks, crm_export, radar_topics, pain_radar_segment, radar_examples, radar_units, alerts_top1, alert_counts, coaching, overdue_tasks,
    worst_accounts, latest_meetings, treatment_totals, customer_list, reliability_histogram, warnings_topk, correction_rates, table_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

DAY = f"DATE '{D.AS_OF}'"
SIGNAL_DAY = f"DATE '{D.AS_OF_SIGNALS}'"
MEETINGS = """m AS (
  SELECT o_orderkey AS meeting_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS meeting_date,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 7 % 101 END AS interest, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 13 % 101 END AS churn, o_orderkey * 11 % 101 AS trust,
    o_orderpriority AS seller_id, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 97) / 97.0::DOUBLE END AS talk_ratio, o_orderkey * 17 % 301 AS monologue, o_orderkey * 19 % 23 AS questions, o_orderkey * 5 % 101 AS reliability
  FROM orders
)"""
TASKS = "task AS (SELECT l_orderkey * 10 + l_linenumber AS task_id, o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS due, l_linestatus = 'F' AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
RIVALS = "rival AS (SELECT l_orderkey AS meeting_id, o_custkey AS customer_id, 'rival ' || (l_suppkey % 27) AS competitor, l_quantity > 40 AS active, CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS threat FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CHANCES = "chance AS (SELECT l_orderkey AS meeting_id, o_custkey AS customer_id, l_returnflag || '-' || l_linestatus AS unit, l_extendedprice AS value, l_discount * 8 AS probability FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TOWER = f"""{MEETINGS}, {TASKS}, {RIVALS}, tower AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS contract_value, coalesce(s.meetings, 0) AS meetings, s.last_contact, l.interest AS interest_score, l.churn AS churn_risk,
    l.trust AS trust_score, coalesce(r.n, 0) AS cycle_competitors, coalesce(t.n, 0) AS open_tasks
  FROM customer LEFT JOIN (SELECT customer_id, count(*) AS meetings, max(meeting_date) AS last_contact FROM m GROUP BY 1) s ON s.customer_id = c_custkey
  LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY meeting_date DESC, meeting_id DESC) = 1) l ON l.customer_id = c_custkey
  LEFT JOIN (SELECT customer_id, count(DISTINCT competitor) AS n FROM rival WHERE active GROUP BY 1) r ON r.customer_id = c_custkey
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM task WHERE NOT done GROUP BY 1) t ON t.customer_id = c_custkey
)"""
ALERTS = f"""{MEETINGS}, {RIVALS}, {CHANCES}, alert AS (
  SELECT meeting_id, 'churn' AS kind, 'high' AS severity, 'manager' AS audience, NULL AS subject FROM m WHERE churn >= 67
  UNION ALL SELECT meeting_id, 'competitor', threat, 'manager', competitor FROM rival WHERE active
    QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY CASE threat WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, competitor DESC) = 1
  UNION ALL SELECT meeting_id, 'opportunity', 'medium', 'seller', unit FROM chance WHERE probability >= 0.6
    QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY probability DESC, unit DESC) = 1
)"""
BAND = "CASE WHEN {0} >= 67 THEN 'high' WHEN {0} >= 34 THEN 'medium' WHEN {0} IS NOT NULL THEN 'low' END"
PRIOR = f"""{MEETINGS}, p AS (
  SELECT *, list(interest) FILTER (WHERE interest IS NOT NULL) OVER w AS prior, count(*) OVER w AS prior_meetings
  FROM m WINDOW w AS (PARTITION BY customer_id ORDER BY meeting_date, meeting_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_FACTS = " + ".join(f"CASE WHEN meeting_id % {i + 2} = 0 THEN {v} ELSE 0 END" for i, v in enumerate(S.INTEREST.values()))
_COUNT = " + ".join(f"(meeting_id % {i + 2} = 0)::INT" for i in range(len(S.INTEREST)))
LAST3 = "prior[greatest(1, len(prior) - 2):]"

SQL = {
    "latest_per_key": "SELECT l_orderkey AS meeting_id, l_shipdate AS created_at, l_linenumber AS run, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC) = 1",
    "memory_prior": f"WITH {PRIOR} SELECT meeting_id, prior_meetings, coalesce(len(prior), 0) AS n_interests, prior[-1] AS prior_interest_last, coalesce(len(prior), 0) > 0 AS has_memory FROM p",
    "churn_pass": f"""
WITH {PRIOR}, c AS (
  SELECT meeting_id, least(100.0, least(100.0, (meeting_id % 60) * 1.5) + CASE meeting_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 12 ELSE 0 END)::DOUBLE AS said,
    CASE WHEN len(prior) >= 2 THEN greatest(0, least(100, {LAST3}[1] - prior[-1])) END AS fall,
    CASE WHEN meeting_id % 3 > 0 THEN (meeting_id % 2) * 35 END AS objections, CASE WHEN meeting_id % 5 > 0 THEN least(100, meeting_id % 5 * 30) END AS late FROM p
), r AS (
  SELECT meeting_id, CAST(floor((0.0::DOUBLE + said * 0.6::DOUBLE + coalesce(fall * 0.2::DOUBLE, 0) + coalesce(objections * 0.1::DOUBLE, 0) + coalesce(late * 0.1::DOUBLE, 0))
    / (0.0::DOUBLE + 0.6::DOUBLE + CASE WHEN fall IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN objections IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN late IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END) + 0.5) AS INTEGER) AS churn_risk FROM c
) SELECT meeting_id, churn_risk, {BAND.format("churn_risk")} AS band FROM r
""",
    "interest_scores": f"""
WITH {MEETINGS}, f AS (SELECT meeting_id, churn, 50 + {_FACTS} + greatest(-30, -15 * (meeting_id % 4)) AS total, 1 + {_COUNT} + (meeting_id % 4 > 0)::INT AS n FROM m)
SELECT meeting_id, CAST(n + (total < 0 OR total > 100)::INT AS INTEGER) AS factors, CASE WHEN churn IS NOT NULL THEN CAST(greatest(0, least(100, total)) AS INTEGER) END AS interest_score FROM f
""",
    "trust_scores": f"""
WITH {MEETINGS} SELECT meeting_id, CAST(greatest(0, least(100, 50 + CASE WHEN meeting_id % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN meeting_id % 3 = 0 THEN -12 ELSE 0 END
  + CASE WHEN meeting_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN meeting_id % 7 = 0 THEN -25 ELSE 0 END + CASE WHEN talk_ratio < 0.2 THEN -10 ELSE 0 END)) AS INTEGER) AS trust FROM m
""",
    "health_scores": f"""
WITH {MEETINGS}, {TASKS}, s AS (
  SELECT customer_id, list(interest ORDER BY meeting_date, meeting_id) FILTER (WHERE interest IS NOT NULL) AS prior, max(meeting_date) AS last FROM m GROUP BY 1
), t AS (SELECT customer_id, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE NOT done AND due < {DAY}) AS late FROM task GROUP BY 1),
x AS (
  SELECT c_custkey AS customer_id, s.customer_id IS NOT NULL AS seen, prior[-1] AS interest, CASE WHEN len(prior) >= 2 THEN greatest(0, least(100, 50 + prior[-1] - {LAST3}[1])) END AS trend,
    CASE WHEN date_diff('day', last, {DAY}) <= 15 THEN 100 WHEN date_diff('day', last, {DAY}) >= 90 THEN 0 ELSE floor(100 - (date_diff('day', last, {DAY}) - 15) / 75 * 100 + 0.5) END AS recency, last,
    CASE WHEN c_custkey % 4 + c_custkey % 3 > 0 THEN floor(c_custkey % 3 / (c_custkey % 4 + c_custkey % 3) * 100 + 0.5) END AS objections,
    CASE WHEN done + late > 0 THEN floor(done / (done + late) * 100 + 0.5) END AS kept, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 25 END AS decision
  FROM customer LEFT JOIN s ON s.customer_id = c_custkey LEFT JOIN t ON t.customer_id = c_custkey
), w AS (
  SELECT *, coalesce(interest * 0.3::DOUBLE, 0) + coalesce(trend * 0.15::DOUBLE, 0) + coalesce(CASE WHEN last IS NOT NULL THEN recency END * 0.15::DOUBLE, 0) + coalesce(objections * 0.15::DOUBLE, 0) + coalesce(kept * 0.15::DOUBLE, 0) + decision * 0.1::DOUBLE AS total,
    CASE WHEN interest IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN trend IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN last IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN objections IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN kept IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE AS weight FROM x
), h AS (SELECT customer_id, CASE WHEN seen THEN CAST(floor(greatest(0, least(100, total / weight)) + 0.5) AS INTEGER) ELSE 50 END AS health FROM w)
SELECT customer_id, health, {BAND.format("health")} AS band FROM h
""",
    "mention_counts": """
WITH r AS (SELECT o_custkey AS customer_id, l_orderkey AS meeting_id, CAST(o_orderdate AS DATE) AS d, l_linenumber AS k, CAST(l_partkey % 5 AS VARCHAR) AS key, l_returnflag || '/' || (l_partkey % 5) AS text, l_quantity > 25 AS resolved
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT customer_id, key, count(DISTINCT meeting_id) AS meetings, arg_min(text, (d, meeting_id, k, text, resolved)) AS first_text, arg_max(text, (d, meeting_id, k, text, resolved)) AS last_text, arg_max(resolved, (d, meeting_id, k, text, resolved)) AS last_resolved FROM r GROUP BY 1, 2
""",
    "stack_status": """
SELECT o_custkey AS customer_id, 'p' || (l_suppkey % 7) AS product, (['em_uso', 'em_avaliacao', 'oportunidade', 'mencionado'])[min(l_partkey % 4) + 1] AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
""",
    "competitor_portrait": f"WITH {RIVALS} SELECT customer_id, competitor, count(*) AS mentions, bool_or(active) AS active FROM rival GROUP BY 1, 2",
    "task_status": f"""
WITH {TASKS} SELECT customer_id, count(*) FILTER (WHERE NOT done) AS open, count(*) FILTER (WHERE NOT done AND due < {DAY}) AS overdue, count(*) FILTER (WHERE done) AS done,
  CAST(max(date_diff('day', due, {DAY})) FILTER (WHERE NOT done AND due < {DAY}) AS INTEGER) AS most_days_late FROM task GROUP BY 1
""",
    "bant_cycle": f"""
WITH {MEETINGS}, c AS (SELECT customer_id, bool_or(meeting_id % 5 = 0) AS budget, bool_or(meeting_id % 6 = 0) AS authority, bool_or(meeting_id % 7 = 0) AS need, bool_or(meeting_id % 8 = 0) AS timing FROM m GROUP BY 1)
SELECT *, budget::INT + authority::INT + need::INT + timing::INT AS score FROM c
""",
    "tower": f"WITH {TOWER} SELECT * FROM tower",
    "accounts_at_risk": f"WITH {TOWER} SELECT customer_id, contract_value, churn_risk, cycle_competitors FROM tower WHERE churn_risk >= 34 OR cycle_competitors > 0",
    "revenue_at_risk": f"WITH {TOWER} SELECT count(*) AS accounts, round(coalesce(sum(contract_value), 0), 2) AS value, count(*) FILTER (WHERE contract_value IS NULL) AS without_value FROM tower WHERE churn_risk >= 67",
    "pipeline_by_unit": f"WITH {CHANCES} SELECT unit, count(*) AS opportunities, CAST(floor(sum(value * probability) + 0.5) AS BIGINT) AS weighted FROM chance GROUP BY 1",
    "idle_upsell": f"""
WITH {MEETINGS}, {TASKS}, {CHANCES}, u AS (SELECT customer_id, sum(value * probability) AS upsell FROM chance GROUP BY 1 HAVING sum(value * probability) > 0),
l AS (SELECT customer_id, max(meeting_date) AS last FROM m GROUP BY 1)
SELECT u.customer_id, round(upsell, 2) AS upsell, CAST(date_diff('day', last, {DAY}) AS INTEGER) AS days_idle FROM u JOIN l ON l.customer_id = u.customer_id
WHERE date_diff('day', last, {DAY}) >= 14 AND NOT EXISTS (SELECT 1 FROM task t WHERE t.customer_id = u.customer_id AND NOT done)
""",
    "hours_returned": f"WITH {MEETINGS} SELECT CAST(date_trunc('month', meeting_date) AS DATE) AS month, count(*) AS meetings, count(*) * 12 / 60 AS hours FROM m GROUP BY 1",
    "radar_topics": f"""
SELECT event_type AS topic, count(*) AS occurrences, count(DISTINCT user_id) AS clients, count(*) FILTER (WHERE CAST(ts AS DATE) >= {SIGNAL_DAY} - 15) AS recent, count(*) FILTER (WHERE CAST(ts AS DATE) < {SIGNAL_DAY} - 15) AS earlier,
  count(*) FILTER (WHERE CAST(ts AS DATE) >= {SIGNAL_DAY} - 15) - count(*) FILTER (WHERE CAST(ts AS DATE) < {SIGNAL_DAY} - 15) AS change
FROM events WHERE CAST(ts AS DATE) >= {SIGNAL_DAY} - 30 GROUP BY 1
""",
    "pain_radar_segment": f"""
SELECT event_type AS topic, count(*) AS occurrences, count(DISTINCT user_id) AS clients, count(*) FILTER (WHERE recent) AS recent, count(*) FILTER (WHERE NOT recent) AS earlier,
  count(*) FILTER (WHERE recent) - count(*) FILTER (WHERE NOT recent) AS change
FROM (SELECT *, CAST(ts AS DATE) >= {SIGNAL_DAY} - 15 AS recent FROM events WHERE CAST(ts AS DATE) >= {SIGNAL_DAY} - 30 AND event_type IN ('click', 'view'))
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1
""",
    "customer_peaks": """
WITH p AS (
  SELECT o_custkey AS customer_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey * 3 % 5 AS rank, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS budget FROM orders
), t AS (SELECT customer_id, id, ['unknown', 'user', 'influencer', 'decider'][rank + 1] AS power FROM p WHERE rank < 4 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY rank DESC, d, id) = 1),
b AS (SELECT customer_id, id, budget FROM p WHERE budget IS NOT NULL QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d DESC, id DESC) = 1)
SELECT c.customer_id, t.power AS top_power, t.id AS top_meeting, b.budget, b.id AS budget_meeting FROM (SELECT DISTINCT customer_id FROM p) c LEFT JOIN t USING (customer_id) LEFT JOIN b USING (customer_id)
""",
    "crm_export": f"""
WITH {MEETINGS}, o AS (
  SELECT l_orderkey AS meeting_id, string_agg(item, '; ' ORDER BY item) AS opportunities, string_agg(rival, '; ' ORDER BY rival) AS competitors FROM (
    SELECT l_orderkey, l_returnflag || '-' || l_linestatus || ' [' || CAST(round(l_discount * 8 * 100) AS INTEGER) || '%]' AS item,
      'rival ' || (l_suppkey % 27) || CASE WHEN l_quantity > 40 THEN ' (active)' ELSE ' (past)' END AS rival FROM lineitem) GROUP BY 1
), r AS (
  SELECT m.meeting_id, customer_id, CAST(meeting_date AS VARCHAR) AS "date", CAST(interest AS INTEGER) AS interest, CAST(churn AS INTEGER) AS churn_risk, CAST(trust AS INTEGER) AS trust,
    coalesce(opportunities, '') AS opportunities, coalesce(competitors, '') AS competitors FROM m LEFT JOIN o USING (meeting_id)
)
SELECT meeting_id, CAST(to_json(r) AS VARCHAR) AS json, chr(65279) || 'meeting_id,customer_id,date,interest,churn_risk,trust,opportunities,competitors' || chr(13) || chr(10)
  || concat_ws(',', meeting_id, customer_id, "date", coalesce(CAST(interest AS VARCHAR), ''), coalesce(CAST(churn_risk AS VARCHAR), ''), trust, opportunities, competitors) AS csv FROM r
""",
    "radar_examples": "SELECT event_type AS topic, CAST(row_number() OVER w AS INTEGER) AS rank, event_id AS signal_id, user_id AS customer_id FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 6",
    "radar_units": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'purchase' THEN 'sales' ELSE 'undefined' END AS unit, count(*) AS occurrences FROM events GROUP BY 1",
    "alerts_top1": f"WITH {ALERTS} SELECT * FROM alert",
    "alert_counts": f"WITH {ALERTS} SELECT severity, count(*) AS alerts FROM alert WHERE audience = 'manager' GROUP BY 1",
    "coaching": f"""
WITH {MEETINGS}, c AS (SELECT seller_id, count(*) AS meetings, avg(talk_ratio) AS t, avg(monologue) AS mo, avg(questions) AS q, avg((talk_ratio BETWEEN 0.35 AND 0.55)::INT) AS i FROM m WHERE talk_ratio IS NOT NULL GROUP BY 1)
SELECT seller_id, meetings, round(t, 6) AS talk_ratio, round(mo, 6) AS monologue, round(q, 6) AS questions, round(i, 6) AS ideal_share,
  CASE WHEN t > 0.7 THEN 'dominates' WHEN t > 0.55 THEN 'talks_much' WHEN t < 0.35 THEN 'talks_little' ELSE 'ideal' END AS verdict FROM c
""",
    "overdue_tasks": f"WITH {TASKS} SELECT task_id, CAST(date_diff('day', due, {DAY}) AS INTEGER) AS days_late FROM task WHERE NOT done AND due < {DAY}",
    "worst_accounts": "SELECT c_custkey AS customer_id, CAST(c_custkey * 37 % 101 AS INTEGER) AS health FROM customer ORDER BY health, customer_id LIMIT 6",
    "latest_meetings": f"WITH {MEETINGS} SELECT meeting_id, customer_id, meeting_date FROM m ORDER BY meeting_date DESC, meeting_id DESC LIMIT 8",
    "treatment_totals": f"WITH {MEETINGS} SELECT count(*) AS transcripts, CAST(sum(monologue) AS BIGINT) AS words, CAST(sum(questions) AS BIGINT) AS turns, count(talk_ratio) AS diarised, round(avg(reliability), 6) AS reliability FROM m",
    "customer_list": f"WITH {MEETINGS} SELECT c_custkey AS customer_id, CAST(c_custkey * 37 % 101 AS INTEGER) AS health, count(meeting_id) AS meetings, max(meeting_date) AS last_contact FROM customer LEFT JOIN m ON customer_id = c_custkey GROUP BY 1, 2",
    "reliability_histogram": f"""
WITH {MEETINGS} SELECT CASE WHEN reliability >= 75 THEN 'high' WHEN reliability >= 50 THEN 'medium' ELSE 'low' END AS level, count(*) AS transcripts, CAST(sum(monologue) AS BIGINT) AS words, CAST(sum(questions) AS BIGINT) AS turns, count(talk_ratio) AS diarised FROM m GROUP BY 1
""",
    "warnings_topk": "SELECT regexp_replace(event_type || ' by user ' || user_id, '[0-9]+', 'N', 'g') AS warning, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, warning LIMIT 5",
    "correction_rates": "SELECT event_type AS field, count(*) AS reviews, count(*) FILTER (WHERE user_id % 3 <> event_id % 3) AS corrections, count(*) FILTER (WHERE user_id % 3 <> event_id % 3) / count(*) AS rate FROM events GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("customer", "orders", "lineitem", "events", "conversations")),
}
