"""Views across accounts: control tower, revenue at risk, pipeline, pain radar, alerts, coaching."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.memory import latest_analyses
from colloquy.operators.scores import band, rounded

__all__ = [
    "alert_counts", "alerts", "at_risk", "coaching", "control_tower", "correction_rates", "customer_list", "hours_returned", "idle_upsell", "latest_meetings",
    "overdue_tasks", "pain_examples", "pain_radar", "pain_units", "pipeline_by_unit", "reliability_histogram", "revenue_at_risk", "redaction_counts", "table_counts", "top_warnings", "treatment_totals",
]

MINUTES_SAVED = 12
IDEAL_TALK = (0.35, 0.55)


def control_tower(accounts: DataFrame, meetings: DataFrame, tasks: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per account: contract, meetings, last_contact, interest_score, churn_risk and trust of its
    latest meeting (by date, then id), cycle_competitors (active ones), open_tasks.

    Each fact is aggregated by customer before it is joined, so accounts are joined with at most one row.
    """
    seen = meetings.groupBy("customer_id").agg(F.count("*").alias("meetings"), F.max("meeting_date").alias("last_contact"))
    columns = ("meeting_id", "meeting_date", "customer_id", "interest_score", "churn_risk", "trust_score")
    last = latest_analyses(meetings.select(*columns), "customer_id", ("meeting_date", "meeting_id")).drop("meeting_date", "meeting_id")
    active = competitors.where("active").groupBy("customer_id").agg(F.countDistinct("competitor").alias("cycle_competitors"))
    todo = tasks.where("not done").groupBy("customer_id").agg(F.count("*").alias("open_tasks"))
    rows = accounts.join(seen, "customer_id", "left").join(last, "customer_id", "left").join(active, "customer_id", "left").join(todo, "customer_id", "left")
    return rows.fillna(0, ["meetings", "cycle_competitors", "open_tasks"])


def at_risk(tower: DataFrame, health: Column | None = None) -> DataFrame:
    """Accounts with churn from 34, poor health or an active competitor, by contract then churn (highest first)."""
    poor = (F.col("churn_risk") >= 34) | (F.col("cycle_competitors") > 0)
    if health is not None:
        poor = poor | (band(health) == "low")
    return tower.where(F.coalesce(poor, F.lit(False))).orderBy(F.desc_nulls_last("contract_value"), F.desc_nulls_last("churn_risk"), "customer_id")


def revenue_at_risk(tower: DataFrame) -> DataFrame:
    """One row: accounts with high churn, their contracts' sum, and how many of them lack a contract value."""
    high = tower.where("churn_risk >= 67")
    return high.agg(
        F.count("*").alias("accounts"),
        F.coalesce(F.sum("contract_value"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum(F.col("contract_value").isNull().cast("long")), F.lit(0)).alias("without_value"),
    )


def pipeline_by_unit(opportunities: DataFrame) -> DataFrame:
    """unit, opportunities, weighted: value times chance, rounded once for each unit."""
    return opportunities.groupBy("unit").agg(F.count("*").alias("opportunities"), rounded(F.sum(F.col("value") * F.col("probability"))).cast("long").alias("weighted"))


def idle_upsell(opportunities: DataFrame, tasks: DataFrame, last_contact: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """customer_id, upsell, days_idle: upsell value of accounts with no open task and no contact for ``days``."""
    value = opportunities.groupBy("customer_id").agg(F.sum(F.col("value") * F.col("probability")).alias("upsell")).where("upsell > 0")
    idle = F.datediff(F.lit(as_of), "last_contact")
    rows = value.join(tasks.where("not done").select("customer_id").distinct(), "customer_id", "left_anti").join(last_contact, "customer_id")
    return rows.withColumn("days_idle", idle).where(F.col("days_idle") >= days).select("customer_id", "upsell", "days_idle")


def hours_returned(meetings: DataFrame, minutes: int = MINUTES_SAVED) -> DataFrame:
    """month, meetings, hours: what ``minutes`` saved for each meeting come to."""
    month = F.trunc("meeting_date", "month").alias("month")
    return meetings.groupBy(month).agg(F.count("*").alias("meetings"), (F.count("*") * minutes / 60).alias("hours"))


def _in_period(signals: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return signals.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=days))) if days else signals


def pain_radar(signals: DataFrame, as_of: dt.date, days: int = 0, customers: DataFrame | None = None, topics: tuple[str, ...] = ()) -> DataFrame:
    """topic, occurrences, clients, recent, earlier, change of pains in the last ``days`` (0: all).

    Recent is the later half of the period, or the last 45 days of an unbounded one. ``customers``
    (customer_id), as those of one segment, and ``topics``, as those of one unit, narrow the signals.
    """
    signals = signals if customers is None else signals.join(customers.select("customer_id"), "customer_id", "left_semi")
    signals = signals.where(F.col("topic").isin(*topics)) if topics else signals
    half = as_of - dt.timedelta(days=int(days / 2 + 0.5) if days else 45)
    recent = (F.col("date") >= F.lit(half)).cast("long")
    rows = _in_period(signals, as_of, days).groupBy("topic").agg(
        F.count("*").alias("occurrences"), F.countDistinct("customer_id").alias("clients"), F.sum(recent).alias("recent"), F.sum(1 - recent).alias("earlier")
    )
    return rows.withColumn("change", F.col("recent") - F.col("earlier"))


def pain_examples(signals: DataFrame, as_of: dt.date, days: int = 0, most: int = 6) -> DataFrame:
    """The ``most`` newest signals of each topic, with their rank; tasks keep no more than that of a topic."""
    order = Window.partitionBy("topic").orderBy(F.desc("created_at"), F.desc("signal_id"))
    return _in_period(signals, as_of, days).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def pain_units(radar: DataFrame, units: dict[str, str], other: str = "undefined") -> DataFrame:
    """unit, occurrences: the radar's topics by business unit."""
    unit = F.coalesce(*(F.when(F.col("topic") == t, u) for t, u in units.items()), F.lit(other))
    return radar.groupBy(unit.alias("unit")).agg(F.sum("occurrences").alias("occurrences"))


def alerts(meetings: DataFrame, competitors: DataFrame, opportunities: DataFrame) -> DataFrame:
    """meeting_id, kind, severity, audience, subject: high churn; the most threatening active competitor;
    the best opportunity from .6."""
    churn = meetings.where("churn_risk >= 67").select("meeting_id", F.lit("churn").alias("kind"), F.lit("high").alias("severity"), F.lit("manager").alias("audience"), F.lit(None).cast("string").alias("subject"))
    threat = F.when(F.col("threat") == "high", 3).when(F.col("threat") == "medium", 2).otherwise(1)
    top = competitors.where("active").groupBy("meeting_id").agg(F.max_by(F.struct("competitor", "threat"), F.struct(threat, "competitor")).alias("c"))
    rival = top.select("meeting_id", F.lit("competitor").alias("kind"), F.col("c.threat").alias("severity"), F.lit("manager").alias("audience"), F.col("c.competitor").alias("subject"))
    best = opportunities.where("probability >= 0.6").groupBy("meeting_id").agg(F.max_by("unit", F.struct("probability", "unit")).alias("unit"))
    chance = best.select("meeting_id", F.lit("opportunity").alias("kind"), F.lit("medium").alias("severity"), F.lit("seller").alias("audience"), F.col("unit").alias("subject"))
    return churn.unionByName(rival).unionByName(chance)


def alert_counts(found: DataFrame, kind: str | None = None, audience: str | None = None) -> DataFrame:
    """severity, alerts of the alerts that pass the filters."""
    for column, value in (("kind", kind), ("audience", audience)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.groupBy("severity").agg(F.count("*").alias("alerts"))


def coaching(meetings: DataFrame) -> DataFrame:
    """seller_id and averages over diarised meetings: talk_ratio, monologue, questions, share in the ideal range, verdict."""
    ideal = F.col("talk_ratio").between(*IDEAL_TALK).cast("double")
    rows = meetings.where("talk_ratio is not null").groupBy("seller_id").agg(
        F.count("*").alias("meetings"), F.avg("talk_ratio").alias("talk_ratio"), F.avg("monologue").alias("monologue"), F.avg("questions").alias("questions"), F.avg(ideal).alias("ideal_share")
    )
    low, high = IDEAL_TALK
    verdict = F.when(F.col("talk_ratio") > 0.7, "dominates").when(F.col("talk_ratio") > high, "talks_much").when(F.col("talk_ratio") < low, "talks_little").otherwise("ideal")
    return rows.withColumn("verdict", verdict)


def overdue_tasks(tasks: DataFrame, as_of: dt.date) -> DataFrame:
    """Open tasks past their date with days_late, the latest first."""
    late = F.datediff(F.lit(as_of), "due_date")
    return tasks.where(~F.col("done") & (F.col("due_date") < F.lit(as_of))).withColumn("days_late", late).orderBy(F.desc("days_late"), "task_id")


def latest_meetings(meetings: DataFrame, most: int = 8) -> DataFrame:
    """The newest meetings by date, then id, for the dashboard."""
    return meetings.orderBy(F.desc_nulls_last("meeting_date"), F.desc("meeting_id")).limit(most)


def customer_list(accounts: DataFrame, meetings: DataFrame) -> DataFrame:
    """Accounts with meeting count and last date, the least healthy first."""
    seen = meetings.groupBy("customer_id").agg(F.count("*").alias("meetings"), F.max("meeting_date").alias("last_contact"))
    return accounts.join(seen, "customer_id", "left").fillna(0, ["meetings"]).orderBy(F.asc_nulls_last("health"), "customer_id")


def reliability_histogram(transcripts: DataFrame) -> DataFrame:
    """level (high from 75, medium from 50, low), transcripts, words, turns, diarised."""
    level = F.when(F.col("reliability") >= 75, "high").when(F.col("reliability") >= 50, "medium").otherwise("low")
    return transcripts.groupBy(level.alias("level")).agg(
        F.count("*").alias("transcripts"), F.sum("words").alias("words"), F.sum("turns").alias("turns"), F.sum(F.col("diarised").cast("long")).alias("diarised")
    )


def treatment_totals(transcripts: DataFrame) -> DataFrame:
    """One row: transcripts, words, turns, diarised and the mean reliability; zeros and null without any."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return transcripts.agg(
        F.count("*").alias("transcripts"), total("words", "words"), total("turns", "turns"), total(F.col("diarised").cast("long"), "diarised"), F.avg("reliability").alias("reliability")
    )


def redaction_counts(redacted: DataFrame, column: str = "redactions") -> DataFrame:
    """type, n over arrays of :func:`colloquy.functions.text.redactions`."""
    return redacted.select(F.explode(F.col(column).type).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def top_warnings(warnings: DataFrame, most: int = 5) -> DataFrame:
    """warning, n: the most frequent warnings, their numbers written N."""
    kind = F.regexp_replace("warning", r"[0-9]+", "N").alias("warning")
    return warnings.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning").limit(most)


def correction_rates(corrections: DataFrame) -> DataFrame:
    """field, reviews, corrections, rate; a confirmed value is a review, not a correction."""
    changed = F.sum((~F.col("old_value").eqNullSafe(F.col("new_value"))).cast("long"))
    rows = corrections.groupBy("field").agg(F.count("*").alias("reviews"), changed.alias("corrections"))
    return rows.withColumn("rate", F.col("corrections") / F.col("reviews"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
