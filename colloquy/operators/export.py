"""Meetings as rows for a customer-relationship system, as JSON and as CSV documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ingest import csv_line

__all__ = ["crm_rows", "csv_document", "json_document"]


def _joined(rows: DataFrame, item: Column, name: str) -> DataFrame:
    return rows.groupBy("meeting_id").agg(F.array_join(F.sort_array(F.collect_list(item)), "; ").alias(name))


def crm_rows(meetings: DataFrame, opportunities: DataFrame, competitors: DataFrame) -> DataFrame:
    """meeting_id, customer_id, date, interest, churn_risk, trust, opportunities ("unit [60%]") and competitors
    ("name (active)" or "name (past)"), the lists sorted and joined by "; "; a meeting without any has ""."""
    offered = F.concat("unit", F.lit(" ["), F.round(F.col("probability") * 100).cast("int").cast("string"), F.lit("%]"))
    rival = F.concat("competitor", F.when(F.col("active"), " (active)").otherwise(" (past)"))
    rows = meetings.join(_joined(opportunities, offered, "opportunities"), "meeting_id", "left").join(_joined(competitors, rival, "competitors"), "meeting_id", "left")
    lists = (F.coalesce(c, F.lit("")).alias(c) for c in ("opportunities", "competitors"))
    scores = (F.col("interest_score").alias("interest"), "churn_risk", F.col("trust_score").alias("trust"))
    return rows.select("meeting_id", "customer_id", F.col("meeting_date").cast("string").alias("date"), *scores, *lists)


def json_document(columns: list[str]) -> Column:
    """One JSON object of a row's columns; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def csv_document(columns: list[str], separator: str = ",") -> Column:
    """A CSV document of one row: byte order mark, header, line break, the row's fields."""
    header = "\ufeff" + separator.join(columns) + "\r\n"
    return F.concat(F.lit(header), csv_line([F.col(c) for c in columns], separator))
