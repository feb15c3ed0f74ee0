"""The driver's tables seen as accounts, meetings, tasks, opportunities and signals.

Scores are arithmetic on keys, so that SQL can say the same. Every row of a table is used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["AS_OF", "accounts", "analyses", "competitors", "corrections", "meetings", "opportunities", "signals", "table", "tasks", "turns"]

#: The day on which everything is looked at.
AS_OF = dt.date(2001, 9, 1)
AS_OF_SIGNALS = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.operators.turns import turns_from_roles

    return turns_from_roles(table(spark, sf_dir, "conversations"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    contract = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), contract.alias("contract_value"), (F.col("c_custkey") * 37 % 101).cast("int").alias("health")
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    there = F.col("o_orderstatus") != "P"
    score = lambda factor, name: (k * factor % 101).cast("int").alias(name)
    return o.select(
        k.alias("meeting_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("meeting_date"),
        F.col("o_orderdate").alias("created_at"),
        F.when(there, (k * 7 % 101).cast("int")).alias("interest_score"),
        F.when(there, (k * 13 % 101).cast("int")).alias("churn_risk"),
        score(11, "trust_score"),
        F.col("o_orderpriority").alias("seller_id"),
        F.when(there, (k % 97) / 97.0).alias("talk_ratio"),
        (k * 17 % 301).cast("int").alias("monologue"),
        (k * 19 % 23).cast("int").alias("questions"),
        (k * 5 % 101).cast("int").alias("reliability"),
        F.col("o_totalprice").alias("budget"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several analyses of an order's meeting: one for each of its lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("meeting_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("score"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("l_shipdate").alias("due_date"),
        (F.col("l_linestatus") == "F").alias("done"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("meeting_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("unit"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_discount") * 8).alias("probability"),
    )


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    n = F.col("l_suppkey") % 3
    return li.select(
        F.col("l_orderkey").alias("meeting_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("rival "), (F.col("l_suppkey") % 27).cast("string")).alias("competitor"),
        (F.col("l_quantity") > 40).alias("active"),
        F.when(n == 0, "high").when(n == 1, "medium").otherwise("low").alias("threat"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("customer_id"), F.col("event_type").alias("topic"), F.to_date("ts").alias("date"), F.col("ts").alias("created_at"), "value"
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("field"), (F.col("user_id") % 3).alias("old_value"), (F.col("event_id") % 3).alias("new_value"))
