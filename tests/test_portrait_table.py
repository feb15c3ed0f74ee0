"""Portraits by change: equal to full recomputation, and fewer buckets written."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators.portrait_table import PortraitTable

SCHEMA = "customer_id long, score int"


def portray(facts):
    whole = facts.where("score is not null").groupBy("customer_id").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    return lambda keys: whole.join(keys, "customer_id", "left_semi")


def rows(df):
    return sorted(tuple(r) for r in df.select("customer_id", "total", "n").collect())


def test_three_batches_equal_the_whole(spark, tmp_path):
    rng, table, all_rows = random.Random(7), PortraitTable(spark, str(tmp_path), buckets=16), []
    assert table.rows() is None and table.refresh(spark.createDataFrame([], SCHEMA), None) == 0
    for version, size in enumerate((200, 5, 4), 1):
        batch = [(rng.randrange(60), rng.randrange(9)) for _ in range(size)] + [(None, 1)]
        all_rows += batch
        facts = spark.createDataFrame(all_rows, SCHEMA)
        assert table.refresh(spark.createDataFrame(batch, SCHEMA), portray(facts)) == version
        whole = facts.where("customer_id is not null")
        assert rows(table.rows()) == rows(portray(whole)(whole.select("customer_id").distinct()))
        assert table.written(version) == 16 if version == 1 else 0 < table.written(version) <= size


def test_a_customer_without_rows_goes(spark, tmp_path):
    table = PortraitTable(spark, str(tmp_path), buckets=2)
    facts = spark.createDataFrame([(k, 1) for k in range(6)], SCHEMA)
    table.refresh(facts, portray(facts))
    none = spark.createDataFrame([(k, None) for k in range(6)], SCHEMA)
    table.refresh(none.where("customer_id < 5"), portray(none))
    assert rows(table.rows()) == [(5, 1, 1)]
    table.refresh(none, portray(none))
    assert rows(table.rows()) == []


def test_a_refresh_that_breaks_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    table = PortraitTable(spark, str(tmp_path), buckets=4)
    facts = spark.createDataFrame([(k, 1) for k in range(20)], SCHEMA)
    table.refresh(facts, portray(facts))
    before, more = rows(table.rows()), facts.union(facts)
    with pytest.raises(Exception, match="lost"):
        table.refresh(more, lambda keys: portray(more)(keys).withColumn("n", F.when(F.col("customer_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("n"))))
    assert rows(table.rows()) == before
    assert table.refresh(more, portray(more)) == 2
    assert rows(table.rows()) == [(k, 2, 2) for k in range(20)]
