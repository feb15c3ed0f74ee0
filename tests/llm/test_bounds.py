"""What is planned is delivered, and samples keep their bound, whatever repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.llm.mixing import mix_plan, mixed_documents
from colloquy.llm.quality_knn import fit_quality


def test_repeated_rows_are_planned_as_they_are_delivered(spark):
    rows = [(i, "w " * 20, "a") for i in range(40)] + [(100, "x " * 400, "b")] * 3 + [(None, None, None), (101, "x " * 400, None), (101, "x " * 400, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_key", F.lit("clash")).drop("mix_key")
    mixed = mixed_documents(docs).collect()
    plan = mix_plan(docs.distinct()).collect()
    assert sum(len((r["text"] or "").split()) for r in mixed) == sum(r["taken"] for r in plan)
    assert len(mixed) == sum(r["copies"] for r in plan)
    assert max((r["mix_copy"] for r in mixed)) <= 1
    one = [r for r in mixed if r["doc_id"] == 100]
    assert len(one) == len({r["mix_copy"] for r in one}) >= 1


def test_the_sample_keeps_its_bound_when_ids_and_labels_repeat(spark):
    docs = spark.createDataFrame([(1, f"good text number {i}") for i in range(3000)] + [(2, "bad"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (2, 0), (3, 1), (None, 1), (9, 1)], "doc_id long, label int")
    model = fit_quality(docs, labels, limit=5)
    assert len(model.vectors) == 2
    again = fit_quality(docs.repartition(5), labels.repartition(3), limit=5)
    assert model.vectors == pytest.approx(again.vectors)
