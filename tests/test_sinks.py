"""Reports of one file a batch: read back equal, and nothing left by a task that fails."""

from __future__ import annotations

import csv
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.sources.sinks import write_report

SCHEMA = "path string, state string, n long"


def read(path):
    with open(path, encoding="utf-8", newline="") as f:
        text = f.read()
    assert text.startswith("\ufeff") and text.endswith("\r\n")
    return list(csv.reader(text[1:].splitlines(keepends=True), delimiter=";"))


def test_read_back_equal_in_order(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    rows = [(f"f{k:04}", ('a;"b"', "two\nlines", None, "é")[k % 4], k) for k in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    write_report(df, path, ["path"])
    assert read(path) == [["path", "state", "n"], *([a, b or "", str(c)] for a, b, c in rows)]
    assert os.listdir(tmp_path) == ["report.csv"]


def test_without_rows_the_header_stands(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    write_report(spark.createDataFrame([], SCHEMA), path, ["path"])
    assert read(path) == [["path", "state", "n"]]


def test_a_failing_task_leaves_what_stood_there(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    good = spark.range(200).select(F.col("id").cast("string").alias("path"), F.lit("done").alias("state"), F.col("id").alias("n"))
    write_report(good, path, ["n"])
    before = read(path)
    broken = good.withColumn("state", F.when(F.col("n") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("state")))
    with pytest.raises(PySparkException):
        write_report(broken, path, ["n"])
    assert read(path) == before and os.listdir(tmp_path) == ["report.csv"]
