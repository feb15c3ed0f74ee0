"""Ties, first mentions and many names: one defined result each."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators.extract import deadline
from colloquy.operators.memory import latest_analyses
from colloquy.sources.captions import normalised_speakers


def test_the_latest_of_equal_times_does_not_depend_on_the_input(spark):
    rows = [(1, 5, 1, 3.0), (1, 5, 1, 7.0), (1, 4, 9, 9.0), (2, None, 1, 1.0), (2, 1, None, 2.0), (3, None, None, None)]
    df = spark.createDataFrame(rows, "meeting_id int, created_at int, run int, score double")
    want = {1: (5, 1, 7.0), 2: (1, None, 2.0), 3: (None, None, None)}
    for order in (df, df.orderBy(F.desc("score")), df.repartition(5)):
        assert {r[0]: tuple(r)[1:] for r in latest_analyses(order, "meeting_id", ("created_at", "run")).collect()} == want


@pytest.mark.parametrize(
    ("said", "due"),
    [
        ("na quinta ou na segunda", "2024-01-11"),
        ("na segunda ou na quinta", "2024-01-15"),
        ("ate quarta", "2024-01-17"),
        ("no dia 05/01", "2024-01-05"),
        ("05/02/25 ou 05/02/2026", "2025-02-05"),
        ("31/02 ou em 15 dias", "2024-01-25"),
        ("45/45, na proxima semana", "2024-01-17"),
        ("em duas semanas, na sexta", "2024-01-24"),
        ("fim do mes", "2024-01-31"),
        ("no mes que vem", "2024-02-10"),
        ("um dia desses", None),
        (None, None),
    ],
)
def test_deadlines(spark, said, due):
    df = spark.createDataFrame([(said,)], "s string").select(deadline(F.col("s"), F.lit(dt.date(2024, 1, 10))).alias("d"))
    assert str(df.first()["d"]) == str(due)


def test_every_speaker_has_a_name_of_their_own(spark):
    rows = [("d", i, f"Speaker {i}", "x") for i in range(1, 800)]
    got = {r["turn"]: r["name"] for r in normalised_speakers(spark.createDataFrame(rows, "doc_id string, turn int, speaker string, text string")).collect()}
    assert len(set(got.values())) == 799
    assert [got[i] for i in (1, 26, 27, 28, 702, 703)] == [f"Falante {x}" for x in ("A", "Z", "AA", "AB", "ZZ", "AAA")]
