"""Peaks of customers, tasks, coverage and export on rows with nulls."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json

from pyspark.sql import functions as F

from colloquy.operators.export import crm_rows, csv_document, json_document
from colloquy.operators.extract import Entry, tasks
from colloquy.operators.memory import customer_peaks
from colloquy.operators.validation import corpus_coverage

DAY = dt.date(2024, 1, 10)


def test_peaks(spark):
    rows = [
        (1, 1, DAY, "user", 5.0),
        (2, 1, DAY, "decider", None),
        (3, 1, DAY + dt.timedelta(1), "decider", 7.0),
        (4, 1, DAY + dt.timedelta(2), None, None),
        (5, 2, DAY, "stranger", None),
        (6, 3, DAY, None, None),
    ]
    meetings = spark.createDataFrame(rows, "meeting_id long, customer_id long, meeting_date date, power string, budget double")
    got = {r.customer_id: tuple(r)[1:] for r in customer_peaks(meetings, ("user", "decider")).collect()}
    assert got == {1: ("decider", 2, 7.0, 3), 2: ("stranger", 5, None, None), 3: (None, None, None, None)}
    assert customer_peaks(meetings.limit(0), ("user",)).count() == 0


def test_tasks_by_verb_and_date_within_reach(spark):
    far = " " * 90
    rows = [
        (1, 0, 0, "vou enviar o plano", "Vou enviar o plano", "Ana", "vou enviar o plano. ate 20/01"),
        (1, 1, 40, "vou enviar o plano", "Vou enviar o plano", "Ana", "vou enviar o plano"),
        (1, 2, 80, "preciso que voce assine", "Preciso que você assine", None, ("preciso que voce assine" + far + "20/01")[:103]),
        (2, 0, 0, "nada", "Nada", "Bruno", "nada 20/01"),
    ]
    sentences = spark.createDataFrame(rows, "doc_id long, sentence_no int, start int, search string, quote string, speaker string, after string")
    got = sorted(tuple(r) for r in tasks(sentences, [Entry("t", "vou enviar")], [Entry("t", "preciso que voce")], F.lit(DAY)).collect())
    assert got == [(1, "ours", "Ana", "Vou enviar o plano", dt.date(2024, 1, 20), 0), (1, "theirs", None, "Preciso que você assine", None, 80)]


def test_coverage_with_nulls(spark):
    schema = "part string, rivals array<string>, objections array<string>, units array<string>, churn boolean, upsell boolean, budget double, scenario string"
    rows = [("dev", ["x"], ["price"], ["u"], True, None, 1.0, "a"), ("holdout", None, None, None, None, None, None, None), ("dev", [], [], [], False, True, None, "a")]
    got = corpus_coverage(spark.createDataFrame(rows, schema), "price", ("u",)).first().asDict()
    assert got == dict(total=3, dev=2, holdout=1, with_rival=1, with_price=1, with_churn=1, with_upsell=1, with_budget=1, without_signal=1, unit_u=1, scenarios=1)


def test_export_round_trip(spark):
    meetings = spark.createDataFrame([(1, 9, DAY, 50, None, 3), (2, None, None, None, 1, None)], "meeting_id long, customer_id long, meeting_date date, interest_score int, churn_risk int, trust_score int")
    offers = spark.createDataFrame([(1, 'a "b", c', 0.6), (1, "d", 0.25)], "meeting_id long, unit string, probability double")
    rivals = spark.createDataFrame([(1, "Zeta", True), (1, "Beta", False)], "meeting_id long, competitor string, active boolean")
    rows = crm_rows(meetings, offers, rivals)
    got = {r.meeting_id: r for r in rows.select("meeting_id", json_document(rows.columns).alias("json"), csv_document(rows.columns).alias("csv")).collect()}
    lists = ['a "b", c [60%]; d [25%]', "Beta (past); Zeta (active)"]
    assert list(json.loads(got[1].json).values()) == [1, 9, "2024-01-10", 50, None, 3, *lists]
    assert got[1].csv.startswith("\ufeffmeeting_id,")
    header, line = csv.reader(io.StringIO(got[1].csv.lstrip("\ufeff"), newline=""))
    assert header == rows.columns and line == ["1", "9", "2024-01-10", "50", "", "3", *lists]
    assert list(json.loads(got[2].json).values()) == [2, None, None, None, 1, None, "", ""]
