"""Extractors on sentences of our own."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators import extract as X
from colloquy.operators.extract import Entry

SCHEMA = "doc_id long, sentence_no int, start int, search string, quote string, side string"


def rows(spark, *texts, side="client"):
    at, data = 0, []
    for k, t in enumerate(texts):
        data.append((1, k, at, t, t.upper(), side))
        at += len(t) + 1
    return spark.createDataFrame(data, SCHEMA)


PRODUCTS = [Entry("Acme", "acme", group="erp"), Entry("Acme Payroll", r"acme\s+folha", group="hr")]


def test_longest_product_and_status(spark):
    s = rows(spark, "hoje usamos o acme folha.", "queremos ver o acme tambem.", "nao temos acme folha aqui.")
    got = {r.label: r for r in X.products(s, PRODUCTS, {"possession": "usamos", "negated": "nao temos", "opportunity": "queremos"}).collect()}
    assert got["Acme Payroll"].status == "in_use" and got["Acme"].status == "opportunity"
    text = "hoje usamos o acme folha. queremos ver o acme tambem."
    assert text[got["Acme"].start :].startswith("acme tambem")


def test_refusal_rules_out_opportunity(spark):
    s = rows(spark, "queremos ver o acme.", "nao vamos comprar nada.")
    no = X.refused(s, [Entry("no", "nao vamos comprar")])
    assert X.products(s, PRODUCTS, {"opportunity": "queremos"}, no).first().status == "mentioned"


def test_competitors_keep_most_severe(spark):
    s = rows(spark, "usavamos a zeta antes.", "agora avaliamos a zeta.", "a beta existe.")
    got = {r.label: (r.active, r.threat) for r in X.competitors(s, [Entry("Zeta", "zeta"), Entry("Beta", "beta")], "antes", "avaliamos").collect()}
    assert got == {"Zeta": (True, "high"), "Beta": (False, "medium")}


def test_pains_objections_statements(spark):
    s = rows(spark, "o fechamento fiscal e um problema.", "o sistema e lento.", "achei caro mas combinamos um desconto.", "nao e caro.", "o banco e caro.")
    pains = X.pains(s, [Entry("tax", "fiscal"), Entry("slow", "lento|sistema", group="generic")], "problema", F.when(F.contains("search", F.lit("lento")), -0.5))
    assert {(r.label, r.confidence) for r in pains.collect()} == {("tax", 0.75), ("slow", 0.6)}
    found = X.objections(s, [Entry("price", "caro")], "nao", "desconto", "banco").collect()
    assert [(r.label, r.resolved) for r in found] == [("price", True)]
    assert X.statements(s, [Entry("d", "combinamos", 9)], least_words=4).first().weight == 9
    assert X.statements(s, [Entry("d", "combinamos", 9)], without="desconto").count() == 0


def test_risks_and_opportunities(spark):
    churn = spark.createDataFrame([(1, "leave", 22.0), (1, "less", 14.0), (1, "hm", 2.0)], "doc_id long, label string, weight double")
    rivals = spark.createDataFrame([(1, "Zeta", True, "high"), (1, "Beta", False, "low")], "doc_id long, label string, active boolean, threat string")
    assert [r.severity for r in X.risks(churn, rivals).collect()] == ["high", "medium", "low", "high"]
    found = spark.createDataFrame([(1, "Acme", "opportunity"), (2, "Acme", "in_use")], "doc_id long, label string, status string")
    facts = spark.createDataFrame([(1, True, True, True, False)], "doc_id long, pain boolean, preference boolean, budget boolean, conditional boolean")
    assert [(r.doc_id, round(r.probability, 2)) for r in X.opportunities(found, facts).collect()] == [(1, 0.95)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ate 15/03", dt.date(2025, 3, 15)),
        ("ate 10/01", dt.date(2025, 1, 10)),
        ("em 5/4/26", dt.date(2026, 4, 5)),
        ("dia 31/02", None),
        ("em dez dias", dt.date(2025, 2, 15)),
        ("em 2 semanas", dt.date(2025, 2, 19)),
        ("na quarta", dt.date(2025, 2, 12)),
        ("na sexta", dt.date(2025, 2, 7)),
        ("semana que vem", dt.date(2025, 2, 12)),
        ("no fim do mes", dt.date(2025, 2, 28)),
        ("no proximo mes", dt.date(2025, 3, 5)),
        ("sem prazo", None),
    ],
)
def test_deadlines(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(X.deadline(F.col("s"), F.lit(dt.date(2025, 2, 5)))).first()[0] == want
