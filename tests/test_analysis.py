"""Briefings of texts with and without speakers, against what a reader would say."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators import analysis as A
from colloquy.plans.example_lexicon import EXAMPLE

DAY = dt.date(2024, 1, 10)
TALK = """Ana (Comercial): Bom dia 😀, nossa solução entrega isso. Posso te mostrar?
Bruno (Diretor): Hoje usamos o Acme Folha e o fechamento está atrasado. O suporte da Beta é muito ruim.
Ana (Comercial): Entendi. Vou enviar a nova proposta em 15 dias, certo?
Bruno (Diretor): A gente precisa disso. Está caro. Temos 80 mil reais. Não comenta com ninguém, mas seria uns 75. Sou o diretor financeiro.
Ana (Comercial): O próximo passo é na sexta. Qual o seu telefone? (11) 98765-4321
Bruno (Diretor): Agora avaliamos a Zeta. Confio em vocês, adoramos o time."""
ALONE = "O cliente usa o Acme e queremos o Acme Folha. O fechamento está atrasado. Temos 50 mil reais. Vamos cancelar o contrato."
TEXTS = [(1, TALK), (2, ALONE), (3, ""), (4, None), (5, "Ana: só eu falo. Está caro."), (6, "   \n"), (7, "Nada de especial aqui."), (8, "\n".join(f"Pessoa {c}: vamos cancelar o contrato" for c in "ABCDEFGH"))]


@pytest.fixture(scope="module")
def seen(spark):
    df = spark.createDataFrame([(i, t, DAY) for i, t in TEXTS], "doc_id int, text string, meeting_date date").withColumn("label", F.lit("clash"))
    meetings = A.read_meetings(df)
    found = A.findings(meetings, EXAMPLE)
    kinds = {}
    for r in found.collect():
        kinds.setdefault((r["doc_id"], r["kind"]), []).append(r)
    return kinds, {r["doc_id"]: r for r in A.briefings(meetings, found, EXAMPLE).collect()}


def test_findings_of_a_conversation(seen):
    kinds, _ = seen
    one = lambda kind, *cells: sorted(tuple(r[c] for c in cells) for r in kinds.get((1, kind), []))
    assert one("product", "label", "detail") == [("Acme Payroll", "in_use")]
    assert one("pain", "label", "value") == [("closing", 0.75)]
    assert one("rival", "label", "detail", "flag") == [("Beta", "medium", False), ("Zeta", "high", True)]
    assert one("objection", "label", "flag") == [("price", False)]
    assert one("budget", "value", "detail", "flag") == [(75000.0, "estimate", True), (80000.0, "stated", True)]
    assert one("persona", "label", "detail") == [("finance director", "decision")]
    assert one("task", "label", "grp", "detail") == [("ours", "Ana", "2024-01-25")]
    assert one("next_step", "label") == [("meeting",), ("proposal",)]
    assert one("voice", "label", "detail") == [("complaint", "support"), ("praise", None)]
    assert one("churn", "label") == [("bad_support",)]
    assert one("risk", "label", "detail") == [("Zeta", "high"), ("bad_support", "medium")]


def test_quotes_stand_in_the_text(seen):
    kinds, _ = seen
    texts = dict(TEXTS)
    for (doc_id, kind), rows in kinds.items():
        for r in rows:
            if r["quote"] and r["start"] is not None and kind not in ("task", "voice"):
                at = texts[doc_id].rindex(r["quote"], 0, r["start"] + len(r["quote"]))
                assert at <= r["start"] < at + len(r["quote"]), (kind, r)
    assert all("98765" not in (r["quote"] or "") for rows in kinds.values() for r in rows)


def test_briefing_of_a_conversation(seen):
    row = seen[1][1]
    assert row["diarised"] and row["attributable"] and row["turns"] == 6
    assert row["sentiment"] == "mixed" and row["power"] == "decision" and row["trust_score"] == 74
    factors = {f["label"]: f["delta"] for f in row["factors"]}
    assert factors == {"base": 50, "dated_commitment": 10, "decision_maker": 8, "has_budget": 6, "high_trust": 5, "open_price_objection": -8, "active_competitor": -10, "churn_signals": -15}
    assert row["interest_score"] == sum(factors.values()) == 46
    assert row["churn_risk"] == 41 and row["churn_band"] == "medium"
    assert row["bant"]["score"] == 4 and row["bant"]["missing"] == []
    assert row["summary"].startswith("The client works with Acme Payroll. The speaker is finance director. The main pain is closing.")


@pytest.mark.parametrize("doc_id", [2, 3, 5, 6, 7])
def test_without_two_speakers_findings_come_and_scores_dont(seen, doc_id):
    kinds, rows = seen
    row = rows[doc_id]
    assert not row["diarised"] and not row["attributable"] and row["turns"] == 0
    assert row["interest_score"] is None and row["churn_risk"] is None and row["churn_band"] is None and row["factors"] is None
    labels = {k: sorted(r["label"] for r in v) for (i, k), v in kinds.items() if i == doc_id}
    if doc_id == 2:
        assert labels == {"product": ["Acme", "Acme Payroll"], "pain": ["closing"], "budget": ["BRL"], "churn": ["cancel"], "risk": ["cancel"], "opportunity": ["Acme", "Acme Payroll"]}
    elif doc_id == 5:
        assert labels == {"objection": ["price"]}
    else:
        assert labels == {} and row["summary"] == "No next step was agreed."


def test_null_and_fragmented_texts(seen):
    kinds, rows = seen
    assert rows[4]["words"] == 0 and rows[4]["summary"] == "No next step was agreed." and not rows[4]["attributable"]
    assert rows[8]["diarised"] and not rows[8]["attributable"] and rows[8]["churn_risk"] is None and len(kinds[8, "churn"]) == 8
    assert len(rows) == 8


def test_nothing_to_read(spark):
    df = spark.createDataFrame([], "doc_id int, text string, meeting_date date")
    meetings = A.read_meetings(df)
    found = A.findings(meetings, EXAMPLE)
    assert found.collect() == [] and A.briefings(meetings, found, EXAMPLE).collect() == []


def test_one_kind_alone_is_the_same(spark, seen):
    df = spark.createDataFrame([(i, t, DAY) for i, t in TEXTS], "doc_id int, text string, meeting_date date")
    rows = A.findings(A.read_meetings(df), EXAMPLE, ("budget", "pain")).collect()
    want = [r for (_, k), v in seen[0].items() if k in ("budget", "pain") for r in v]
    assert sorted(map(str, rows)) == sorted(map(str, want))
