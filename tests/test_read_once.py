"""What is asked of a text more than once is worked out once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import fold, redact
from colloquy.operators import analysis as A
from colloquy.operators.anchoring import anchored
from colloquy.plans import analysis_queries as Q
from colloquy.plans.example_lexicon import EXAMPLE

TEXT = "Ana (Comercial): Posso te mostrar?\nBruno (Diretor): Temos 40 mil reais para isso. Vamos cancelar o contrato."


def worked_out(df) -> str:
    """How ``df`` is computed from where its data is kept."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_roles_and_sentences_are_kept(spark):
    texts = spark.createDataFrame([(1, TEXT, dt.date(2024, 1, 10))], "doc_id long, text string, meeting_date date")
    meetings = A.read_meetings(texts.repartition(2))
    for rows in (meetings.texts, meetings.spans, meetings.roles, meetings.sentences):
        assert "LogicalRDD" in worked_out(rows) and "regexp" not in worked_out(rows) and "Window" not in worked_out(rows)
    assert "Window" not in worked_out(meetings.sides)


def test_sentences_of_queries_are_kept(spark, tmp_path):
    turns = [(1, 0, "assistant", "Bom dia."), (1, 1, "user", "Bom dia. Tudo bem?")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows, sides = Q._sentences(spark, str(tmp_path))
    assert rows.count() > 2 and "regexp" not in worked_out(rows)
    assert "Window" not in worked_out(sides)


def test_words_are_looked_up_for_the_kinds_that_are_asked_for(spark, monkeypatch):
    texts = spark.createDataFrame([(1, TEXT, dt.date(2024, 1, 10))], "doc_id long, text string, meeting_date date")
    meetings, looked_up = A.read_meetings(texts), []
    found = A.X.phrase_hits
    monkeypatch.setattr(A.X, "phrase_hits", lambda rows, phrases, **k: looked_up.extend(phrases) or found(rows, phrases, **k))
    assert A.findings(meetings, EXAMPLE, ("budget",)).first()["value"] == 40_000 and looked_up == []
    assert {r["label"] for r in A.findings(meetings, EXAMPLE, ("churn",)).collect()} and looked_up == EXAMPLE.churn


@pytest.mark.parametrize("text", ["R$ 45.500,00 em 31/01", "CPF 123.456.789-09", "tel 91234-5678", "a@b.co", "İSTANBUL É AQUI", None, ""])
def test_scans_that_are_left_out_change_nothing(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")), fold(F.col("t"))).first()
    masked = {"CPF 123.456.789-09": "CPF ###.###.###-##", "tel 91234-5678": "tel #####-####", "a@b.co": "###.##"}.get(text, text)
    assert row[0] == masked
    assert row[1] == {"İSTANBUL É AQUI": "İstanbul e aqui", "R$ 45.500,00 em 31/01": "r$ 45.500,00 em 31/01", "CPF 123.456.789-09": "cpf 123.456.789-09"}.get(text, text)


def test_a_quote_is_placed_without_an_index_of_runs(spark):
    texts = spark.createDataFrame([(1, "um  dois\n tres quatro")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "dois tres")], "doc_id int, quote string")
    rows = anchored(items, texts)
    assert tuple(rows.first()["span"]) == (4, 14) and "regexp_extract_all" not in worked_out(rows)
