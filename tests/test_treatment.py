"""What was masked, how far a transcript can be trusted, and what a file's name tells."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import REDACTION_RULES, redact, redactions
from colloquy.operators.accounts import latest_meetings, redaction_counts, treatment_totals
from colloquy.operators.scores import quality_facts
from colloquy.sources.metadata import informative_title, meeting_type, title_of_name


def test_redactions_have_type_and_span(spark):
    rows = [(1, "é ana@x.com, 123.456.789-01 e (11) 91234-5678"), (2, "nada"), (3, None), (4, ""), (5, "12.345.678/0001-90 " * 40)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("redactions", redactions(F.col("text"))).withColumn("masked", redact(F.col("text")))
    got = {r.id: r for r in df.collect()}
    spans = [(x.type, rows[0][1][x.start : x.end]) for x in got[1].redactions]
    assert spans == [("email", "ana@x.com"), ("cpf", "123.456.789-01"), ("telefone", "(11) 91234-5678")]
    assert all("#" in got[1].masked[x.start : x.end] for x in got[1].redactions)
    assert got[2].redactions == [] and got[3].redactions is None and got[4].redactions == [] and len(got[5].redactions) == 40
    counts = {r.type: r.n for r in redaction_counts(df).collect()}
    assert counts == {"email": 1, "cpf": 1, "telefone": 1, "cnpj": 40} and set(counts) < {k for k, _ in REDACTION_RULES}


def test_quality_facts(spark):
    rows = [(["Um", "um", "tipo", "x"], 2, 1, 4, True, 1, 0, True), (None, 0, 0, 0, False, 0, 0, False), (["a"] * 210, 0, 0, 3, True, 8, 2, False), (["a"] * 210, 0, 0, 3, True, 2, 1, True)]
    df = spark.createDataFrame(rows, "tokens array<string>, fillers int, inaudible int, sentences int, diarised boolean, speakers int, unknown int, attributable boolean")
    facts = quality_facts(*(F.col(c) for c in df.columns))
    got = [tuple(r.f) for r in df.select(facts.alias("f")).collect()]
    assert got == [
        (0.0, 0.75, 0.5, ["inaudible", "short", "fillers", "one speaker"]),
        (0.0, 0.0, 0.0, ["no speakers", "short", "no scores"]),
        (1.5, 0.005, 0.0, ["fragmented", "no scores"]),
        (1.5, 0.005, 0.0, ["unknown sides"]),
    ]


def test_totals_of_nothing(spark):
    none = spark.createDataFrame([], "words long, turns long, diarised boolean, reliability int")
    assert tuple(treatment_totals(none).first()) == (0, 0, 0, 0, None)
    days = spark.createDataFrame([(k, None if k == 9 else k // 2) for k in range(10)], "meeting_id long, meeting_date int")
    assert [r.meeting_id for r in latest_meetings(days, 3).collect()] == [8, 7, 6]


def test_types_and_titles_of_names(spark):
    kinds = (("follow_up", "follow ?up|retorno"), ("proposal", "proposta"))
    rows = [("x/2026-09-10_Follow-Up_final.vtt",), ("Proposta ACME.docx",), ("retorno da proposta.txt",), ("Outra coisa.txt",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    title, kind = title_of_name(F.col("p"), ("final", r"v\d+")), meeting_type(F.col("p"), kinds)
    got = [tuple(r) for r in df.select(informative_title(title, kind, F.lit("Acme"), ("follow", "up", "retorno", "da", "proposta")), kind).collect()]
    assert got == [("follow_up - Acme", "follow_up"), ("Proposta ACME", "proposal"), ("follow_up - Acme", "follow_up"), ("Outra coisa", None), ("Acme", None)]
