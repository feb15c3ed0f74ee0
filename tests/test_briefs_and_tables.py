"""Budgets, people, briefs, tables and provider JSON on data of our own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import briefs, budget, people
from colloquy.operators.extract import Entry
from colloquy.sources import provider_json as J
from colloquy.sources import tables as T

SENTENCES = "doc_id long, sentence_no int, start int, search string, quote string, side string"


def texts(spark, *rows):
    data = [(i, t, t.lower(), [(0, len(t))] if t else []) for i, t in enumerate(rows) if t is not None]
    data += [(i, None, None, None) for i, t in enumerate(rows) if t is None]
    return spark.createDataFrame(data, "doc_id long, safe string, search string, spans array<struct<start:int,end:int>>")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("temos R$ 50.000,00 para isso", [(50000.0, "stated")]),
        ("no maximo R$ 2 milhoes", [(2e6, "limit")]),
        ("cerca de 50 mil reais", [(50000.0, "estimate")]),
        ("sao setenta e cinco mil", [(75000.0, "stated")]),
        ("cento e vinte e cinco mil", [(125000.0, "stated")]),
        ("meio milhao", [(500000.0, "stated")]),
        ("sessenta mil e muito, uns cinquenta", [(50000.0, "estimate"), (60000.0, "stated")]),
        ("uns cinquenta", []),
        ("nada", []),
        ("", []),
        (None, []),
    ],
)
def test_budgets(spark, text, want):
    got = budget.budgets(texts(spark, text)).orderBy("amount").collect()
    assert [(r.amount, r.kind) for r in got] == want


def test_budget_secrecy_and_quote(spark):
    r = budget.budgets(texts(spark, "Fica entre nos: R$ 10 mil.")).first()
    assert r.confidential and r.raw == "R$ 10 mil" and r.quote == "Fica entre nos: R$ 10 mil."


def test_voice_and_persona(spark):
    s = spark.createDataFrame(
        [(1, 0, 0, "sou gerente fiscal.", "Sou gerente fiscal.", "client"), (1, 1, 20, "meu cfo adora o suporte.", "Meu CFO adora o suporte.", "client"), (2, 0, 0, "nada.", "Nada.", None)], SENTENCES
    )
    turns = spark.createDataFrame([(1, 0, "Ana", "seller"), (1, 1, "Bia", "client")], "doc_id long, turn int, speaker string, side string")
    got = {r.doc_id: r for r in people.persona(s, [Entry("CFO", "cfo", group="decider"), Entry("manager", "gerente", group="user")], "meu cfo", "o concorrente", turns).collect()}
    assert (got[1].role, got[1].power, got[1].name) == ("manager", "influencer", "Bia")
    assert (got[2].role, got[2].power, got[2].name) == (None, "unknown", None)
    v = people.voice(s, [Entry("praise", "adora")], [Entry("price", "preco"), Entry("support", "suporte")]).collect()
    assert [(r.kind, r.target, r.start) for r in v] == [("praise", "support", 20)]


def test_recommendations(spark):
    schema = (
        "customer_id long, objections array<struct<category:string,text:string,mentions:int,resolved:boolean>>, decision_maker boolean, interests array<int>, late array<struct<task:string,days_late:int>>, "
        "asks_return boolean, rivals array<struct<label:string,mentions:int,active:boolean>>, bant_missing array<string>, next_steps int"
    )
    rows = [
        (1, [("price", "caro", 2, False), ("technical", "api", 1, True)], False, [70, 60], [("proposta", 3)], True, [("Zeta", 4, True)], ["budget"], 0),
        (2, None, None, None, None, None, None, None, None),
        (3, [("authority", "diretoria", 1, False)], False, [50, 60], [], False, [], [], 1),
    ]
    advice = briefs.recommendations(spark.createDataFrame(rows, schema))
    got = {}
    for r in advice.orderBy("customer_id", "ordinal").collect():
        got.setdefault(r.customer_id, []).append(r.advice)
    assert got[1][0] == "bring the decision maker" and len(got[1]) == 8 and got[1][-1] == "ask what has changed"
    assert 2 not in got and got[3] == ["settle who approves first"]
    lines = {r.customer_id: r.text for r in briefs.rendered(advice).collect()}
    assert lines[3].startswith("1. settle") and lines[1].count("\n") == 7


def test_summary_and_throughput(spark):
    schema = (
        "id long, products array<struct<label:string,status:string>>, role string, pains array<string>, aspects array<struct<aspect:string,polarity:string>>, rivals array<struct<label:string,active:boolean,threat:string>>, "
        "chances array<struct<label:string,probability:double>>, budget double, objections array<struct<label:string,resolved:boolean>>, next_steps array<string>"
    )
    full = (1, [("Acme", "in_use")], "CFO", ["tax", "slow"], [("support", "positive"), ("price", "negative")], [("Zeta", True, "high")], [("A", 0.5), ("B", 0.8)], 1000.0, [("price", False)], ["call"])
    got = {r.id: r.summary for r in briefs.summary(spark.createDataFrame([full, (2, *[None] * 9)], schema)).collect()}
    assert got[1].startswith("The client works with Acme. The speaker is CFO. The main pain is tax, with 1 more.") and "B: 80%" in got[1] and "call" not in got[1]
    assert got[2] == "No next step was agreed."
    r = spark.range(1).select(briefs.throughput(F.lit(100), F.lit(2.0), F.lit(1000)).alias("t")).first().t
    assert (r.per_minute, r.planned_seconds) == (3000.0, 20.0)


def test_delimited(spark):
    files = [("a.csv", 'x;y\r\n1;"a;b ""q"""\n"l1\nl2";3'), ("b.tsv", "x\ty\n1\t\n"), ("c", "one\ntwo"), ("d", None), ("e", "a|b\n1|2")]
    rows = T.delimited_rows(spark.createDataFrame(files, "path string, text string")).orderBy("path", "row").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append(list(r.cells))
    assert got["a.csv"] == [["x", "y"], ["1", 'a;b "q"'], ["l1\nl2", "3"]]
    assert got["b.tsv"] == [["x", "y"], ["1", ""]] and got["c"] == [["one"], ["two"]] and "d" not in got and got["e"] == [["a", "b"], ["1", "2"]]


def test_table_shapes(spark):
    rows = [("m", 0, ["arquivo", "titulo"]), ("m", 1, ["a.txt", "t"]), ("u", 0, ["Falante", "Texto"]), ("u", 1, ["Ana", "oi"]), ("u", 2, ["Bia", "ola"]), ("w", 0, ["Transcrição"]), ("w", 1, ["x" * 200]), ("z", 0, ["q"]), ("z", 1, ["v"])]
    got = {r.path: (r.shape, r.text) for r in T.tables_to_texts(spark.createDataFrame(rows, "path string, row int, cells array<string>")).collect()}
    assert got == {"m": ("manifest", None), "u": ("utterances", "Ana: oi\nBia: ola"), "w": ("meetings", "x" * 200), "z": ("unknown", "v")}


def test_reflow(spark):
    pasted = "Ana Souza\n0:05\nBom dia.\nBia 00:12\nOla.\n"
    got = [r[0] for r in spark.createDataFrame([(pasted,), ("Ana\n0:05\nso um",), (None,)], "t string").select(T.reflowed(F.col("t"))).collect()]
    assert got == ["Ana Souza: Bom dia.\nBia: Ola.\n", "Ana\n0:05\nso um", None]


def test_provider_json(spark):
    files = [
        ("a", json.dumps({"results": {"utterances": [{"speaker": 0, "transcript": "oi"}, {"speaker": {"name": "Bia"}, "words": [{"word": "tudo"}, {"word": "bem"}]}]}})),
        ("b", json.dumps([{"titulo": "t", "transcricao": "texto"}, {"titulo": "u", "transcricao": "outro"}])),
        ("c", "{broken"),
        ("d", None),
    ]
    got = [(r.path, r.item, r.text) for r in J.json_transcripts(spark.createDataFrame(files, "path string, text string")).orderBy("path", "item").collect()]
    assert got == [("a", 0, "0: oi\nBia: tudo bem"), ("b", 0, "texto"), ("b", 1, "outro"), ("c", 0, None), ("d", 0, None)]
