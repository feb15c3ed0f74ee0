"""Labels, turns, sentences and roles on transcripts of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import transcripts as T
from colloquy.operators.roles import infer_roles

TALK = """Marina (CSM): Obrigada por aceitar a conversa. Vou te mostrar a nossa plataforma?
[00:10] isto continua.
Otávio — Diretor Financeiro: O Dr. Souza disse que nossa empresa gasta 3.500 por mês. A gente precisa de controle! Certo [inaudível].
MARINA: Qual é o prazo?
Resumo: nada
"""


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, TALK), (2, "Texto corrido sem rótulo. Outra frase."), (3, None), (4, "")]
    return T.prepared(spark.createDataFrame(rows, "doc_id long, text string")).cache()


def test_preparation_keeps_length(talk):
    for r in talk.where("text is not null").collect():
        assert len(r.safe) == len(r.text) == len(r.search)
    r = talk.where("doc_id = 1").first()
    assert r.inaudible == 1 and "inaud" not in r.search and "00:10" not in r.search and "otavio" in r.search


def test_labels_and_turns(talk):
    rows = T.turns(talk).orderBy("turn").collect()
    assert [(r.speaker, r.title) for r in rows] == [("Marina", "CSM"), ("Otávio", "Diretor Financeiro"), ("MARINA", None)]
    for r in rows:
        assert TALK[r.start : r.end].strip() == r.text
    assert rows[2].text.startswith("Qual") and "Resumo" in rows[2].text


def test_sentences(talk):
    got = T.sentences(T.turns(talk)).orderBy("turn", "sentence_start").collect()
    for r in got:
        assert TALK[r.sentence_start : r.sentence_end] == r.sentence
    assert any(r.sentence.startswith("O Dr. Souza") and r.sentence.endswith("mês.") for r in got)


def test_roles(talk):
    got = {r.speaker: r for r in infer_roles(T.turns(talk)).collect()}
    assert got["Marina"].side == "seller" and got["Otávio"].side == "client"
    assert {"cargo_fornecedor", "abre_a_reuniao", "oferece_demonstracao"} <= set(got["Marina"].signals)
    ok = T.attributable(infer_roles(T.turns(talk))).first()
    assert ok.attributable and not ok.fragmented


def test_fixed_roles_win_and_others_follow(spark, talk):
    fixed = spark.createDataFrame([(1, "marina", "client")], "doc_id long, speaker string, side string")
    got = {r.speaker: r for r in infer_roles(T.turns(talk), fixed=fixed).collect()}
    assert got["Marina"].side == "client" and got["Marina"].confidence == 1.0 and got["Marina"].signals == ["fixado_por_humano"]


def test_last_resort_is_speaking_order(spark):
    rows = [(1, 0, "Ana", None, "sim", 1), (1, 1, "Bia", None, "certo", 1), (1, 2, "Caio", None, "ok", 1)]
    turns = spark.createDataFrame(rows, "doc_id long, turn int, speaker string, title string, text string, words int")
    got = [(r.speaker, r.side, r.confidence, r.signals) for r in infer_roles(turns).orderBy("position").collect()]
    assert got[0] == ("Ana", "seller", 0.2, ["ordem_de_fala"])
    assert got[1:] == [("Bia", "client", 0.3, ["propagado"]), ("Caio", "client", 0.3, ["propagado"])]


def test_clean_text(spark):
    df = spark.createDataFrame([("a  10:20 b\n\n\n\nc",)], "t string")
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "a b\n\nc"
