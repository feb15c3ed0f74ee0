"""Cases that the driver's tables don't hold: question marks, islands, masking, offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import scores as S
from colloquy.operators import turns as T

SAY = "conv_id long, turn long, speaker string, side string, text string"


def rows(spark, *turns):
    data = [(1, k, speaker, side, text) for k, (speaker, side, text) in enumerate(turns)]
    return spark.createDataFrame(data, SAY).withColumn("words", X.count_words(F.col("text")))


def one(df):
    return df.collect()[0]


def test_monologue_joins_turns_of_one_speaker(spark):
    t = rows(spark, ("A", "seller", "um dois tres."), ("A", "seller", "quatro."), ("B", "client", "sim."), ("A", "seller", "cinco seis."), ("C", "seller", "sete oito nove."))
    assert one(T.longest_monologue(t)).longest_monologue_words == 4
    ratio = one(T.talk_ratio(t))
    assert (ratio.seller_words, ratio.client_words, round(ratio.talk_ratio_seller, 3)) == (9, 1, 0.9)


def test_ratio_is_null_with_one_side(spark):
    assert one(T.talk_ratio(rows(spark, ("A", "seller", "oi")))).talk_ratio_seller is None


def test_questions_and_words_before(spark):
    t = rows(spark, ("A", "seller", "Bom dia. Antes, me conta: como vai a folha? Usa hoje?"), ("B", "client", "Qual preço?"), ("A", "seller", "Certo!"))
    q = one(T.questions(t))
    assert (q.seller_questions, q.open_questions, q.closed_questions) == (2, 1, 1)
    assert one(T.words_before_question(t)).words_before_first_question == 2


def test_followup_chain_and_interruptions(spark):
    t = rows(spark, ("A", "seller", "Como é?"), ("B", "client", "ainda estamos vendo isso"), ("A", "seller", "E o prazo?"), ("B", "client", "Curto."), ("A", "seller", "Certo."), ("A", "seller", "Quanto?"))
    assert one(T.followup_depth(t)).followup_depth == 2
    assert one(T.interruptions(t)).interruptions == 1


def test_masking_keeps_length_and_order(spark):
    text = "😀 CNPJ 12.345.678/0001-90, cpf 123.456.789-09, cartão 1234 5678 9012 3456, ana@x.com.br, (11) 98765-4321 e 2024."
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select("t", X.redact(F.col("t")).alias("m"))
    got = {r.t: r.m for r in df.collect()}
    masked = got[text]
    assert len(masked) == len(text) and "😀" in masked and "2024" in masked
    assert "##.###.###/####-##" in masked and "###.###.###-##" in masked and "(##) #####-####" in masked and "@" not in masked
    assert got[None] is None and got[""] == ""


def test_offsets_quote_what_they_say(spark):
    text = "Ação é nação, AÇÃO"
    df = spark.createDataFrame([(text,)], "t string").select(X.fold(F.col("t")).alias("f"), X.matches(X.fold(F.col("t")), X.bounded("acao")).alias("m"))
    r = one(df)
    assert len(r.f) == len(text)
    assert [(m.start, m.end, text[m.start : m.end]) for m in r.m] == [(0, 4, "Ação"), (14, 18, "AÇÃO")]


def test_evidence_and_clauses(spark):
    df = spark.createDataFrame([("o produto atende mas o rh sofre embora pouco",)], "t string")
    r = one(df.select(X.clauses(F.col("t")).alias("c"), X.evidence(F.col("t"), F.array(F.struct(F.lit(0).alias("start"), F.lit(16).alias("end"))), F.lit(2), F.lit(9)).alias("e")))
    assert r.c == ["o produto atende ", "mas o rh sofre ", "embora pouco"]
    assert (r.e.quote, r.e.start, r.e.end) == ("o produto atende", 0, 16)


def test_interest_factors_add_up_and_are_limited(spark):
    facts = {k: F.lit(True) for k in S.INTEREST}
    df = spark.range(1).select(S.interest_factors({k: v for k, v in facts.items() if S.INTEREST[k] > 0}, F.lit(0)).alias("f"), S.interest_factors({}, F.lit(3)).alias("g"))
    r = one(df)
    assert sum(f.delta for f in r.f) == 100 and r.f[-1].label == "limit"
    assert [(f.label, f.delta) for f in r.g] == [("base", 50), ("churn_signals", -30)]


def test_churn_renormalises(spark):
    none = F.lit(None).cast("array<int>")
    first = S.churn_risk(F.lit(40), F.lit(0), none, F.lit(0), F.lit(0), F.lit(0))
    later = S.churn_risk(F.lit(40), F.lit(0), F.array(*map(F.lit, (90, 80, 70, 30))), F.lit(2), F.lit(1), F.lit(0))
    r = one(spark.range(1).select(first.alias("a"), later.alias("b")))
    assert (r.a, r.b) == (60, 55)


def test_health_without_history_is_neutral(spark):
    none = F.array().cast("array<int>")
    args = (F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False))
    r = one(spark.range(1).select(S.health_score(none, *args, F.lit(False)).alias("a"), S.health_score(F.array(F.lit(80)), *args, F.lit(True)).alias("b")))
    assert (r.a, r.b) == (50, 66)
