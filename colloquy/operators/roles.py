"""Who sells and who buys: roles of a transcript's speakers from what they say and how they speak.

Every stage is an aggregate or a window over a transcript's speakers, so transcripts run in parallel.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import ACCENTED, UNACCENTED, fold

__all__ = ["infer_roles"]

SELLER, CLIENT, UNKNOWN = "seller", "client", "unknown"

# Marks of someone inside the supplier, of someone inside the buyer, and of whoever opens a
# meeting; titles of either side; each over folded text.
SELLER_MARKS = (
    (r"\bnoss[ao] (solucao|plataforma|ferramenta|produto|equipe|implantacao|consultoria|metodologia)\b", "dexis_fornecedor"),
    (r"\bnosso (time de implantacao|suporte tecnico|time tecnico)\b", "dexis_fornecedor"),
    (r"\b(a gente|nos) (entrega|entregamos|implanta|implantamos|atende|atendemos)\b", "dexis_fornecedor"),
    (r"\bconseguimos (entregar|implantar|fazer|atender)\b", "dexis_fornecedor"),
    (r"\b(posso|vou|deixa eu) (te )?(mostrar|apresentar|compartilhar|demonstrar)\b", "oferece_demonstracao"),
    (r"\b(posso|vou) te (enviar|mandar|passar)\b", "compromisso_de_envio"),
    (r"\bfico de (enviar|mandar|passar|te mandar)\b", "compromisso_de_envio"),
    (r"\b(te|lhe) envio (a proposta|o material|depois)\b", "compromisso_de_envio"),
)
CLIENT_MARKS = (
    (r"\b(a gente|nos) (precisa|precisamos|sofre|sofremos|usa|usamos|ta com|estamos com|esta com|nao consegue|nao conseguimos)\b", "dexis_comprador"),
    (r"\bo noss[ao] (time|pessoal|erp|sistema|financeiro|rh|fiscal|controladoria|operacao)\b", "dexis_comprador"),
    (r"\bnossa empresa\b", "dexis_comprador"),
    (r"\baqui (na nossa empresa|na empresa|dentro de casa|do nosso lado)\b", "dexis_comprador"),
    (r"\bvoces (cobram|entregam|implantam)\b", "trata_o_outro_como_fornecedor"),
    (r"\b(meu|nosso) (cfo|ceo|cto|coo|diretor|diretora|chefe|socio|gestor)\b", "reporta_a_decisor_interno"),
    (r"\bpreciso (aprovar|levar|validar|submeter) (com|para|pra|ao|a)\b", "reporta_a_decisor_interno"),
)
OPENING_MARKS = (
    r"\bobrigad[ao] (por|pelo|pela) (aceitar|receber|ter aceitado|seu tempo|o tempo|essa conversa|a conversa)\b",
    r"\bobrigad[ao] pelo tempo\b",
    r"\bvaleu (por|pelo) (aceitar|seu tempo|o tempo)\b",
    r"\b(a|nossa) pauta (de hoje|hoje|e)\b",
    r"\btrouxe uma pauta\b",
)
SELLER_TITLES = (
    r"\bcsm\b",
    r"\bcustomer success\b",
    r"\b(executiv[ao]|gerente|gestor[a]?) de (conta|contas|vendas|novos negocios)\b",
    r"\baccount (executive|manager)\b",
    r"\b(sdr|bdr|ae)\b",
    r"\bconsultor[ae]?\b",
    r"\b(pre-?vendas|presales)\b",
    r"\bespecialista (de|em) (produto|solucao|solucoes)\b",
    r"\barquitet[ao] de solucoes\b",
    r"\b(vendedor|vendedora|sales|comercial)\b",
)
CLIENT_TITLES = (
    r"\b(cfo|ceo|cto|coo|cio)\b",
    r"\bdiretor[a]?\b",
    r"\bgerente\b",
    r"\bcontroller\b",
    r"\b(coordenador[a]?|supervisor[a]?|analista)\b",
    r"\b(socio|socia|proprietari[ao])\b",
    r"\bcomprador[a]?\b",
)
# Weights of signals, the threshold, and confidences of roles that nothing showed.
TITLE, COMPANY, WORDS, OPENING, QUESTIONS, LENGTH = 2.5, 2.0, 1.0, 0.8, 0.8, 0.25
THRESHOLD = 1.0
LONG_TURN = 12
PROPAGATED, SPEAKING_ORDER = 0.3, 0.2


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _folded(name: str) -> str:
    """A name as :func:`fold` leaves it in speech."""
    return name.lower().translate(str.maketrans(ACCENTED, UNACCENTED))


def _confidence(strength: Column) -> Column:
    return F.least(F.lit(0.95), F.floor((1 - F.exp(-strength / 2.5)) * 100 + 0.5) / 100)


def infer_roles(turns: DataFrame, company: str | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """doc_id, speaker, position, side, confidence, signals, score of every speaker in ``turns``
    (doc_id, turn, speaker, title, text, words).

    ``company`` is the seller's, in speech and titles a sign of its people. ``fixed`` (doc_id, speaker, side) are roles that a person confirmed; they win. Speakers are one
    whatever the case of their name. Ties go to who spoke first.
    """
    key = F.lower("speaker").alias("key")
    people = turns.groupBy("doc_id", key).agg(
        F.min("turn").alias("first"),
        F.min_by("speaker", "turn").alias("speaker"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("turn"))).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t.text), " ").alias("said"),
        F.min_by("text", "turn").alias("opening"),
        F.avg(F.contains("text", F.lit("?")).cast("double")).alias("rate"),
        F.percentile("words", 0.5).alias("median"),
    )
    if fixed is not None:
        people = people.join(fixed.select("doc_id", F.lower("speaker").alias("key"), F.col("side").alias("fixed")), ["doc_id", "key"], "left")
    else:
        people = people.withColumn("fixed", F.lit(None).cast("string"))
    free = F.col("fixed").isNull()
    said, title = F.col("said"), F.col("title")
    people = people.withColumn("said", fold(said)).withColumn("title", fold(title)).withColumn("opening", fold(F.col("opening")))
    seller_title = _any(title, SELLER_TITLES)
    if company:
        seller_title = seller_title | F.contains(title, fold(F.lit(company)))
    signals: list[tuple[Column, Column | float, str]] = [
        (title.isNotNull() & seller_title, TITLE, "cargo_fornecedor"),
        (title.isNotNull() & ~seller_title & _any(title, CLIENT_TITLES), -TITLE, "cargo_comprador"),
        *([(said.rlike(rf"\b(?:aqui\s+)?n[ao]\s+{re.escape(_folded(company))}\b"), COMPANY, "cita_empresa_vendedora")] if company else []),
        *((said.rlike(p), WORDS, s) for p, s in SELLER_MARKS),
        *((said.rlike(p), -WORDS, s) for p, s in CLIENT_MARKS),
    ]
    doc = Window.partitionBy("doc_id")
    people = people.withColumn("starts", F.min("first").over(doc))
    signals.append(((F.col("first") == F.col("starts")) & _any(F.col("opening"), OPENING_MARKS), OPENING, "abre_a_reuniao"))
    # Comparisons are among the speakers that nobody fixed.
    own = Window.partitionBy("doc_id", F.col("fixed").isNull())
    by_rate = own.orderBy(F.desc("rate"), "first")
    people = people.withColumn("n", F.count("*").over(own)).withColumn("rate_rank", F.row_number().over(by_rate)).withColumn("next_rate", F.lead("rate").over(by_rate))
    lead = F.col("rate") - F.col("next_rate")
    signals.append(((F.col("n") >= 2) & (F.col("rate_rank") == 1) & (F.col("rate") >= 0.5) & (lead > 0), lead * QUESTIONS, "taxa_de_pergunta"))
    up, down = own.orderBy(F.desc("median"), "first"), own.orderBy("median", F.desc("first"))
    people = people.withColumn("long_rank", F.row_number().over(up)).withColumn("short_rank", F.row_number().over(down))
    people = people.withColumn("longest", F.max("median").over(own)).withColumn("shortest", F.min("median").over(own))
    apart = (F.col("n") >= 2) & (F.col("longest") >= LONG_TURN) & (F.col("shortest") > 0) & (F.col("longest") >= F.col("shortest") * 1.5)
    signals.append((apart & (F.col("long_rank") == 1), -LENGTH, "turno_longo"))
    signals.append((apart & (F.col("short_rank") == 1), LENGTH, "turno_curto"))
    weight = lambda w: w if isinstance(w, Column) else F.lit(w)
    facts = F.array_compact(F.array(*(F.when(c, F.struct(weight(w).cast("double").alias("w"), F.lit(s).alias("s"))) for c, w, s in signals)))
    people = people.withColumn("facts", F.when(free, facts).otherwise(F.array().cast("array<struct<w:double,s:string>>")))
    people = people.withColumn("score", F.aggregate("facts", F.lit(0.0), lambda a, f: a + f.w))
    names = F.array_distinct(F.transform("facts", lambda f: f.s))
    people = people.withColumn("signals", F.when(free, names).otherwise(F.array(F.lit("fixado_por_humano"))))
    score = F.col("score")
    side = F.when(~free, F.col("fixed")).when(score >= THRESHOLD, SELLER).when(score <= -THRESHOLD, CLIENT).otherwise(UNKNOWN)
    sure = F.when(~free, 1.0).when(F.abs(score) >= THRESHOLD, _confidence(F.abs(score))).otherwise(0.0)
    people = people.withColumn("side", side).withColumn("confidence", sure)

    sold = F.max((F.col("side") == SELLER).cast("int")).over(doc) == 1

    def give(rows: DataFrame, who: Column, to: str, confidence: Column, signal: Column) -> DataFrame:
        rows = rows.withColumn("who", F.coalesce(who, F.lit(False)))
        rows = rows.withColumn("confidence", F.when(F.col("who"), confidence).otherwise(F.col("confidence")))
        extra = F.when(signal.isNull(), F.col("signals")).otherwise(F.array_union("signals", F.array(signal)))
        return rows.withColumn("signals", F.when(F.col("who"), extra).otherwise(F.col("signals"))).withColumn("side", F.when(F.col("who"), to).otherwise(F.col("side"))).drop("who")

    def propagated(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("sold", sold)
        rows = give(rows, F.col("sold") & (F.col("side") == UNKNOWN), CLIENT, F.lit(PROPAGATED), F.lit("propagado"))
        rows = rows.withColumn("open", F.sum((F.col("side") == UNKNOWN).cast("int")).over(doc)).withColumn("bought", F.max((F.col("side") == CLIENT).cast("int")).over(doc))
        alone = ~F.col("sold") & (F.col("side") == UNKNOWN) & (F.col("open") == 1) & (F.col("bought") == 1)
        return give(rows, alone, SELLER, F.lit(PROPAGATED), F.lit("propagado"))

    # Without a seller, whoever asks most leads the meeting.
    asks = F.array_contains("signals", "taxa_de_pergunta") & (F.col("side") == UNKNOWN) & (score > 0)
    people = people.withColumn("sold", sold)
    people = give(people, ~F.col("sold") & asks, SELLER, _confidence(score), F.lit(None).cast("string"))
    people = propagated(people)
    # Still none: the highest score, or whoever spoke first.
    people = people.withColumn("sold", sold).withColumn("best", F.row_number().over(own.orderBy(F.desc("score"), "first")))
    people = people.withColumn("tied", F.count("*").over(Window.partitionBy("doc_id", F.col("fixed").isNull(), "score")) > 1)
    chosen = ~F.col("sold") & free & (F.col("best") == 1)
    people = give(people, chosen, SELLER, F.lit(SPEAKING_ORDER), F.when(F.col("tied"), "ordem_de_fala").otherwise("placar_fraco"))
    people = propagated(people)
    position = F.row_number().over(doc.orderBy("first")) - 1
    return people.select("doc_id", "speaker", position.alias("position"), "side", "confidence", "signals", "score")
