"""A small lexicon of our own for invented products, so that the analysis can be run as it is.

Phrases are over folded Portuguese; a business brings its own tables (see ``phrases.lexicon_from``).
"""

from __future__ import annotations

from colloquy.operators.analysis import Lexicon
from colloquy.operators.phrases import Phrase
from colloquy.operators.sentiment import SentimentLexicon

__all__ = ["EXAMPLE"]

EXAMPLE = Lexicon(
    products=[Phrase("Acme", "acme", group="erp"), Phrase("Acme Payroll", "acme folha", group="hr")],
    rivals=[Phrase("Zeta", "zeta"), Phrase("Beta", "beta")],
    pains=[
        Phrase("closing", "fechamento", group="finance"),
        Phrase("spreadsheets", "planilha*", group="finance"),
        Phrase("slowness", "lento|lenta|trava", group="generic"),
    ],
    objections=[Phrase("price", "caro|cara"), Phrase("price", "preco alto"), Phrase("authority", "preciso aprovar"), Phrase("timing", "vamos adiar")],
    needs=[Phrase("need", "precisamos de")],
    decisions=[Phrase("go", "decidimos seguir"), Phrase("deal", "vamos fechar")],
    next_steps=[Phrase("meeting", "proximo passo"), Phrase("proposal", "vou enviar ~2 proposta")],
    churn=[Phrase("cancel", "cancel* ~3 contrato", 20.0), Phrase("bad_support", "suporte ~4 ruim", 14.0)],
    upsell=[
        Phrase("asked_proposal", "manda|mande a? proposta", 12.0),
        Phrase("asked_deadline", "qual o prazo", 7.0),
        Phrase("expansion", "nova|novas filial|filiais", 7.0),
    ],
    trust=[Phrase("trusts", "confio em voces", 24.0), Phrase("doubts", "nao vamos comprar", -12.0)],
    voice=[Phrase("praise", "adoramos|excelente"), Phrase("complaint", "pessimo|pessima"), Phrase("complaint", "ruim")],
    aspects=[Phrase("support", "suporte"), Phrase("price", "preco"), Phrase("integration", "integracao")],
    roles=[Phrase("finance director", "sou o? diretor financeiro", group="decision"), Phrase("IT manager", "gerente de ti", group="influencer")],
    ours=[Phrase("task", "vou enviar")],
    theirs=[Phrase("task", "preciso que voce"), Phrase("task", "me manda")],
    status={"negated": ("sem usar", "nao usamos"), "possession": ("usamos",), "evaluating": ("avaliamos",), "opportunity": ("queremos",), "pain": ("problema",)},
    complaint=("problema", "atrasado"),
    denial=("nao", "sem"),
    resolution=("combinamos", "resolvido"),
    other_party=("banco",),
    past=("antes", "tinha"),
    active=("agora", "avaliamos"),
    refusal=("nao vamos comprar",),
    superior=("meu|minha diretor|diretora",),
    third_party=("que e a|o",),
    postponed=("adiar", "remarcar"),
    preference=("decidimos seguir",),
    conditional=("talvez", "um dia"),
    sentiment=SentimentLexicon(
        {"adoramos": 0.8, "excelente": 0.9, "confio": 0.5, "ruim": -0.7, "pessimo": -0.9, "problema": -0.5, "lenta": -0.4, "caro": -0.4, "trava": -0.3},
        {"nao": -1.0, "muito": 1.5, "pouco": 0.5},
    ),
)
