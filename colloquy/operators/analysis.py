"""From any text to its briefing: one table of sentences, findings with quotes, scores, and the summary.

A text is read once: it is masked, cut into turns (or taken as one span of nobody where it hasn't two
speakers) and sentences. All extractors branch from that table. Where it can't be told what the client says,
findings are taken from everybody and scores are left out, as not measured is not zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.functions.text import INAUDIBLE, TIMESTAMP, blank, bounded, fold
from colloquy.operators import briefs as B
from colloquy.operators import extract as X
from colloquy.operators import people as P
from colloquy.operators import roles as R
from colloquy.operators import scores as S
from colloquy.operators import sentiment as E
from colloquy.operators import transcripts as T
from colloquy.operators.budget import budget_hits, budgets_in
from colloquy.operators.phrases import Phrase, pattern

__all__ = ["Lexicon", "Meetings", "aspects_of", "briefings", "findings", "read_meetings", "sentiment_of"]

# The lists of the lexicon that each kind of finding is sought by; words of others aren't looked up.
LISTS = {
    "need": ("needs",), "decision": ("decisions",), "next_step": ("next_steps",), "churn": ("churn",), "upsell": ("upsell",), "trust": ("trust",), "product": ("products",), "rival": ("rivals",),
    "pain": ("pains",), "objection": ("objections",), "voice": ("voice",), "budget": (), "persona": ("roles",), "task": ("ours", "theirs"), "risk": ("churn", "rivals"), "opportunity": ("products",), "aspect": (),
}
COMPETITOR_WEIGHT = {"high": 20, "medium": 12}


@dataclass(frozen=True)
class Lexicon:
    """What a language and a business call things. Lists of phrases are items to find, tuples of words are contexts."""

    products: list[Phrase] = field(default_factory=list)
    rivals: list[Phrase] = field(default_factory=list)
    pains: list[Phrase] = field(default_factory=list)
    objections: list[Phrase] = field(default_factory=list)
    needs: list[Phrase] = field(default_factory=list)
    decisions: list[Phrase] = field(default_factory=list)
    next_steps: list[Phrase] = field(default_factory=list)
    churn: list[Phrase] = field(default_factory=list)
    upsell: list[Phrase] = field(default_factory=list)
    trust: list[Phrase] = field(default_factory=list)
    voice: list[Phrase] = field(default_factory=list)
    aspects: list[Phrase] = field(default_factory=list)
    roles: list[Phrase] = field(default_factory=list)
    ours: list[Phrase] = field(default_factory=list)
    theirs: list[Phrase] = field(default_factory=list)
    status: dict[str, tuple[str, ...]] = field(default_factory=dict)
    complaint: tuple[str, ...] = ()
    denial: tuple[str, ...] = ()
    resolution: tuple[str, ...] = ()
    other_party: tuple[str, ...] = ()
    past: tuple[str, ...] = ()
    active: tuple[str, ...] = ()
    refusal: tuple[str, ...] = ()
    superior: tuple[str, ...] = ()
    third_party: tuple[str, ...] = ()
    postponed: tuple[str, ...] = ()
    preference: tuple[str, ...] = ()
    conditional: tuple[str, ...] = ()
    sentiment: E.SentimentLexicon = field(default_factory=lambda: E.SentimentLexicon({}))


def either(words: tuple[str, ...]) -> str:
    """Contexts as one expression; without any, one that nothing fits."""
    return "|".join(f"(?:{pattern(w)})" for w in words) or r"[^\s\S]"


@dataclass(frozen=True)
class Meetings:
    """Texts as analysis sees them: ``texts`` (doc_id, meeting_date, safe, search, inaudible), ``spans`` (turns and spans of
    nobody), ``roles`` and ``sides`` of diarised texts, ``sentences`` (doc_id, sentence_no, start, end, search, quote, after,
    side, speaker, client, attributable, meeting_date)."""

    texts: DataFrame
    spans: DataFrame
    roles: DataFrame
    sides: DataFrame
    sentences: DataFrame

    @property
    def client(self) -> DataFrame:
        return self.sentences.where("client")


def read_meetings(texts: DataFrame, company: str | None = None, fixed: DataFrame | None = None) -> Meetings:
    """``texts`` has doc_id, text and meeting_date. Null texts have no sentences; ids are unique."""
    # Whatever is asked of the texts, they are masked and folded, and their speakers told apart, only once.
    prepared = checkpointed(T.prepared(texts.select("doc_id", "text", "meeting_date")).drop("text"))
    # What is asked of a sentence's neighbourhood reaches 80 characters past it, into the next turns.
    spans = checkpointed(T.spans(prepared).withColumn("folded", blank(blank(fold(F.col("text")), TIMESTAMP), T.fold_pattern(INAUDIBLE))))
    roles = checkpointed(R.infer_roles(spans.where("diarised"), company, fixed))
    sides = T.attributable(roles)
    rows = T.sentences(spans.select("doc_id", "speaker", "text", "start", "folded", F.col("start").alias("span_start")))
    who = roles.select(F.col("doc_id").alias("whose"), F.lower("speaker").alias("key"), "side")
    rows = rows.join(who, (F.lower("speaker") == F.col("key")) & (F.col("doc_id") == F.col("whose")), "left").drop("key", "whose")
    rows = rows.join(sides.select("doc_id", "attributable"), "doc_id", "left").join(prepared.select("doc_id", "meeting_date"), "doc_id")
    told = F.coalesce("attributable", F.lit(False))
    place = F.col("sentence_start") - F.col("span_start")
    piece = lambda more: F.substring("folded", (place + 1).cast("int"), (F.length("sentence") + more).cast("int"))
    rows = rows.select(
        "doc_id", F.col("sentence_start").alias("sentence_no"), F.col("sentence_start").alias("start"), F.col("sentence_end").alias("end"), piece(0).alias("search"), F.col("sentence").alias("quote"),
        piece(80).alias("after"), "side", "speaker", (~told | (F.col("side") == "client")).alias("client"), told.alias("attributable"), "meeting_date",
    )
    return Meetings(prepared, spans, roles, sides, checkpointed(rows.withColumn("client", F.coalesce("client", F.lit(False)))))


def _clauses(sentences: DataFrame, lexicon: E.SentimentLexicon) -> DataFrame:
    """Scored clauses of the client's sentences: doc_id, start, text, score, terms."""
    from colloquy.functions.text import clauses

    cut = sentences.select("doc_id", "start", F.explode(clauses(F.col("search"))).alias("text"))
    return E.clause_scores(cut, lexicon)


def aspects_of(meetings: Meetings, lexicon: Lexicon) -> DataFrame:
    """doc_id, aspect, score, polarity: what the client's charged clauses are about."""
    patterns = {a.label: bounded(a.pattern) for a in lexicon.aspects}
    return E.aspect_sentiment(_clauses(meetings.client, lexicon.sentiment), patterns)


def sentiment_of(meetings: Meetings, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, positive, negative, sentiment of the client."""
    return E.overall_sentiment(_clauses(meetings.client, lexicon.sentiment), aspects_of(meetings, lexicon))


def _row(rows: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Findings of one kind in the columns that all share."""
    kinds = {"label": "string", "grp": "string", "detail": "string", "flag": "boolean", "value": "double", "start": "long", "quote": "string"}
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    cells = [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return rows.select("doc_id", F.lit(kind).alias("kind"), *cells)


def findings(meetings: Meetings, lexicon: Lexicon, kinds: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kind, label, grp, detail, flag, value, start, quote: all that the texts say, one row a finding;
    of ``kinds`` only, if any are given.

    kind and what goes with it: product (grp its unit, detail status, value confidence), rival (detail threat,
    flag active), pain (value confidence), objection (flag resolved), need, decision, next_step, churn, upsell
    and trust (value weight), voice (detail target), budget (detail its kind, flag confidential, value
    amount), persona (detail power), task (grp responsible, detail due date), risk (detail severity),
    opportunity (value probability), aspect (detail polarity, value score). ``start`` is the place of what was
    found in the text, or of its sentence; aspects have none.
    """
    all_, client, x = meetings.sentences, meetings.client, lexicon
    lists = ("products", "rivals", "pains", "objections", "needs", "decisions", "next_steps", "churn", "upsell", "trust", "voice", "roles", "ours", "theirs")
    asked = {name for kind in kinds or LISTS for name in LISTS[kind]}
    hits = X.hits_of(all_, {name: getattr(x, name) if name in asked else [] for name in lists})
    own = {name: rows.where("client") for name, rows in hits.items()}
    said = {"need": own["needs"], "decision": hits["decisions"], "next_step": hits["next_steps"], "churn": own["churn"], "upsell": own["upsell"], "trust": hits["trust"]}
    stated = {kind: X.statements(all_, rows) for kind, rows in said.items()}
    out = {kind: _row(rows, kind, label="label", value="weight", start="start", quote="quote") for kind, rows in stated.items()}
    status = {k: either(v) for k, v in x.status.items()}
    found = X.products(all_, hits["products"], status, X.refused(client, [X.Entry("no", either(x.refusal))]))
    out["product"] = _row(found, "product", label="label", grp="grp", detail="status", value="confidence", start="start", quote="quote")
    rivals = X.competitors(all_, hits["rivals"], either(x.past), either(x.active))
    out["rival"] = _row(rivals, "rival", label="label", detail="threat", flag="active", start="start", quote="quote")
    pains = X.pains(client, own["pains"], either(x.complaint), E.span_score(F.col("search"), x.sentiment).score)
    out["pain"] = _row(pains, "pain", label="label", value="confidence", start="start", quote="quote")
    objections = X.objections(client, own["objections"], either(x.denial), either(x.resolution), either(x.other_party))
    out["objection"] = _row(objections, "objection", label="label", flag="resolved", start="start", quote="quote")
    out["voice"] = _row(P.voice(client, own["voice"], x.aspects), "voice", label="kind", detail="target", start="start", quote="quote")
    budgets = budgets_in(budget_hits(meetings.texts), all_)
    out["budget"] = _row(budgets, "budget", label="currency", detail="kind", flag="confidential", value="amount", start="at", quote="quote")
    persona = P.persona(all_, hits["roles"], either(x.superior), either(x.third_party))
    out["persona"] = _row(persona.where("role is not null or power <> 'unknown'"), "persona", label="role", detail="power", quote="quote")
    tasks = X.tasks(all_, hits["ours"], hits["theirs"], F.col("meeting_date"))
    out["task"] = _row(tasks, "task", label="side", grp="responsible", detail=F.col("due").cast("string"), start="start", quote="quote")
    out["risk"] = _row(X.risks(stated["churn"], rivals), "risk", label="risk", detail="severity")
    has = lambda words: F.coalesce(F.bool_or(F.col("search").rlike(bounded(either(words)))), F.lit(False))
    facts = all_.groupBy("doc_id").agg(has(x.preference).alias("preference"), has(x.conditional).alias("conditional"), has(x.complaint).alias("pain"))
    rich = budgets.select("doc_id").distinct().withColumn("budget", F.lit(True))
    out["opportunity"] = _row(X.opportunities(found, facts.join(rich, "doc_id", "left")), "opportunity", label="label", value="probability")
    out["aspect"] = _row(aspects_of(meetings, x), "aspect", label="aspect", detail="polarity", value="score")
    rows = [out[kind] for kind in kinds or out]  # those that aren't asked for are never run
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    return rows[0]


def briefings(meetings: Meetings, found: DataFrame, lexicon: Lexicon, memory: DataFrame | None = None) -> DataFrame:
    """One row a text: counts, sides, sentiment, scores with their factors, readiness (BANT), value, summary.

    ``found`` is of :func:`findings`. ``memory`` (doc_id, last_interests array, recurring, unresolved, overdue,
    contract_value) is what earlier meetings left; without a row only this meeting counts.
    """
    item = F.struct("kind", "start", "label", "grp", "detail", "flag", "value", "quote")
    grouped = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("found"))
    spoken = meetings.spans.groupBy("doc_id").agg(
        F.sum("words").cast("long").alias("words"), F.bool_or("diarised").alias("diarised"), F.sum(F.col("diarised").cast("long")).alias("turns"),
    )
    share = meetings.spans.where("diarised").join(meetings.roles.select(F.col("doc_id").alias("d"), F.lower("speaker").alias("key"), "side"), (F.col("doc_id") == F.col("d")) & (F.lower("speaker") == F.col("key")))
    share = share.groupBy("doc_id").agg((F.sum(F.when(F.col("side") == "client", F.col("words")).otherwise(0)) / F.sum("words")).alias("client_share"))
    sentences = meetings.sentences.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.bool_or(F.col("search").rlike(bounded(either(lexicon.postponed)))).alias("postponed"))
    rows = meetings.texts.select("doc_id").join(spoken, "doc_id", "left").join(sentences, "doc_id", "left").join(share, "doc_id", "left")
    rows = rows.join(meetings.sides, "doc_id", "left").join(sentiment_of(meetings, lexicon).select("doc_id", "sentiment", F.col("score").alias("sentiment_score")), "doc_id", "left")
    rows = rows.join(grouped, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast(found_type(grouped))))
    rows = rows.fillna({"words": 0, "turns": 0, "sentences": 0, "speakers": 0, "diarised": False, "attributable": False, "postponed": False, "sentiment": "neutral", "sentiment_score": 0.0})
    if memory is not None:
        rows = rows.join(memory, "doc_id", "left")
    else:
        rows = rows.withColumns({"last_interests": F.lit(None).cast("array<int>"), "recurring": F.lit(0), "unresolved": F.lit(0), "overdue": F.lit(0), "contract_value": F.lit(None).cast("double")})
    of = lambda kind: F.filter("found", lambda f: f.kind == kind)
    any_ = lambda kind, test: F.exists(of(kind), lambda f: F.coalesce(test(f), F.lit(False)))
    labelled = lambda kind, *names: any_(kind, lambda f: f.label.isin(*names))
    deltas = F.transform(F.array_distinct(F.transform(of("trust"), lambda f: F.struct(f.label, f.value))), lambda s: s.value)
    rows = rows.withColumn("trust_score", S.trust_score(F.transform(deltas, lambda d: d.cast("int")), F.when(F.col("diarised"), F.col("client_share"))))
    decides = any_("persona", lambda f: f.detail == "decision")
    dated = any_("task", lambda f: f.detail.isNotNull())
    budget = F.element_at(F.transform(F.slice(of("budget"), 1, 1), lambda f: f.value), 1)
    first_budget = F.when(F.size(of("budget")) > 0, budget)
    facts = {
        "asked_proposal": labelled("upsell", "asked_proposal"),
        "dated_commitment": dated,
        "decision_maker": decides,
        "asked_deadline": labelled("upsell", "asked_deadline"),
        "mentioned_expansion": labelled("upsell", "expansion"),
        "stated_preference": labelled("upsell", "preference"),
        "has_budget": F.size(of("budget")) > 0,
        "positive_sentiment": F.col("sentiment") == "positive",
        "high_trust": F.col("trust_score") >= 70,
        "open_price_objection": any_("objection", lambda f: (f.label == "price") & ~f.flag),
        "active_competitor": any_("rival", lambda f: f.flag),
        "postponed": F.col("postponed"),
        "negative_sentiment": F.col("sentiment") == "negative",
        "no_next_step": F.size(of("next_step")) == 0,
    }
    rows = rows.withColumn("factors", S.interest_factors(facts, F.size(of("churn"))))
    threat = lambda f: F.when(f.flag & (f.detail == "high"), COMPETITOR_WEIGHT["high"]).when(f.flag & (f.detail == "medium"), COMPETITOR_WEIGHT["medium"]).otherwise(0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    churn = S.churn_risk(total(F.transform(of("churn"), lambda f: f.value)), total(F.transform(of("rival"), lambda f: threat(f).cast("double"))), F.col("last_interests"), F.coalesce("recurring", F.lit(0)), F.coalesce("unresolved", F.lit(0)), F.coalesce("overdue", F.lit(0)))
    rows = rows.withColumn("interest_score", S.interest_score(F.col("factors"))).withColumn("churn_risk", churn)
    rows = S.with_abstention(rows, F.col("attributable")).withColumn("factors", F.when(F.col("attributable"), F.col("factors")))
    rows = rows.withColumn("churn_band", S.band(F.col("churn_risk")))
    rows = rows.withColumn("bant", S.bant(F.size(of("budget")) > 0, decides, (F.size(of("need")) > 0) | (F.size(of("pain")) > 0), dated))
    rows = rows.withColumn("value", S.business_value(F.col("contract_value"), F.col("churn_risk"), first_budget, F.transform(of("opportunity"), lambda f: f.value)))
    persona = F.get(of("persona"), F.lit(0))
    told = rows.withColumns(
        {
            "products": F.transform(of("product"), lambda f: F.struct(f.label.alias("label"), f.detail.alias("status"))),
            "role": persona.label,
            "power": F.coalesce(persona.detail, F.lit("unknown")),
            "pains": F.transform(of("pain"), lambda f: f.label),
            "aspects": F.transform(of("aspect"), lambda f: F.struct(f.label.alias("aspect"), f.detail.alias("polarity"))),
            "rivals": F.transform(of("rival"), lambda f: F.struct(f.label.alias("label"), f.flag.alias("active"), f.detail.alias("threat"))),
            "chances": F.transform(of("opportunity"), lambda f: F.struct(f.label.alias("label"), f.value.alias("probability"))),
            "budget": first_budget,
            "objections": F.transform(of("objection"), lambda f: F.struct(f.label.alias("label"), f.flag.alias("resolved"))),
            "next_steps": F.transform(of("next_step"), lambda f: f.quote),
        }
    )
    return B.summary(told).drop("client", "score")


def found_type(grouped: DataFrame) -> str:
    return grouped.schema["found"].dataType.simpleString()
