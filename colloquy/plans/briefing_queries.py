"""From any text to its briefing, with the example lexicon, over the driver's chats (see ``analysis_queries``).

The SQL is written from the lexicon's entries and the rules, and reads the same transcripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.functions.text import CONTRAST
from colloquy.operators import analysis as A
from colloquy.operators import anchoring as N
from colloquy.operators import budget as M
from colloquy.operators import memory as M2
from colloquy.operators import scores as S
from colloquy.operators.phrases import Phrase, _variants
from colloquy.plans.analysis_queries import _SENTENCES, MEETING, _due, _texts
from colloquy.plans.example_lexicon import EXAMPLE
from colloquy.plans.text_queries import FOLD

__all__ = ["QUERIES", "SQL"]


def _findings(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return A.findings(A.read_meetings(_texts(spark, sf_dir)), EXAMPLE, kinds)


def _listed(xs: str, *fields: str) -> Column:
    return F.array_join(F.transform(xs, lambda f: F.concat_ws(":", *(f[k].cast("string") for k in fields))), ",")


def meeting_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the conversations say, one row a finding, with its place and quote."""
    rows = _findings(spark, sf_dir)
    return rows.select("doc_id", "kind", "label", "grp", "detail", "flag", F.round("value", 6).alias("value"), F.col("start").alias("start_at"), F.md5(F.col("quote").cast("binary")).alias("quote_md5"))


def meeting_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in figures and words, with the scale that a text carries, limits, estimates and secrecy."""
    rows = _findings(spark, sf_dir, "budget")
    return rows.select("doc_id", F.col("value").alias("amount"), F.col("detail").alias("kind"), F.col("flag").alias("confidential"), F.col("start").alias("start_at"), F.md5(F.col("quote").cast("binary")).alias("quote_md5"))


def client_pains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pain a sentence, a domain before a generic one, by complaint or by the sentence's own score."""
    return _findings(spark, sf_dir, "pain").select("doc_id", "label", F.col("value").alias("confidence"), F.col("start").alias("start_at"))


def client_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Praise and complaints with their target."""
    return _findings(spark, sf_dir, "voice").select("doc_id", F.col("label").alias("kind"), F.col("detail").alias("target"), F.col("start").alias("start_at"))


def client_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client's charged clauses are about."""
    return _findings(spark, sf_dir, "aspect").select("doc_id", F.col("label").alias("aspect"), F.round(F.col("value") + 1e-9, 6).alias("score"), F.col("detail").alias("polarity"))


def meeting_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that a speaker may hold, and the power that goes with it."""
    return _findings(spark, sf_dir, "persona").select("doc_id", F.col("label").alias("role"), F.col("detail").alias("power"))


def meeting_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances to sell, by need, preference, budget and condition."""
    return _findings(spark, sf_dir, "opportunity").select("doc_id", "label", F.round("value", 6).alias("probability"))


def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.0, T5, S4, S6, M11, S1, S2: one row a conversation, with or without speakers."""
    meetings = A.read_meetings(_texts(spark, sf_dir))
    rows = A.briefings(meetings, checkpointed(A.findings(meetings, EXAMPLE)), EXAMPLE)
    return rows.select(
        "doc_id", "words", "turns", "sentences", "diarised", "attributable", "sentiment", _listed("products", "label", "status").alias("products"), F.array_join("pains", ",").alias("pains"),
        _listed("rivals", "label", "threat").alias("rivals"), _listed("objections", "label", "resolved").alias("objections"), "budget", "role", "power", "trust_score", "interest_score",
        F.size("factors").alias("factors"), "churn_risk", "churn_band", F.col("bant.score").alias("bant_score"), F.array_join("bant.missing", ",").alias("bant_missing"),
        F.round("value.opportunity", 2).alias("pipeline"), "summary",
    )


def churn_from_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of what is said and of what earlier meetings left. Conversations are meetings of ten customers, a day each."""
    meetings = A.read_meetings(_texts(spark, sf_dir))
    found = checkpointed(A.findings(meetings, EXAMPLE))
    first = A.briefings(meetings, found, EXAMPLE)
    held = first.select(F.col("doc_id").alias("meeting_id"), (F.col("doc_id") % 10).alias("customer_id"), F.date_add(F.lit(MEETING), F.col("doc_id").cast("int")).alias("meeting_date"), "interest_score")
    left = M2.objections_before(M2.memory_before(checkpointed(held)), found.where("kind = 'objection' and not flag").select(F.col("doc_id").alias("meeting_id"), "label"))
    memory = left.select(F.col("meeting_id").alias("doc_id"), F.col("prior_interests").alias("last_interests"), "recurring", "unresolved", F.lit(0).alias("overdue"), F.lit(None).cast("double").alias("contract_value"))
    rows = A.briefings(meetings, found, EXAMPLE, checkpointed(memory))
    return rows.select("doc_id", "interest_score", F.element_at(F.when(F.size("last_interests") > 0, F.col("last_interests")), -1).alias("prior_interest"), F.col("recurring").cast("int").alias("recurring"), F.col("unresolved").cast("int").alias("unresolved"), "churn_risk", "churn_band")


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all kinds of findings, spaced otherwise, some with words that nobody said, sought in their texts."""
    meetings = A.read_meetings(_texts(spark, sf_dir))
    items = checkpointed(N.evidence_rows(A.findings(meetings, EXAMPLE)))
    spaced = F.replace("quote", F.lit(" "), F.lit(" \n "))
    told = F.when(F.col("doc_id") % 3 == 0, F.concat(spaced, F.lit(" nunca dito"))).when(F.col("doc_id") % 3 == 1, spaced).otherwise(F.col("quote"))
    return N.coverage(items.withColumn("quote", told), meetings.texts.select("doc_id", F.col("safe").alias("text")))


QUERIES = {f.__name__: f for f in (evidence_coverage, churn_from_speech, meeting_findings, meeting_budgets, client_pains, client_voice, client_aspects, meeting_persona, meeting_opportunities, briefing)}

# --- SQL ----------------------------------------------------------------------------------------------

_WORD, _MARK = "[\\p{L}\\p{N}]", "[^\\p{L}\\p{N}\\s]"


def _regex(words: str) -> str:
    """A phrase for an engine without look-around: words divided by white space, gaps of words or marks."""
    ways = []
    for way in _variants(words):
        out = ""
        for k, (word, gap) in enumerate(way):
            skip = f"(?:\\s*(?:{_WORD}+|{_MARK})){{0,{gap}}}?" if gap else ""
            out += (skip + "\\s+" if k else "") + (word[:-1] + _WORD + "*" if word.endswith("*") else word)
        ways.append(out)
    return "|".join(f"(?:{w})" for w in sorted(ways, key=len))


def _any(words: tuple[str, ...]) -> str:
    return "|".join(_regex(w) for w in words) or "[^\\s\\S]"


def _at(words: str, text: str = "search") -> str:
    return f"nullif(length(regexp_extract(' ' || {text} || ' ', '(?s)^(.*?[^\\p{{L}}\\p{{N}}])(?:{_regex(words)})[^\\p{{L}}\\p{{N}}]', 1)), 0) - 1"


def _size(words: str, text: str = "search") -> str:
    return f"length(regexp_extract(' ' || {text} || ' ', '[^\\p{{L}}\\p{{N}}]({_regex(words)})[^\\p{{L}}\\p{{N}}]', 1))"


def _has(words: tuple[str, ...], text: str) -> str:
    return f"regexp_matches(' ' || {text} || ' ', '[^\\p{{L}}\\p{{N}}](?:{_any(words)})[^\\p{{L}}\\p{{N}}]')"


def _near(before: int, after: int, pos: str = "found", size: str = "size", text: str = "search") -> str:
    return f"substr({text}, greatest(0, {pos} - {before}) + 1, {pos} + {size} + {after} - greatest(0, {pos} - {before}))"


def _hits(phrases: list[Phrase], rows: str) -> str:
    """The first hit of each entry in each sentence."""
    each = [
        f"SELECT *, {i} AS ordinal, '{p.label}' AS label, '{p.group}' AS grp, CAST({p.weight} AS DOUBLE) AS weight, {_at(p.words)} AS found, {_size(p.words)} AS size FROM {rows}"
        for i, p in enumerate(phrases)
    ]
    return f"(SELECT * FROM ({' UNION ALL '.join(each)}) WHERE found IS NOT NULL)"


def _first(phrases: list[Phrase], rows: str) -> str:
    """Once for each label and sentence, the first entry's."""
    return f"(SELECT * FROM {_hits(phrases, rows)} QUALIFY row_number() OVER (PARTITION BY doc_id, label, start_at ORDER BY ordinal) = 1)"


def _finding(kind: str, rows: str, **cells: str) -> str:
    names = {"label": "VARCHAR", "grp": "VARCHAR", "detail": "VARCHAR", "flag": "BOOLEAN", "value": "DOUBLE", "place": "BIGINT", "quote": "VARCHAR"}
    return f"SELECT doc_id, '{kind}' AS kind, " + ", ".join(f"CAST({cells.get(k, 'NULL')} AS {t}) AS {k}" for k, t in names.items()) + f" FROM {rows}"


def _scored(name: str, rows: str) -> str:
    """CTEs that score texts (rows: doc_id, pos, search) by the sentiment lexicon: doc_id, pos, score, terms."""
    lexicon = EXAMPLE.sentiment
    scores = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.scores.items())
    factors = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.factors.items())
    return f"""{name}_t AS (SELECT doc_id, pos, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, pos, regexp_extract_all(search, '[\\p{{L}}\\p{{N}}]+') AS w FROM {rows})),
{name}_f AS (SELECT *, CASE token {scores} END AS base, CASE token {factors} ELSE 1.0 END AS factor FROM {name}_t),
{name}_g AS (SELECT doc_id, pos, base * coalesce(lag(factor, 3) OVER w, 1.0) * coalesce(lag(factor, 2) OVER w, 1.0) * coalesce(lag(factor, 1) OVER w, 1.0) AS x FROM {name}_f WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i)),
{name} AS (SELECT doc_id, pos, greatest(-1.0, least(1.0, avg(x::DOUBLE))) AS score, count(*) AS terms FROM {name}_g WHERE x IS NOT NULL GROUP BY 1, 2)"""


_L = EXAMPLE
_STATED = {"need": ("clients", _L.needs), "decision": ("sentences", _L.decisions), "next_step": ("sentences", _L.next_steps), "churn": ("clients", _L.churn), "upsell": ("clients", _L.upsell), "trust": ("sentences", _L.trust)}

_NUMBERS = " ".join(f"WHEN '{w}' THEN {n}" for w, n in M.NUMBERS)
_SCALES = " ".join(f"WHEN '{w}' THEN {n}" for w, n in M.SCALES)
_NUMBER = "(?:" + "|".join(w for w, _ in M.NUMBERS) + ")"
_SCALE = "(?:milhoes|milhao|mil|mi|k)"
#: Amounts: what stands around each pattern is cut off again where the engine has no look-around.
_MONEY = (
    f"r\\$\\s*[0-9.,]*[0-9][0-9.,]*(?:\\s*{_SCALE}\\b)?",
    f"[0-9.,]*[0-9][0-9.,]*\\s*{_SCALE}\\b",
    f"\\b{_NUMBER}(?:\\s+e\\s+{_NUMBER})*\\s+(?:milhoes|milhao|mil)\\b",
    f"\\b(?:{M.ELLIPSIS})\\s+(?:{_NUMBER}|[0-9]{{1,3}})\\b",
)


def _money(k: int, p: str) -> str:
    return f"""SELECT doc_id, t, {k} AS ordinal, hit, CAST(sum(length(before)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM (SELECT doc_id, t, unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS before, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM folded) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


_TOUCH = "(?:^|[^\\p{L}\\p{N}])(?:%s)\\s*(?:r\\$)?\\s*$"
_CUTS = "|".join(CONTRAST)
_RANK = "CASE status WHEN 'in_use' THEN 1 WHEN 'evaluating' THEN 2 WHEN 'opportunity' THEN 3 ELSE 4 END"
_ST = _L.status

_FOUND = f"""{_SENTENCES}, clients AS (SELECT * FROM sentences WHERE client),
{_scored("felt", "(SELECT doc_id, start_at AS pos, search FROM sentences)")},
clauses AS (SELECT doc_id, start_at * 1000 + i AS pos, piece AS search FROM (
  SELECT doc_id, start_at, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, start_at, string_split(regexp_replace(search, '\\b({_CUTS})\\b', chr(1) || '\\1', 'g'), chr(1)) AS p FROM clients)) WHERE length(piece) >= 3),
{_scored("charged", "clauses")},
about AS (SELECT c.*, score, terms FROM clauses c JOIN charged USING (doc_id, pos)),
aspects AS (
  SELECT doc_id, label, greatest(-1.0, least(1.0, sum(score * terms) / sum(terms))) AS score FROM (
    {" UNION ALL ".join(f"SELECT doc_id, '{a.label}' AS label, score, terms FROM about WHERE {_has((a.words,), 'search')}" for a in _L.aspects)}) GROUP BY 1, 2
), polar AS (SELECT *, CASE WHEN score >= 0.22 THEN 'positive' WHEN score <= -0.22 THEN 'negative' END AS polarity FROM aspects WHERE abs(score) >= 0.22),
refusal AS (SELECT doc_id, bool_or({_has(_L.refusal, "search")}) AS refused FROM clients GROUP BY doc_id),
product_hits AS (
  SELECT h.*, CASE WHEN {_has(_ST["negated"], _near(40, 0))} THEN 'mentioned' WHEN {_has(_ST["possession"], _near(60, 60))} THEN 'in_use' WHEN {_has(_ST["evaluating"], _near(60, 60))} THEN 'evaluating'
      WHEN ({_has(_ST["opportunity"], _near(220, 220))} OR {_has(_ST["pain"], _near(220, 220))}) AND NOT coalesce(refused, false) THEN 'opportunity' ELSE 'mentioned' END AS status,
    CASE WHEN {_has(_ST["negated"], _near(40, 0))} THEN 0.8 WHEN {_has(_ST["possession"], _near(60, 60))} THEN 0.9 WHEN {_has(_ST["evaluating"], _near(60, 60))} THEN 0.75
      WHEN {_has(_ST["opportunity"], _near(220, 220))} AND NOT coalesce(refused, false) THEN 0.75 WHEN {_has(_ST["pain"], _near(220, 220))} AND NOT coalesce(refused, false) THEN 0.7 ELSE 0.6 END AS confidence
  FROM (SELECT * FROM {_hits(_L.products, "sentences")} QUALIFY row_number() OVER (PARTITION BY doc_id, start_at, found ORDER BY size DESC, ordinal) = 1) h LEFT JOIN refusal USING (doc_id)
), products AS (SELECT * FROM product_hits QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY {_RANK}, confidence DESC, start_at + found) = 1),
rivals AS (
  SELECT *, CASE WHEN was THEN 'low' WHEN now THEN 'high' ELSE 'medium' END AS threat FROM (SELECT *, {_has(_L.past, _near(90, 90))} AS was, {_has(_L.active, _near(90, 90))} AS now FROM {_hits(_L.rivals, "sentences")})
  QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY CASE WHEN was THEN 1 WHEN now THEN 3 ELSE 2 END DESC, start_at + found) = 1
), pains AS (
  SELECT h.*, CASE WHEN {_has(_L.complaint, "search")} THEN 0.75 WHEN score <= -0.15 THEN 0.6 END AS confidence FROM {_hits(_L.pains, "clients")} h LEFT JOIN felt f ON f.doc_id = h.doc_id AND f.pos = h.start_at
  WHERE {_has(_L.complaint, "search")} OR score <= -0.15
  QUALIFY row_number() OVER (PARTITION BY h.doc_id, start_at ORDER BY grp = 'generic', size DESC, ordinal, found) = 1
), objections AS (
  SELECT *, {_has(_L.resolution, "substr(search, found + 1, size + 260)")} AS resolved FROM (SELECT *, substr(search, greatest(1, found - 21), least(22, found)) AS glued FROM {_first(_L.objections, "clients")})
  WHERE NOT ({_has(_L.denial, "glued")} AND NOT contains(glued, ',')) AND NOT (label = 'price' AND {_has(_L.other_party, "search")})
), voice AS (
  SELECT *, CASE {" ".join(f"WHEN {_has((a.words,), 'search')} THEN '{a.label}'" for a in _L.aspects)} END AS target FROM {_first(_L.voice, "clients")}
), folded AS (SELECT doc_id, {FOLD.replace("text", "whole")} AS t FROM docs),
money AS ({" UNION ALL ".join(_money(k, p) for k, p in enumerate(_MONEY))}),
amounts AS (
  SELECT *, CASE ordinal WHEN 3 THEN CASE WHEN base >= 10 THEN base * 1000 END ELSE base * coalesce(CASE regexp_extract(hit, '({_SCALE})$', 1) {_SCALES} END, 1) END AS amount
  FROM (SELECT *, CASE WHEN regexp_matches(hit, '[0-9]') THEN try_cast(replace(replace(regexp_extract(hit, '([0-9.,]*[0-9][0-9.,]*)', 1), '.', ''), ',', '.') AS DOUBLE)
    ELSE list_sum(list_transform(string_split_regex(regexp_extract(hit, '\\b({_NUMBER}(?:\\s+e\\s+{_NUMBER})*)\\b', 1), '\\s+e\\s+'), lambda w: CASE w {_NUMBERS} END))::DOUBLE END AS base FROM money)
), known AS (SELECT doc_id, list(DISTINCT amount) AS amounts, max(amount) >= 1000 AS scaled FROM amounts WHERE ordinal < 3 AND amount > 0 GROUP BY doc_id),
budgets AS (
  SELECT a.doc_id, a.amount, a.pos, a.ordinal, s.quote,
    CASE WHEN ordinal = 3 THEN 'estimate' WHEN regexp_matches(substr(t, greatest(0, pos - 28) + 1, pos - greatest(0, pos - 28)), '{_TOUCH % M.LIMIT}') THEN 'limit'
      WHEN regexp_matches(substr(t, greatest(0, pos - 28) + 1, pos - greatest(0, pos - 28)), '{_TOUCH % M.ESTIMATE}') THEN 'estimate' ELSE 'stated' END AS kind,
    regexp_matches(' ' || substr(t, greatest(0, pos - 140) + 1, pos + 140 - greatest(0, pos - 140)) || ' ', '[^\\p{{L}}\\p{{N}}](?:{M.SECRECY})[^\\p{{L}}\\p{{N}}]') AS confidential
  FROM amounts a LEFT JOIN known k ON k.doc_id = a.doc_id JOIN sentences s ON s.doc_id = a.doc_id AND a.pos >= s.start_at AND a.pos < s.start_at + length(s.quote)
  WHERE a.amount > 0 AND (ordinal < 3 OR (coalesce(scaled, false) AND NOT list_contains(amounts, a.amount)))
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.amount, CASE WHEN ordinal = 3 THEN -1 ELSE s.start_at END ORDER BY ordinal, pos) = 1
), above AS (SELECT doc_id, bool_or({_has(_L.superior, "search")}) AS above FROM sentences GROUP BY doc_id),
held AS (
  SELECT * FROM (SELECT *, {_at(_L.superior[0])} AS up, {_size(_L.superior[0])} AS up_size FROM {_hits(_L.roles, "sentences")})
  WHERE NOT coalesce(up <= found AND found + size <= up + up_size, false) AND NOT {_has(_L.third_party, "substr(search, greatest(0, found - 40) + 1, found - greatest(0, found - 40))")}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, start_at + found) = 1
), persona AS (
  SELECT a.doc_id, h.label AS role, h.quote, CASE WHEN above THEN 'influencer' ELSE coalesce(h.grp, 'unknown') END AS power FROM above a LEFT JOIN held h USING (doc_id)
), after AS (SELECT s.doc_id, s.start_at, substr({FOLD.replace("text", "p.text")}, s.start_at - p.start_at + 1, length(s.quote) + 80) AS after_text
  FROM sentences s JOIN spans p ON p.doc_id = s.doc_id AND p.start_at <= s.start_at AND s.start_at < p.start_at + length(p.text)),
promised AS (
  SELECT *, 'ours' AS side_of FROM {_hits(_L.ours, "sentences")} UNION ALL SELECT *, 'theirs' FROM {_hits(_L.theirs, "sentences")}
), tasks AS (
  SELECT h.doc_id, side_of, speaker, quote, start_at, {_due("after_text")} AS due FROM promised h JOIN after USING (doc_id, start_at) QUALIFY row_number() OVER (PARTITION BY h.doc_id, side_of, quote ORDER BY start_at, found) = 1
), churn AS (SELECT * FROM {_first(_L.churn, "clients")}),
facts AS (SELECT doc_id, bool_or({_has(_L.preference, "search")}) AS preference, bool_or({_has(_L.conditional, "search")}) AS conditional, bool_or({_has(_L.complaint, "search")}) AS pain FROM sentences GROUP BY doc_id),
chances AS (
  SELECT p.doc_id, label, greatest(0.05, least(0.95, 0.5::DOUBLE + CASE WHEN pain THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN preference THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN p.doc_id IN (SELECT doc_id FROM budgets) THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN conditional THEN -0.3::DOUBLE ELSE 0 END)) AS probability
  FROM products p JOIN facts USING (doc_id) WHERE status = 'opportunity'
), f AS (
{" UNION ALL ".join(_finding(kind, _first(phrases, rows), label="label", value="weight", place="start_at + found", quote="quote") for kind, (rows, phrases) in _STATED.items())}
UNION ALL {_finding("product", "products", label="label", grp="grp", detail="status", value="confidence", place="start_at + found", quote="quote")}
UNION ALL {_finding("rival", "rivals", label="label", detail="threat", flag="threat = 'high'", place="start_at + found", quote="quote")}
UNION ALL {_finding("pain", "pains", label="label", value="confidence", place="start_at + found", quote="quote")}
UNION ALL {_finding("objection", "objections", label="label", flag="resolved", place="start_at + found", quote="quote")}
UNION ALL {_finding("voice", "voice", label="label", detail="target", place="start_at", quote="quote")}
UNION ALL {_finding("budget", "budgets", label="'BRL'", detail="kind", flag="confidential", value="amount", place="pos", quote="quote")}
UNION ALL {_finding("persona", "persona", label="role", detail="power", quote="quote")} WHERE role IS NOT NULL OR power <> 'unknown'
UNION ALL {_finding("task", "tasks", label="side_of", grp="speaker", detail="due", place="start_at", quote="quote")}
UNION ALL {_finding("risk", "churn", label="label", detail="CASE WHEN weight >= 20 THEN 'high' WHEN weight >= 14 THEN 'medium' ELSE 'low' END")}
UNION ALL {_finding("risk", "rivals", label="label", detail="threat")} WHERE threat = 'high'
UNION ALL {_finding("opportunity", "chances", label="label", value="probability")}
UNION ALL {_finding("aspect", "polar", label="label", detail="polarity", value="score")}
)"""

_DELTA = S.INTEREST


def _of(kind: str) -> str:
    return f"list_filter(found, lambda x: x.kind = '{kind}')"


def _some(kind: str, test: str = "true") -> str:
    return f"len(list_filter(found, lambda x: x.kind = '{kind}' AND coalesce({test}, false))) > 0"


_FACTS = {
    "asked_proposal": _some("upsell", "x.label = 'asked_proposal'"), "dated_commitment": _some("task", "x.detail IS NOT NULL"), "decision_maker": _some("persona", "x.detail = 'decision'"),
    "asked_deadline": _some("upsell", "x.label = 'asked_deadline'"), "mentioned_expansion": _some("upsell", "x.label = 'expansion'"), "has_budget": _some("budget"), "positive_sentiment": "sentiment = 'positive'",
    "high_trust": "trust_score >= 70", "open_price_objection": _some("objection", "x.label = 'price' AND NOT x.flag"), "active_competitor": _some("rival", "x.flag"), "postponed": "postponed",
    "negative_sentiment": "sentiment = 'negative'", "no_next_step": f"NOT ({_some('next_step')})",
}
_SUM = " + ".join(f"CASE WHEN {test} THEN {_DELTA[k]} ELSE 0 END" for k, test in _FACTS.items())
_COUNT = " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in _FACTS.values())


def _join(kind: str, *fields: str) -> str:
    return f"coalesce(array_to_string(list_transform({_of(kind)}, lambda x: concat_ws(':', {', '.join('x.' + f for f in fields)})), ','), '')"


def _names(kind: str, test: str) -> str:
    return f"nullif(array_to_string(list_transform(list_filter(found, lambda x: x.kind = '{kind}' AND {test}), lambda x: x.label), ', '), '')"


_BRIEF = f"""{_FOUND}, grouped AS (
  SELECT doc_id, list({{'kind': kind, 'place': place, 'label': label, 'grp': grp, 'detail': detail, 'flag': flag, 'value': value, 'quote': quote}} ORDER BY kind, place NULLS FIRST, label NULLS FIRST, grp NULLS FIRST, detail NULLS FIRST, value NULLS FIRST) AS found FROM f GROUP BY doc_id
), mood AS (
  SELECT doc_id, greatest(-1.0, least(1.0, sum(score * terms) / sum(terms))) AS score, count(*) FILTER (WHERE score >= 0.22) AS up, count(*) FILTER (WHERE score <= -0.22) AS down FROM about GROUP BY doc_id
), opposed AS (SELECT doc_id, count(DISTINCT polarity) > 1 AS opposed FROM polar GROUP BY doc_id),
shares AS (
  SELECT t.doc_id, sum(CASE WHEN side = 'client' THEN words ELSE 0 END) / sum(words) AS client_share FROM turns t JOIN roles r ON r.doc_id = t.doc_id AND r.speaker = t.speaker GROUP BY t.doc_id
), counted AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (WHERE speaker IS NOT NULL) AS turns FROM spans GROUP BY doc_id),
said AS (SELECT doc_id, count(*) AS sentences, bool_or({_has(_L.postponed, "search")}) AS postponed FROM sentences GROUP BY doc_id),
base AS (
  SELECT d.doc_id, words, turns, sentences, diarised, coalesce(attributable, false) AS attributable, coalesce(postponed, false) AS postponed, coalesce(found, []) AS found, client_share,
    CASE WHEN (least(up, down) * 4 >= up + down AND (least(up, down) >= 2 OR (up + down <= 6 AND least(up, down) >= 1))) OR coalesce(opposed, false) THEN 'mixed' WHEN score >= 0.22 THEN 'positive' WHEN score <= -0.22 THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN sides USING (doc_id) LEFT JOIN grouped USING (doc_id) LEFT JOIN mood USING (doc_id) LEFT JOIN opposed USING (doc_id) LEFT JOIN shares USING (doc_id)
), trusted AS (
  SELECT *, CAST(greatest(0, least(100, 50 + coalesce(list_sum(list_transform(list_distinct(list_transform({_of("trust")}, lambda x: {{'l': x.label, 'v': x.value}})), lambda x: x.v)), 0) - CASE WHEN diarised AND client_share < 0.2 THEN 10 ELSE 0 END)) AS INT) AS trust_score FROM base
), weighed AS (
  SELECT *, 50 + {_SUM} + greatest(-30, -15 * len({_of("churn")})) AS total, 1 + {_COUNT} + CASE WHEN {_some("churn")} THEN 1 ELSE 0 END AS factor_count,
    least(100.0, least(100.0, 1.5 * coalesce(list_sum(list_transform({_of("churn")}, lambda x: x.value)), 0)) + 20 * len(list_filter(found, lambda x: x.kind = 'rival' AND x.flag AND x.detail = 'high'))) AS risk,
    {_of("budget")}[1].value AS budget, {_of("persona")}[1].label AS role, coalesce({_of("persona")}[1].detail, 'unknown') AS power,
    [{_some("budget")}, {_some("persona", "x.detail = 'decision'")}, {_some("need")} OR {_some("pain")}, {_some("task", "x.detail IS NOT NULL")}] AS ready
  FROM trusted
), told AS (
  SELECT *, {_names("product", "x.detail = 'in_use'")} AS used, {_names("aspect", "x.detail = 'positive'")} AS good, {_names("aspect", "x.detail = 'negative'")} AS bad,
    list_filter(found, lambda x: x.kind = 'rival' AND x.flag)[1] AS rival, list_filter(found, lambda x: x.kind = 'objection' AND NOT x.flag)[1] AS objection,
    list_sort(list_transform({_of("opportunity")}, lambda x: {{'p': -x.value, 'l': x.label}}))[1] AS chance
  FROM weighed
), drafted AS (
  SELECT *, [
    nullif(concat_ws(' ', 'The client works with ' || used || '.', 'The speaker is ' || role || '.'), ''),
    'The main pain is ' || {_of("pain")}[1].label || CASE WHEN len({_of("pain")}) > 1 THEN ', with ' || (len({_of("pain")}) - 1) || ' more.' ELSE '.' END,
    'Content with ' || good || ', discontent with ' || bad || '.',
    rival.label || ' is in the race, threat ' || rival.detail || '.',
    nullif(concat_ws(' ', 'Chance to sell ' || chance.l || ': ' || CAST(floor(-chance.p * 100 + 0.5) AS INT) || '%.', CASE WHEN budget > 0 THEN 'A budget of R$ ' || format('{{:,.2f}}', budget) || ' was named.' END), ''),
    'The objection ' || objection.label || ' has no answer yet.',
    coalesce('Next step: ' || {_of("next_step")}[1].quote, 'No next step was agreed.')] AS parts
  FROM told
)
SELECT doc_id, words, turns, sentences, diarised, attributable, sentiment, {_join("product", "label", "detail")} AS products, {_join("pain", "label")} AS pains, {_join("rival", "label", "detail")} AS rivals,
  coalesce(array_to_string(list_transform({_of("objection")}, lambda x: x.label || ':' || x.flag), ','), '') AS objections, budget, role, power, trust_score,
  CASE WHEN attributable THEN CAST(greatest(0, least(100, total)) AS INT) END AS interest_score, CASE WHEN attributable THEN CAST(factor_count + CASE WHEN total < 0 OR total > 100 THEN 1 ELSE 0 END AS INT) END AS factors,
  CASE WHEN attributable THEN CAST(floor(risk + 0.5) AS INT) END AS churn_risk, CASE WHEN attributable THEN CASE WHEN floor(risk + 0.5) >= 67 THEN 'high' WHEN floor(risk + 0.5) >= 34 THEN 'medium' ELSE 'low' END END AS churn_band,
  CAST(len(list_filter(ready, lambda x: x)) AS INT) AS bant_score, concat_ws(',', CASE WHEN NOT ready[1] THEN 'budget' END, CASE WHEN NOT ready[2] THEN 'authority' END, CASE WHEN NOT ready[3] THEN 'need' END, CASE WHEN NOT ready[4] THEN 'timing' END) AS bant_missing,
  round(coalesce(budget, 0) * coalesce(list_sum(list_transform({_of("opportunity")}, lambda x: x.value)), 0), 2) AS pipeline, array_to_string(list_filter(parts, lambda x: x IS NOT NULL)[1:6], ' ') AS summary
FROM drafted"""

SQL = {
    "meeting_findings": f"WITH {_FOUND} SELECT doc_id, kind, label, grp, detail, flag, round(value, 6) AS value, place AS start_at, md5(quote) AS quote_md5 FROM f",
    "meeting_budgets": f"WITH {_FOUND} SELECT doc_id, amount, kind, confidential, pos AS start_at, md5(quote) AS quote_md5 FROM budgets",
    "client_pains": f"WITH {_FOUND} SELECT doc_id, label, value AS confidence, place AS start_at FROM f WHERE kind = 'pain'",
    "client_voice": f"WITH {_FOUND} SELECT doc_id, label AS kind, detail AS target, place AS start_at FROM f WHERE kind = 'voice'",
    "client_aspects": f"WITH {_FOUND} SELECT doc_id, label AS aspect, round(score + 1e-9, 6) AS score, polarity FROM polar",
    "meeting_persona": f"WITH {_FOUND} SELECT doc_id, label AS role, detail AS power FROM f WHERE kind = 'persona'",
    "meeting_opportunities": f"WITH {_FOUND} SELECT doc_id, label, round(probability, 6) AS probability FROM chances",
    "briefing": f"WITH {_BRIEF}",
    "evidence_coverage": f"""WITH {_FOUND}, said AS (
  SELECT f.*, regexp_replace(trim(CASE doc_id % 3 WHEN 0 THEN quote || ' nunca dito' ELSE quote END), '\\s+', ' ', 'g') AS bare, regexp_replace(whole, '\\s+', ' ', 'g') AS text FROM f JOIN docs USING (doc_id)
)
SELECT kind, count(*) AS items, count(quote) AS quoted, count(*) FILTER (WHERE length(bare) >= 8 AND contains(text, bare)) AS covered,
  count(*) FILTER (WHERE length(bare) >= 8 AND contains(text, bare)) / count(*) AS coverage FROM said GROUP BY kind""",
    "churn_from_speech": f"""WITH brief AS (WITH {_BRIEF}), said AS (WITH {_FOUND} SELECT DISTINCT doc_id, label FROM f WHERE kind = 'objection' AND NOT flag), heard AS (
  WITH {_FOUND} SELECT doc_id, 1.5 * coalesce(sum(value) FILTER (WHERE kind = 'churn'), 0) AS signals, 20 * count(*) FILTER (WHERE kind = 'rival' AND flag AND detail = 'high') AS threats FROM f GROUP BY doc_id
), m AS (
  SELECT *, doc_id % 10 AS c, list(interest_score) FILTER (WHERE interest_score IS NOT NULL) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM brief
), o AS (
  SELECT m.doc_id, count(*) FILTER (WHERE k = 1 AND s.doc_id < m.doc_id) AS recurring, count(*) FILTER (WHERE k = 2 AND s.doc_id < m.doc_id) AS unresolved
  FROM m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id % 10, label ORDER BY doc_id) AS k FROM said) s ON s.doc_id % 10 = m.c GROUP BY m.doc_id
), parts AS (
  SELECT m.doc_id, interest_score, attributable, prior[-1] AS prior_interest, recurring, unresolved, least(100.0, least(100.0, coalesce(signals, 0)) + coalesce(threats, 0))::DOUBLE AS said,
    CASE WHEN len(prior) >= 2 THEN greatest(0, least(100, prior[greatest(1, len(prior) - 2)] - prior[-1])) END AS fall, CASE WHEN recurring > 0 THEN least(100, unresolved * 35) END AS open
  FROM m JOIN o USING (doc_id) LEFT JOIN heard USING (doc_id)
), r AS (
  SELECT *, CASE WHEN attributable THEN CAST(floor((0.0::DOUBLE + said * 0.6::DOUBLE + coalesce(fall * 0.2::DOUBLE, 0) + coalesce(open * 0.1::DOUBLE, 0))
    / (0.0::DOUBLE + 0.6::DOUBLE + CASE WHEN fall IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN open IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END) + 0.5) AS INT) END AS churn_risk FROM parts
)
SELECT doc_id, interest_score, prior_interest, CAST(recurring AS INT) AS recurring, CAST(unresolved AS INT) AS unresolved, churn_risk,
  CASE WHEN churn_risk >= 67 THEN 'high' WHEN churn_risk >= 34 THEN 'medium' WHEN churn_risk IS NOT NULL THEN 'low' END AS churn_band FROM r""",
}
