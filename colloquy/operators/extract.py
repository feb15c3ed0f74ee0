"""Extractors: items that a lexicon's patterns find in sentences, each with the quote that supports it.

Sentences are rows (doc_id, sentence_no, start, search, quote, side): ``search`` is folded, ``start`` its
offset in the text, ``side`` seller, client or null. A lexicon is a list of :class:`~.phrases.Phrase`, whose
words are looked up, or of :class:`Entry`, regular expressions: one pattern that joins them finds the
sentences with any, and only those are tested entry by entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed
from colloquy.functions.text import bounded, matches
from colloquy.operators.phrases import Phrase, phrase_hits

__all__ = [
    "Entry", "client_speech", "competitors", "cross_needs", "deadline", "first_per_label", "hits_of", "lexicon_hits", "longest_hits", "objections", "opportunities", "pains", "products", "refused", "risks", "statements",
]


@dataclass(frozen=True)
class Entry:
    """A pattern over folded text, what it stands for, and its weight."""

    label: str
    pattern: str
    weight: float = 1.0
    group: str = ""


def client_speech(sentences: DataFrame, attributable: DataFrame) -> DataFrame:
    """The client's sentences, or all of a text whose sides can't be told apart."""
    rows = sentences.join(attributable.select("doc_id", "attributable"), "doc_id", "left")
    return rows.where(~F.coalesce("attributable", F.lit(False)) | (F.col("side") == "client")).drop("attributable")


def lexicon_hits(sentences: DataFrame, entries: list[Entry] | list[Phrase] | DataFrame) -> DataFrame:
    """Every match of every entry: the sentence's columns, ordinal (of the entry), label, grp, weight, hit_start, hit_end.

    In place of entries, here and wherever they are asked for, may stand the hits themselves, found before with
    those of other lexicons (see :func:`hits_of`).
    """
    if isinstance(entries, DataFrame):
        return entries
    if all(isinstance(e, Phrase) for e in entries):
        return phrase_hits(sentences, list(entries))
    anything = bounded("|".join(f"(?:{e.pattern})" for e in entries))
    some = sentences.where(F.col("search").rlike(anything))
    found = F.array(
        *(
            F.struct(F.lit(i).alias("ordinal"), F.lit(e.label).alias("label"), F.lit(e.group).alias("grp"), F.lit(float(e.weight)).alias("weight"), matches(F.col("search"), bounded(e.pattern)).alias("hits"))
            for i, e in enumerate(entries)
        )
    )
    rows = some.select("*", F.explode(F.filter(found, lambda x: F.size(x.hits) > 0)).alias("x")).select("*", F.explode("x.hits").alias("h"))
    at = F.col("start")
    return rows.select(*sentences.columns, "x.ordinal", "x.label", "x.grp", "x.weight", (at + F.col("h.start")).alias("hit_start"), (at + F.col("h.end")).alias("hit_end"))


def hits_of(sentences: DataFrame, lexicons: dict[str, list[Phrase]]) -> dict[str, DataFrame]:
    """The hits of several lexicons, with every word of the sentences looked up once for all of them."""
    every = [p for phrases in lexicons.values() for p in phrases]
    hits = checkpointed(phrase_hits(sentences, every)) if every else phrase_hits(sentences.where("false"), every)
    out, first = {}, 0
    for name, phrases in lexicons.items():
        own = hits.where(F.col("ordinal").between(first, first + len(phrases) - 1))
        out[name] = own.withColumn("ordinal", F.col("ordinal") - first)
        first += len(phrases)
    return out


def first_per_label(hits: DataFrame, keys: tuple[str, ...] = ("doc_id", "label", "start")) -> DataFrame:
    """One hit for each key, the first by entry, then place."""
    order = Window.partitionBy(*keys).orderBy("ordinal", "hit_start")
    return hits.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def longest_hits(hits: DataFrame) -> DataFrame:
    """Hits that no longer hit of the same sentence contains (ties: the earlier entry stays)."""
    one = F.struct("hit_start", "hit_end", "ordinal")
    whole = hits.withColumn("all", F.collect_list(one).over(Window.partitionBy("doc_id", "sentence_no")))
    size = F.col("hit_end") - F.col("hit_start")

    def covers(o: Column) -> Column:
        inside = (o.hit_start <= F.col("hit_start")) & (o.hit_end >= F.col("hit_end"))
        longer = (o.hit_end - o.hit_start > size) | ((o.hit_end - o.hit_start == size) & (o.ordinal < F.col("ordinal")))
        return inside & longer

    return whole.where(~F.exists("all", covers)).drop("all")


def refused(client: DataFrame, refusals: list[Entry]) -> DataFrame:
    """doc_id, refused: whether a client anywhere refuses to buy."""
    hit = F.col("search").rlike(bounded("|".join(f"(?:{e.pattern})" for e in refusals)))
    return client.groupBy("doc_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("refused"))


def _near(pattern: str, before: int, after: int) -> Column:
    """Whether a pattern stands around a hit, within its sentence."""
    first = F.greatest(F.lit(0), F.col("hit_start") - F.col("start") - before)
    window = F.substring("search", (first + 1).cast("int"), (F.col("hit_end") - F.col("start") + after - first).cast("int"))
    return window.rlike(bounded(pattern))


def products(sentences: DataFrame, entries: list[Entry], contexts: dict[str, str], refusals: DataFrame | None = None) -> DataFrame:
    """doc_id, label, grp, status, confidence, quote, start: each product with its strongest status.

    ``contexts`` has patterns for negated, possession, evaluating, opportunity and pain. A refusal of the
    whole meeting rules out an opportunity.
    """
    rows = longest_hits(lexicon_hits(sentences, entries))
    rows = rows.join(refusals, "doc_id", "left") if refusals is not None else rows.withColumn("refused", F.lit(False))
    near = lambda name, before, after: _near(contexts[name], before, after) if name in contexts else F.lit(False)
    willing = ~F.coalesce("refused", F.lit(False))
    sure = lambda status, confidence: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))
    status = (
        F.when(near("negated", 40, 0), sure("mentioned", 0.8))
        .when(near("possession", 60, 60), sure("in_use", 0.9))
        .when(near("evaluating", 60, 60), sure("evaluating", 0.75))
        .when(near("opportunity", 220, 220) & willing, sure("opportunity", 0.75))
        .when(near("pain", 220, 220) & willing, sure("opportunity", 0.7))
        .otherwise(sure("mentioned", 0.6))
    )
    rows = rows.withColumn("s", status)
    rank = F.array_position(F.array(*map(F.lit, ("in_use", "evaluating", "opportunity", "mentioned"))), F.col("s.status"))
    order = Window.partitionBy("doc_id", "label").orderBy(rank, F.desc("s.confidence"), "hit_start")
    best = rows.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("doc_id", "label", "grp", "s.status", "s.confidence", "quote", F.col("hit_start").alias("start"))


def cross_needs(sentences: DataFrame, entries: list[Entry], direct: DataFrame) -> DataFrame:
    """Needs of a unit (an entry's group) without a product's name: the first match of each unit that has
    no product of its own in ``direct`` (doc_id, grp)."""
    hits = first_per_label(lexicon_hits(sentences, entries), ("doc_id", "grp"))
    return hits.join(direct.select("doc_id", "grp").distinct(), ["doc_id", "grp"], "left_anti")


def competitors(sentences: DataFrame, entries: list[Entry], past: str, active: str) -> DataFrame:
    """doc_id, label, active, threat, quote, start: the most severe mention of each competitor."""
    hits = lexicon_hits(sentences, entries)
    was, now = _near(past, 90, 90), _near(active, 90, 90)
    rows = hits.withColumn("active", ~was & now).withColumn("threat", F.when(was, "low").when(now, "high").otherwise("medium"))
    rank = F.when(F.col("threat") == "high", 3).when(F.col("threat") == "medium", 2).otherwise(1)
    order = Window.partitionBy("doc_id", "label").orderBy(F.desc(rank), "hit_start")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "label", "active", "threat", "quote", F.col("hit_start").alias("start"))


def pains(client: DataFrame, entries: list[Entry], complaint: str, score: Column) -> DataFrame:
    """doc_id, label, confidence, quote, start: one pain a sentence, a domain before a generic one (group
    "generic"), then the longest match; with a complaint (.75) or a clause score of -.15 or less (.6)."""
    hits = lexicon_hits(client, entries).withColumn("clause_score", score)
    said, felt = F.col("search").rlike(bounded(complaint)), F.col("clause_score") <= -0.15
    rows = hits.withColumn("confidence", F.when(said, 0.75).when(felt, 0.6)).where("confidence is not null")
    order = Window.partitionBy("doc_id", "sentence_no").orderBy(F.col("grp") == "generic", F.desc(F.col("hit_end") - F.col("hit_start")), "ordinal", "hit_start")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "label", "confidence", "quote", F.col("hit_start").alias("start"))


def objections(client: DataFrame, entries: list[Entry], negation: str, resolution: str, other_party: str) -> DataFrame:
    """doc_id, label (category), resolved, quote, start: objections that aren't negated; a price objection
    about another party is none. Resolved when a resolution follows within 260 characters."""
    hits = first_per_label(lexicon_hits(client, entries))
    glued = F.substring("search", F.greatest(F.lit(1), F.col("hit_start") - F.col("start") - 21).cast("int"), F.least(F.lit(22), F.col("hit_start") - F.col("start")).cast("int"))
    denied = glued.rlike(bounded(negation)) & ~F.contains(glued, F.lit(","))
    about_other = (F.col("label") == "price") & F.col("search").rlike(bounded(other_party))
    kept = hits.where(~denied & ~about_other)
    return kept.select("doc_id", "label", _near(resolution, 0, 260).alias("resolved"), "quote", F.col("hit_start").alias("start"))


def statements(sentences: DataFrame, entries: list[Entry], least_words: int = 0, without: str | None = None) -> DataFrame:
    """Decisions, next steps, needs, signals: doc_id, label, weight, quote, start, once for each label and
    sentence; sentences of fewer words, or with ``without``, don't count."""
    rows = lexicon_hits(sentences, entries)
    if least_words:
        rows = rows.where(F.size(F.split(F.trim("search"), r"\s+")) >= least_words)
    if without:
        rows = rows.where(~F.col("search").rlike(bounded(without)))
    hits = first_per_label(rows)
    return hits.select("doc_id", "label", "weight", "quote", F.col("hit_start").alias("start"))


def tasks(sentences: DataFrame, ours: list[Entry], theirs: list[Entry], meeting_date: Column) -> DataFrame:
    """doc_id, side, responsible, quote, due, start: promises by the form of their verb, whoever speaks.

    ``sentences`` also has speaker and ``after``, folded text from the sentence's start on to 80 characters
    past its end, in which the due date is sought. A side's repeated sentences count once, the first.
    """
    own = lexicon_hits(sentences, ours).withColumn("task_side", F.lit("ours"))
    rows = own.unionByName(lexicon_hits(sentences, theirs).withColumn("task_side", F.lit("theirs")))
    rows = rows.withColumn("met", meeting_date)
    first = F.min_by(F.struct("speaker", "after", "start", "met"), F.struct("start", "hit_start")).alias("f")
    found = rows.groupBy("doc_id", F.col("task_side").alias("side"), "quote").agg(first)
    return found.select("doc_id", "side", F.col("f.speaker").alias("responsible"), "quote", deadline(F.col("f.after"), F.col("f.met")).alias("due"), F.col("f.start").alias("start"))


def risks(churn: DataFrame, rivals: DataFrame) -> DataFrame:
    """doc_id, risk, severity of churn signals (weight 20: high, 14: medium, else low) and active competitors."""
    severity = F.when(F.col("weight") >= 20, "high").when(F.col("weight") >= 14, "medium").otherwise("low")
    said = churn.select("doc_id", F.col("label").alias("risk"), severity.alias("severity"))
    return said.unionByName(rivals.where("active").select("doc_id", F.col("label").alias("risk"), F.col("threat").alias("severity")))


def opportunities(found: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, label, probability of products seen as opportunity: .5, +.2 pain, +.15 preference, +.1 budget,
    -.3 a weak conditional, within .05 and .95. ``facts`` has doc_id and four booleans."""
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    rows = found.where("status = 'opportunity'").join(facts, "doc_id", "left")
    p = F.lit(0.5) + add("pain", 0.2) + add("preference", 0.15) + add("budget", 0.1) + add("conditional", -0.3)
    return rows.select("doc_id", "label", F.greatest(F.lit(0.05), F.least(F.lit(0.95), p)).alias("probability"))


# Weekdays as they are said, with the names that date functions know, and small numbers in words.
WEEKDAYS = (("domingo", "SUN"), ("segunda", "MON"), ("terca", "TUE"), ("quarta", "WED"), ("quinta", "THU"), ("sexta", "FRI"), ("sabado", "SAT"))
SMALL_NUMBERS = (("um", 1), ("uma", 1), ("dois", 2), ("duas", 2), ("tres", 3), ("quatro", 4), ("cinco", 5), ("seis", 6), ("dez", 10), ("quinze", 15), ("trinta", 30))


def deadline(search: Column, meeting_date: Column) -> Column:
    """The date that folded text names, seen from a meeting; null where it names none.

    The forms are tried in this order, each by its first mention: d/m[/y] (without a year: the meeting's),
    in N days, in N weeks, a weekday (the next one, never the same day), next week, the month's end, next
    month. A form that gives no date, such as 31/02, leaves the choice to the next one.
    """
    number = r"(\d{1,3}|" + "|".join(w for w, _ in SMALL_NUMBERS) + ")"
    named = F.create_map(*(x for w, n in SMALL_NUMBERS for x in (F.lit(w), F.lit(n))))
    days_of = F.create_map(*(F.lit(x) for pair in WEEKDAYS for x in pair))
    part = lambda p, k: F.regexp_extract(search, p, k)
    day = r"(?<!\d)(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?(?!\d)"
    year = F.when(F.length(part(day, 3)) == 4, part(day, 3).try_cast("int")).when(F.length(part(day, 3)) == 2, 2000 + part(day, 3).try_cast("int")).otherwise(F.year(meeting_date))
    stated = F.try_make_timestamp(year, part(day, 2).try_cast("int"), part(day, 1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")

    def count(p: str) -> Column:
        return F.coalesce(part(p, 1).try_cast("int"), F.try_element_at(named, part(p, 1)))

    weekday = F.try_element_at(days_of, part(r"\b(" + "|".join(w for w, _ in WEEKDAYS) + r")\b", 1))
    return F.coalesce(
        stated,
        F.date_add(meeting_date, count(rf"\bem\s+{number}\s+dias?\b")),
        F.date_add(meeting_date, count(rf"\bem\s+{number}\s+semanas?\b") * 7),
        F.call_function("next_day", meeting_date, weekday),
        F.when(search.rlike(r"\b(?:semana que vem|proxima semana)\b"), F.date_add(meeting_date, 7)),
        F.when(search.rlike(r"\b(?:fim|final) do mes\b"), F.last_day(meeting_date)),
        F.when(search.rlike(r"\b(?:mes que vem|proximo mes)\b"), F.add_months(meeting_date, 1)),
    )
