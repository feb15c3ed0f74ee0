"""Money amounts that a conversation names, in figures or in words, with what qualifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import bounded, evidence, matches, once

__all__ = ["budget_hits", "budgets", "budgets_in", "spoken_amount"]

# Numbers in (folded) words, scales, and words that qualify an amount.
NUMBERS = (
    ("um", 1), ("dois", 2), ("tres", 3), ("quatro", 4), ("cinco", 5), ("seis", 6), ("sete", 7), ("oito", 8), ("nove", 9), ("dez", 10),
    ("onze", 11), ("doze", 12), ("treze", 13), ("catorze", 14), ("quatorze", 14), ("quinze", 15), ("dezesseis", 16), ("dezessete", 17),
    ("dezoito", 18), ("dezenove", 19), ("vinte", 20), ("trinta", 30), ("quarenta", 40), ("cinquenta", 50), ("sessenta", 60), ("setenta", 70),
    ("oitenta", 80), ("noventa", 90), ("cem", 100), ("cento", 100), ("duzentos", 200), ("trezentos", 300), ("quatrocentos", 400),
    ("quinhentos", 500), ("seiscentos", 600), ("setecentos", 700), ("oitocentos", 800), ("novecentos", 900), ("meio", 0.5),
)
SCALES = (("mil", 1e3), ("k", 1e3), ("milhao", 1e6), ("milhoes", 1e6), ("mi", 1e6))
LIMIT = "no maximo|limite de|teto de|ate"
ESTIMATE = "por volta de|cerca de|uns|umas|em torno de|aproximadamente"
ELLIPSIS = "uns|umas|por volta de|em torno de|cerca de|seria|fica em|chegar? (?:a|em)|nos"
SECRECY = "nao (?:menciona|mencione|comenta|comente|fala|fale|conta|conte)|confidencial|entre (?:nos|a gente)|segredo|sigilo|nao espalha|fica entre"

_WORD = "(?:" + "|".join(w for w, _ in NUMBERS) + ")"
_SCALE = "(?:milhoes|milhao|mil|mi|k)(?![a-z0-9_])"
#: In order: with the currency, a figure with a scale, words with a scale, and a figure whose scale is left out.
PATTERNS = (
    rf"r\$\s*[0-9.,]*[0-9][0-9.,]*(?:\s*{_SCALE})?",
    rf"[0-9.,]*[0-9][0-9.,]*\s*{_SCALE}",
    rf"(?<![\p{{L}}\p{{N}}]){_WORD}(?:\s+e\s+{_WORD})*\s+(?:milhoes|milhao|mil)(?![a-z0-9_])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{ELLIPSIS})\s+(?:{_WORD}|[0-9]{{1,3}})(?![\p{{L}}\p{{N}}])",
)


def _lookup(pairs: tuple[tuple[str, float], ...]) -> Column:
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), F.lit(float(v)))))


def spoken_amount(hit: Column) -> Column:
    """The number of a folded mention, its scale applied; null where there is none. ``1.234,5`` is 1234.5."""
    figures = F.regexp_extract(hit, "([0-9.,]*[0-9][0-9.,]*)", 1)
    number = F.replace(F.replace(figures, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    said = F.regexp_extract(hit, rf"(?<![\p{{L}}\p{{N}}])({_WORD}(?:\s+e\s+{_WORD})*)(?![\p{{L}}\p{{N}}])", 1)
    names = _lookup(NUMBERS)
    spoken = F.aggregate(F.split(said, r"\s+e\s+"), F.lit(0.0), lambda acc, w: acc + F.element_at(names, w))
    scale = F.element_at(_lookup(SCALES), F.regexp_extract(hit, rf"({_SCALE})$", 1))
    return F.when(F.length(figures) > 0, number).otherwise(spoken) * F.coalesce(scale, F.lit(1.0))


#: The place of the bare figures, whose scale is left out, among the patterns.
BARE = len(PATTERNS) - 1


def _around(h: Column, before: int, after: int) -> Column:
    first = F.greatest(F.lit(0), h.at - before)
    return F.substring("search", (first + 1).cast("int"), (h.at + after - first).cast("int"))


def _settled() -> Column:
    """Hits of a text's own row: array of (ordinal, at, upto, amount), the scale applied that the text carries."""

    def found(ordinal: int, pattern: str) -> Column:
        def hit(m: Column) -> Column:
            amount = spoken_amount(m.text)
            if ordinal == BARE:
                amount = F.when(amount >= 10, amount * 1000)
            return F.struct(F.lit(ordinal).alias("ordinal"), m.start.alias("at"), m.end.alias("upto"), amount.alias("amount"))

        return F.transform(matches(F.col("search"), pattern), hit)

    def settled(hits: Column) -> Column:
        known = F.array_distinct(F.transform(F.filter(hits, lambda h: h.ordinal < BARE), lambda h: h.amount))
        return once(known, lambda k: F.filter(hits, lambda h: (h.ordinal < BARE) | (F.exists(k, lambda a: a >= 1000) & ~F.array_contains(k, h.amount))))

    return once(F.filter(F.concat(*(found(i, p) for i, p in enumerate(PATTERNS))), lambda h: h.amount > 0), settled)


def _told(h: Column, *more: Column) -> Column:
    """What a hit says and what stands around it."""
    touches = lambda p: _around(h, 28, 0).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{p})\s*(?:r\$)?\s*$")
    kind = F.when(h.ordinal == BARE, "estimate").when(touches(LIMIT), "limit").when(touches(ESTIMATE), "estimate").otherwise("stated")
    raw = F.trim(F.substring("safe", (h.at + 1).cast("int"), (h.upto - h.at).cast("int")))
    return F.struct(
        h.ordinal.alias("ordinal"), h.at.alias("at"), h.amount.alias("amount"), F.lit("BRL").alias("currency"), raw.alias("raw"), kind.alias("kind"),
        _around(h, 140, 140).rlike(bounded(SECRECY)).alias("confidential"), *more,
    )


def _once_a_sentence(rows: DataFrame, start: str) -> DataFrame:
    """The first hit of an amount in a sentence; a bare figure's amount counts once a text."""
    place = F.when(F.col("ordinal") == BARE, -1).otherwise(F.col(start))
    rest = [c for c in rows.columns if c not in ("doc_id", "amount", "ordinal", "at")]
    first = rows.groupBy("doc_id", "amount", place.alias("place")).agg(F.min(F.struct("ordinal", "at", *rest)).alias("h"))
    return first.select("doc_id", "amount", "h.at", *(f"h.{c}" for c in rest))


def budget_hits(texts: DataFrame) -> DataFrame:
    """doc_id, ordinal, at, amount, currency, raw, kind, confidential: every mention of an amount in texts
    (doc_id, safe, search). Settled in the text's own row, so no text is shuffled."""
    return texts.select("doc_id", F.explode(F.transform(_settled(), lambda h: _told(h))).alias("h")).select("doc_id", "h.*")


def budgets_in(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, amount, at, currency, raw, kind, confidential, quote, start, end of hits by the sentences (doc_id, start, end,
    quote) in which they stand. An amount outside of all sentences, as in a speaker's label, is none."""
    own = sentences.select(F.col("doc_id").alias("d"), "start", "end", "quote")
    rows = hits.join(own, (F.col("doc_id") == F.col("d")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).drop("d")
    return _once_a_sentence(rows, "start")


def budgets(texts: DataFrame) -> DataFrame:
    """doc_id, amount, currency, raw, kind (limit, estimate, stated), confidential, quote, start, end of texts
    (doc_id, safe, search, spans: the array of its sentences' start and end).

    An amount counts once a sentence. Where a text names thousands, a bare figure from ten up after words
    such as "about" means thousands too, unless the amount is known already. Null texts name nothing.

    Hits, the scale they carry and what stands around them are settled in the text's own row; what is
    shuffled to find repeated amounts is a quote for each hit, never a text.
    """

    def told(h: Column) -> Column:
        return _told(h, evidence(F.col("safe"), F.col("spans"), h.at, h.upto).alias("e"))

    rows = texts.select("doc_id", F.explode(F.transform(_settled(), told)).alias("h")).select("doc_id", "h.*")
    return _once_a_sentence(rows.select("*", F.col("e.start").alias("from")), "from").select("doc_id", "amount", "currency", "raw", "kind", "confidential", "e.quote", "e.start", "e.end")
