"""Text preparation as Column expressions: nothing here changes a text's length in code points.

A text is prepared once (masked, folded) and every position found in the folded copy is valid in the
masked one, so evidence can be quoted by offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["REDACTION_RULES", "WORD", "blank", "bounded", "clauses", "context", "count_words", "evidence", "fold", "matches", "mentions", "once", "parts", "redact", "redactions", "running_sums", "words"]

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"

# Letters that lose their accent, and what they become.
ACCENTED = "áàãâäéèêëíìîïóòõôöúùûüçñ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucn"

_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Kinds of personal data and their patterns, the most specific first.
REDACTION_RULES = (
    ("cnpj", _EDGE + r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}" + _END),
    ("cnpj", _EDGE + r"[0-9]{14}" + _END),
    ("cartao", _EDGE + r"[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}" + _END),
    ("cpf", _EDGE + r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}" + _END),
    ("cpf", _EDGE + r"[0-9]{11}" + _END),
    ("email", _EDGE + r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]"),
    ("telefone", r"\([0-9]{2}\)\s?[0-9]{4,5}-?[0-9]{4}" + _END),
    ("telefone", _EDGE + r"[0-9]{2}\s?9?[0-9]{4}-[0-9]{4}" + _END),
    ("telefone", _EDGE + r"9[0-9]{4}-[0-9]{4}" + _END),
)

#: What each of the rules needs somewhere; a text without it has nothing to mask and is scanned once.
REDACTABLE = r"[0-9]{4}|[0-9]{3}\.[0-9]{3}|@"

# Time stamps and marks of speech that was not understood.
TIMESTAMP = r"\[?\(?(?<![A-Za-z0-9_])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?![A-Za-z0-9_])\)?\]?"
INAUDIBLE = r"(?i)\[(?:inaud[ií]vel|incompreens[ií]vel|\?+|risos|sil[êe]ncio)\]"
CONTRAST = ("mas", "porem", "entretanto", "contudo", "todavia", "so que", "apesar", "embora", "ja o", "enquanto")


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def bounded(pattern: str) -> str:
    """``pattern`` where no letter or digit stands next to it."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])"


def mentions(text: Column, pattern: str) -> Column:
    """Whether a folded text has ``pattern`` as whole words."""
    return text.rlike(bounded(pattern))


def _pieces(text: Column, pattern: str) -> Column:
    """Text before each match, with the match (null after the last)."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("before"), b.alias("hit")))


#: Values that are summed at a time: a running sum over n values takes n * RUN / 2 + (n / RUN) ** 2 / 2 additions.
RUN = 64
#: A character that marks a cut; one that a text has itself counts as a blank there.
CUT = "\ue001"


def running_sums(values: Column) -> Column:
    """For each of an array of integers the sum of those before it. Runs are summed first, so a long array is not copied once a value."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def within(runs: Column) -> Column:
        sums = F.transform(runs, total)
        return once(sums, lambda ss: F.flatten(F.zip_with(runs, F.transform(ss, lambda x, k: total(F.slice(ss, F.lit(1), k))), shifted)))

    def shifted(run: Column, before: Column) -> Column:
        return F.transform(run, lambda x, i: before + total(F.slice(run, F.lit(1), i)))

    def runs(xs: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(xs) / RUN).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))

    return once(values, lambda xs: F.when(xs.isNotNull(), once(runs(xs), within)))


def parts(strings: Column, opens: Callable[[Column], Column]) -> Column:
    """Strings joined, and cut again before those for which ``opens`` holds: array of (at, text) in code points.

    The first part is what stands before the first cut, empty if nothing does.
    """
    clean = lambda x: F.translate(x, CUT, " ")
    joined = F.array_join(F.transform(strings, lambda x: F.when(opens(x), F.concat(F.lit(CUT), clean(x))).otherwise(clean(x))), "")
    lengths = lambda xs: running_sums(F.transform(xs, lambda x: F.length(x)))
    return once(F.split(joined, CUT, -1), lambda xs: F.zip_with(lengths(xs), xs, lambda at, x: F.struct(at.alias("at"), x.alias("text"))))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of every match, with code point offsets. Null text: null."""
    kind = "array<struct<start:int,end:int,text:string>>"

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p.before) + F.coalesce(F.length(p.hit), F.lit(0)))

        def hit(p: Column, at: Column) -> Column:
            start = at + F.length(p.before)
            return F.struct(start.alias("start"), (start + F.length(p.hit)).alias("end"), p.hit.alias("text"))

        return F.filter(F.zip_with(pieces, running_sums(sizes), hit), lambda m: m.text.isNotNull())

    def found(t: Column) -> Column:
        none = F.when(t.isNotNull(), F.array().cast(kind))
        return F.when(t.rlike(pattern), once(_pieces(t, pattern), placed)).otherwise(none)

    return once(text, found)


def _replaced(text: Column, pattern: str, by: Column) -> Column:
    """Every match replaced by ``by(match)``, which keeps its length."""

    def replaced(t: Column) -> Column:
        pieces = F.transform(_pieces(t, pattern), lambda p: F.concat(p.before, F.coalesce(by(p.hit), F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return once(text, replaced)


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTION_RULES) -> Column:
    """Text with personal data masked by ``#``; separators ``.-/()`` and blanks stay.

    Rules run in order on what earlier ones left, so the most specific claims a span.
    """


    def masked(t: Column) -> Column:
        for _, pattern in rules:
            t = _replaced(t, pattern, lambda hit: F.regexp_replace(hit, r"[^.\-/() ]", "#"))
        return t

    if not set(rules) <= set(REDACTION_RULES):
        return masked(text)
    return once(text, lambda t: F.when(t.rlike(REDACTABLE), masked(t)).otherwise(t))


def redactions(text: Column, rules: tuple[tuple[str, str], ...] = REDACTION_RULES) -> Column:
    """What :func:`redact` masks: array of (start, end, type) in the order of the text. Null text: null."""
    def claimed(k: int, rule: tuple[str, str]) -> Column:
        left = redact(text, rules[:k])
        return F.transform(matches(left, rule[1]), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(rule[0]).alias("type")))

    return F.array_sort(F.concat(*(claimed(k, rule) for k, rule in enumerate(rules))))


def blank(text: Column, pattern: str) -> Column:
    """Text with every match blanked out."""
    return _replaced(text, pattern, lambda hit: F.repeat(F.lit(" "), F.length(hit)))


def fold(text: Column) -> Column:
    """Lower case without accents, code point by code point."""
    keep = "\ue000"  # U+0130 would become two characters
    kept = lambda t: F.translate(F.lower(F.translate(t, "İ", keep)), keep, "İ")
    return F.translate(once(text, lambda t: F.when(F.contains(t, F.lit("İ")) | F.contains(t, F.lit(keep)), kept(t)).otherwise(F.lower(t))), ACCENTED, UNACCENTED)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def context(text: Column, start: Column, end: Column, width: int = 90) -> Column:
    """The text from ``width`` characters before a match to as many after it."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, (first + 1).cast("int"), (end + width - first).cast("int"))


def evidence(text: Column, sentences: Column, start: Column, end: Column, around: int = 60) -> Column:
    """The sentence (array of start, end) in which a match starts, else the text around it: quote, start, end."""
    own = F.get(F.filter(sentences, lambda s: (s.start <= start) & (start < s.end)), F.lit(0))
    first = F.coalesce(own.start, F.greatest(F.lit(0), start - around))
    last = F.coalesce(own.end, F.least(F.length(text), end + around))
    return F.struct(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")).alias("quote"), first.alias("start"), last.alias("end"))


def clauses(sentence: Column, connectives: tuple[str, ...] = CONTRAST) -> Column:
    """A folded sentence cut before its contrast connectives; clauses under three characters go."""
    cut = F.split(sentence, rf"(?<![A-Za-z0-9_])(?=(?:{'|'.join(connectives)})(?![A-Za-z0-9_]))", -1)
    return F.filter(cut, lambda c: F.length(c) >= 3)
