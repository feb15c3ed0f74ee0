"""Lexicons of phrases, found by looking words up instead of trying one expression an entry.

A phrase is written in words of folded text: ``preco alto`` is two words in a row, ``caro|salgado`` either
word, ``muito?`` an optional one, ``cancel*`` any word that begins so, ``~3`` up to three words or marks
between. Words stand next to each other where only white space divides them, and a mark such as ``-`` is a
word of its own.

Every word of a text is looked up once in the set of first words. Only where one is found do the next few
words travel, to a hash join with the phrases that begin so; the rest of a phrase is followed as a set of
places. So the cost follows the words and the hits, not the number of entries, and a lexicon can be a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import once, running_sums

__all__ = ["Phrase", "compiled", "lexicon_from", "pattern", "phrase_hits"]

#: A word, or a mark that is neither a letter, a digit nor white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
#: Variants of one entry, and words and marks that one may span, at most.
MOST_VARIANTS, MOST_WORDS = 256, 24


@dataclass(frozen=True)
class Phrase:
    """Words that stand for a label, with a weight and a group."""

    label: str
    words: str
    weight: float = 1.0
    group: str = ""

    @property
    def pattern(self) -> str:
        """The phrase as one regular expression."""
        return pattern(self.words)


def _variants(words: str) -> list[list[tuple[str, int]]]:
    """Every way to read a phrase: lists of (word, words that may be skipped before it)."""
    choices: list[list[tuple[str, int] | None]] = []
    gap = 0
    for item in words.split():
        if item.startswith("~"):
            gap += int(item[1:])
            continue
        optional = item.endswith("?") and len(item) > 1
        options = [w for w in (item[:-1] if optional else item).split("|") if w] or [item]
        choices.append([(w, gap) for w in options] + ([None] if optional else []))
        gap = 0
    if not choices or gap:
        raise ValueError(f"a phrase begins and ends with a word: {words!r}")
    out: dict[tuple, list[tuple[str, int]]] = {}
    for way in product(*choices):
        kept: list[tuple[str, int]] = []
        skipped = 0
        for own, item in zip((c[0][1] for c in choices), way, strict=True):
            if item is None:
                skipped += own
            else:
                kept.append((item[0], own + skipped))
                skipped = 0
        if not kept or kept[0][1] or sum(1 + g for _, g in kept) > MOST_WORDS:
            raise ValueError(f"a phrase begins with a word and spans {MOST_WORDS} words at most: {words!r}")
        out[tuple(kept)] = kept
    if len(out) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants: {words!r}")
    return list(out.values())


def compiled(phrases: Iterable[Phrase]) -> list[tuple[str, list[tuple[str, bool, int]], int, str, str, float]]:
    """Rows (key, rest, ordinal, label, grp, weight): the first word (``cancel*`` for a beginning) and what must follow: (word, is a beginning, gap)."""
    rows = []
    for ordinal, p in enumerate(phrases):
        for way in _variants(p.words):
            rest = [(w.removesuffix("*") if len(w) > 1 else w, w.endswith("*") and len(w) > 1, g) for w, g in way[1:]]
            rows.append((way[0][0], rest, ordinal, p.label, p.group, float(p.weight)))
    return rows


def lexicon_from(rows: DataFrame) -> list[Phrase]:
    """Phrases from a table (label, words, and where it has them weight and grp), in the order of label and words.

    A lexicon is read by people and bounded by what they write; it goes to every task.
    """
    known = [c for c in ("label", "words", "weight", "grp") if c in rows.columns]
    got = rows.where("label is not null and words is not null").select(*known).orderBy(*known).collect()
    rest = lambda r, c, none: none if c not in known or r[c] is None else r[c]
    return [Phrase(r["label"], r["words"], float(rest(r, "weight", 1.0)), rest(r, "grp", "")) for r in got]


_WORD, _MARK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\s]"


def pattern(words: str) -> str:
    """A phrase as one regular expression over folded text, for what needs it as such."""

    def word(w: str) -> str:
        return re.escape(w[:-1]) + _WORD + "*" if len(w) > 1 and w.endswith("*") else re.escape(w)

    def joint(a: str, b: str, gap: int) -> str:
        edge = rf"(?!{_WORD})" if a[-1].isalnum() else ""
        skip = rf"(?:\s*(?:{_WORD}+|{_MARK})){{0,{gap}}}?" if gap else ""
        glued = not a[-1].isalnum() and a[-1] != "*" or not b[0].isalnum()
        return edge + skip + (r"\s*" if glued else rf"(?:\s+|(?<={_MARK}))" if gap else r"\s+")

    ways = []
    for way in _variants(words):
        out = word(way[0][0])
        for (a, _), (b, gap) in zip(way[:-1], way[1:], strict=True):
            out += joint(a, b, gap) + word(b)
        ways.append(out)
    return "|".join(sorted(ways, key=len))


def _by_key(rows: list[tuple]) -> list[tuple[str, list[tuple]]]:
    """A row for each first word and each beginning, with all entries that a word found by it may begin: those
    of the word itself and of every beginning that it has."""
    own: dict[str, list[tuple]] = {}
    for key, *entry in rows:
        own.setdefault(key, []).append(tuple(entry))
    stems = [k for k in own if len(k) > 1 and k.endswith("*")]

    def all_of(key: str) -> list[tuple]:
        word = key[:-1] if key in stems else key
        shorter = [k for k in stems if k != key and word.startswith(k[:-1])]
        return sorted((e for k in [key, *shorter] for e in own[k]), key=lambda e: e[1])

    return [(key, all_of(key)) for key in own]


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    entry = "struct<rest:array<struct<word:string,stem:boolean,gap:int>>,ordinal:int,label:string,grp:string,weight:double>"
    return spark.createDataFrame(_by_key(rows), f"_p_key string, _p_entries array<{entry}>")


def _candidates(search: Column, firsts: set[str], stems: dict[int, set[str]], reach: int) -> Column:
    """Places at which a phrase may begin: array of (at, key, ahead), ahead being the next tokens. The key is the
    word itself, or else its longest known beginning."""

    def key(word: Column) -> Column:
        known = [F.when(word.isin(*sorted(firsts)), word)] if firsts else []
        begins = lambda n: F.when(F.substring(word, 1, n).isin(*sorted(stems[n])), F.concat(F.substring(word, 1, n), F.lit("*")))
        return F.coalesce(*known, *(begins(n) for n in sorted(stems, reverse=True)), F.lit(None).cast("string"))

    def of(tokens: Column) -> Column:
        places = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.at.alias("at"), key(t.word).alias("key"))), lambda p: p.key.isNotNull())
        return F.transform(places, lambda p: F.struct(p.at.alias("at"), p.key.alias("key"), F.slice(tokens, p.i + 1, F.lit(reach)).alias("ahead")))

    def tokens(words: Column) -> Column:
        gaps = F.split(search, TOKEN, -1)
        sizes = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
        pairs = F.zip_with(gaps, words, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("word")))
        placed = F.zip_with(pairs, running_sums(sizes), lambda p, at: F.struct((at + p.gap).alias("at"), p.word.alias("word")))
        return F.filter(placed, lambda t: t.word.isNotNull())

    words = F.regexp_extract_all(search, F.lit(TOKEN), F.lit(0))
    return F.when(F.exists(words, lambda w: key(w).isNotNull()), once(once(words, tokens), of))


def _ends(ahead: Column, rest: Column) -> Column:
    """How many tokens each way of following ``rest`` takes, as an array; empty if there is none."""

    def fits(token: Column, part: Column) -> Column:
        return F.when(part.stem, F.startswith(token.word, part.word)).otherwise(token.word == part.word)

    def follow(places: Column, part: Column) -> Column:
        def onward(p: Column) -> Column:
            window = F.slice(ahead, p + 1, part.gap + 1)
            hits = F.transform(window, lambda t, j: F.when(fits(t, part), p + j + 1))
            return F.array_compact(hits)

        return F.array_distinct(F.flatten(F.transform(places, onward)))

    return F.aggregate(rest, F.array(F.lit(1)), follow)


def phrase_hits(sentences: DataFrame, phrases: list[Phrase], text_col: str = "search", start_col: str = "start") -> DataFrame:
    """Every place at which an entry begins: the sentence's columns, ordinal, label, grp, weight, hit_start, hit_end.

    An entry that can be read in several ways from one place hits there once, with the nearest end. Offsets
    count from ``start_col``, or from the text's start if there is no such column. A null text has no hits.
    """
    kept = sentences.columns
    if clash := {"ordinal", "label", "grp", "weight", "hit_start", "hit_end"} & set(kept):
        raise ValueError(f"rename {sorted(clash)} first")
    rows = compiled(phrases)
    keys = {r[0] for r in rows}
    firsts = {k for k in keys if not (len(k) > 1 and k.endswith("*"))}
    stems: dict[int, set[str]] = {}
    for k in keys - firsts:
        stems.setdefault(len(k) - 1, set()).add(k[:-1])
    reach = max((1 + sum(1 + g for _, _, g in r[1]) for r in rows), default=1)
    at = F.col(start_col) if start_col in kept else F.lit(0)
    places = sentences.select("*", F.explode(_candidates(F.col(text_col), firsts, stems, reach)).alias("_p")).withColumn("_p_key", F.col("_p.key"))
    found = places.join(F.broadcast(_table(sentences.sparkSession, rows)), "_p_key")
    ahead = F.col("_p.ahead")

    def ends(e: Column) -> Column:
        last = F.get(ahead, F.array_min(_ends(ahead, e.rest)) - 1)
        return F.struct(e.ordinal.alias("ordinal"), (last.at + F.length(last.word)).alias("upto"), e.label.alias("label"), e.grp.alias("grp"), e.weight.alias("weight"))

    def nearest(hits: Column) -> Column:
        return F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1).ordinal != h.ordinal))

    # An entry that can be read in several ways has them side by side, the nearest end first.
    hits = once(F.array_sort(F.filter(F.transform("_p_entries", ends), lambda h: h.upto.isNotNull())), nearest)
    found = found.select(*kept, F.col("_p.at").alias("_p_at"), F.explode(hits).alias("_p_hit"))
    return found.select(*kept, "_p_hit.ordinal", "_p_hit.label", "_p_hit.grp", "_p_hit.weight", (at + F.col("_p_at")).alias("hit_start"), (at + F.col("_p_hit.upto")).alias("hit_end"))
