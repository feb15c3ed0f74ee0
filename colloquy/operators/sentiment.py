"""Sentiment of clauses from a word lexicon, and of texts from their clauses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import once

__all__ = ["SentimentLexicon", "aspect_sentiment", "clause_scores", "overall_sentiment", "polarity", "span_score"]

TOKEN = r"[\p{L}\p{N}]+"
THRESHOLD = 0.22


@dataclass
class SentimentLexicon:
    """Scores of words, and factors of words that stand up to three tokens before them."""

    scores: dict[str, float]
    factors: dict[str, float] = field(default_factory=dict)
    greetings: str | None = None

    def _map(self, values: dict[str, float]) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def span_score(text: Column, lexicon: SentimentLexicon) -> Column:
    """Struct (score, terms) of a folded text: the mean over lexicon words of score times the factors
    (negators are -1) among the three tokens before, kept within -1 and 1; 0 without terms."""
    if lexicon.greetings:
        text = F.regexp_replace(text, lexicon.greetings, " ")
    scores, factors = lexicon._map(lexicon.scores), lexicon._map(lexicon.factors)

    def of(tokens: Column) -> Column:
        def term(token: Column, i: Column) -> Column:
            before = F.slice(tokens, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3)))
            factor = F.aggregate(before, F.lit(1.0), lambda acc, t: acc * F.coalesce(F.element_at(factors, t), F.lit(1.0)))
            base = F.element_at(scores, token)
            return F.when(base.isNotNull(), base * factor)

        return F.array_compact(F.transform(tokens, term))

    def mean(terms: Column) -> Column:
        total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
        score = F.when(F.size(terms) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.size(terms)))).otherwise(0.0)
        return F.struct(score.alias("score"), F.size(terms).alias("terms"))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return once(once(tokens, of), mean)


def polarity(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, "positive").when(score <= -threshold, "negative").otherwise("neutral")


def clause_scores(clauses: DataFrame, lexicon: SentimentLexicon, text_col: str = "text") -> DataFrame:
    """Adds score and terms to clauses; those without lexicon words go."""
    return clauses.withColumn("s", span_score(F.col(text_col), lexicon)).select("*", "s.score", "s.terms").drop("s").where("terms > 0")


def _mean() -> Column:
    """The mean score of a group's clauses by their terms, within -1 and 1. It is added in decimals and rounded to
    12 places, so that no order of rows moves it over a threshold."""
    total = F.sum((F.col("score") * F.col("terms")).cast("decimal(28,9)")).cast("double")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(total / F.sum("terms"), 12)))


def aspect_sentiment(scored: DataFrame, aspects: dict[str, str], keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per text and aspect (a pattern) with a charge: keys, aspect, score, polarity."""
    hits = F.array_compact(F.array(*(F.when(F.col(text_col).rlike(p), F.lit(a)) for a, p in aspects.items())))
    long = scored.select(*keys, "score", "terms", F.explode(hits).alias("aspect"))
    rows = long.groupBy(*keys, "aspect").agg(_mean().alias("score"))
    return rows.withColumn("polarity", polarity(F.col("score"))).where("polarity <> 'neutral'")


def overall_sentiment(scored: DataFrame, aspects: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, score, positive, negative, sentiment (positive, negative, neutral or mixed) of texts.

    Mixed needs a minority of a quarter of the charged clauses, and of two clauses unless there are at
    most six; or aspects of either polarity.
    """
    charged = lambda p: F.sum((polarity(F.col("score")) == p).cast("long"))
    rows = scored.groupBy(*keys).agg(
        _mean().alias("score"),
        charged("positive").alias("positive"),
        charged("negative").alias("negative"),
    )
    total, minor = F.col("positive") + F.col("negative"), F.least("positive", "negative")
    mixed = (minor * 4 >= total) & ((minor >= 2) | ((total <= 6) & (minor >= 1)))
    if aspects is not None:
        both = aspects.groupBy(*keys).agg((F.countDistinct("polarity") > 1).alias("opposed"))
        rows = rows.join(both, list(keys), "left")
        mixed = mixed | F.coalesce("opposed", F.lit(False))
    return rows.withColumn("sentiment", F.when(mixed, "mixed").otherwise(polarity(F.col("score")))).select(*keys, "score", "positive", "negative", "sentiment")
