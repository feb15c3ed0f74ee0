"""Scores that a person can check: every score is the sum of its factors, or a renormalised mean.

Inputs are rows with the columns named in each docstring; ``as_of`` replaces the clock everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "band", "bant", "business_value", "churn_band", "churn_risk", "health_score", "interest_factors", "interest_score", "quality_facts", "quality_index",
    "rounded", "series_drop", "trust_score", "with_abstention",
]

# What each fact adds to an interest score of 50.
INTEREST = {
    "asked_proposal": 12,
    "dated_commitment": 10,
    "decision_maker": 8,
    "asked_deadline": 7,
    "mentioned_expansion": 7,
    "stated_preference": 8,
    "has_budget": 6,
    "positive_sentiment": 5,
    "high_trust": 5,
    "open_price_objection": -8,
    "active_competitor": -10,
    "postponed": -6,
    "negative_sentiment": -8,
    "no_next_step": -7,
}
BASE_INTEREST = 50
WORDS_A_MINUTE = 140


def rounded(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def interest_factors(facts: dict[str, Column], churn_signals: Column) -> Column:
    """Array of (label, delta): the base, each fact that holds, churn signals (-15 each, at most -30) and
    the limit to 0..100 where it applies, so that deltas always add up to the score."""
    rows = [F.struct(F.lit("base").alias("label"), F.lit(BASE_INTEREST).alias("delta"))]
    rows += [F.when(facts[k], F.struct(F.lit(k).alias("label"), F.lit(v).alias("delta"))) for k, v in INTEREST.items() if k in facts]
    rows.append(F.when(churn_signals > 0, F.struct(F.lit("churn_signals").alias("label"), F.greatest(F.lit(-30), churn_signals * -15).cast("int").alias("delta"))))
    present = F.array_compact(F.array(*rows))
    total = F.aggregate(present, F.lit(0), lambda acc, f: acc + f.delta)
    limited = clamp(total).cast("int")
    limit = F.when(limited != total, F.array(F.struct(F.lit("limit").alias("label"), (limited - total).alias("delta"))))
    return F.concat(present, F.coalesce(limit, F.array().cast("array<struct<label:string,delta:int>>")))


def interest_score(factors: Column) -> Column:
    return F.aggregate(factors, F.lit(0), lambda acc, f: acc + f.delta)


def trust_score(deltas: Column, client_share: Column) -> Column:
    """50 plus the deltas of distinct signals, less 10 when the client speaks under a fifth of the words."""
    quiet = F.when(client_share < 0.2, -10).otherwise(0)
    return clamp(F.lit(50) + F.aggregate(deltas, F.lit(0), lambda acc, d: acc + d) + quiet).cast("int")


def series_drop(series: Column) -> Column:
    """How far the last of the last three values lies below the first of them, 0..100; null under two."""
    last = F.slice(series, F.greatest(F.lit(1), F.size(series) - 2), 3)
    return F.when(F.size(series) >= 2, clamp(F.get(last, F.lit(0)) - F.element_at(last, -1)))


def _weighted(parts: list[tuple[float, Column]]) -> Column:
    """The mean of the values that are not null, weights renormalised."""
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def churn_risk(signal_weight: Column, competitor_weight: Column, interests: Column, recurring: Column, unresolved: Column, overdue: Column) -> Column:
    """Risk 0..100 from this meeting's signals (.6), the interest's fall (.2), objections unresolved
    twice or more (.1) and overdue promises (.1); components without data drop out."""
    said = F.least(F.lit(100.0), F.least(F.lit(100.0), signal_weight * 1.5) + competitor_weight)
    return rounded(
        clamp(
            _weighted(
                [
                    (0.6, F.coalesce(said, F.lit(0.0))),
                    (0.2, series_drop(interests)),
                    (0.1, F.when(recurring > 0, clamp(unresolved * 35))),
                    (0.1, F.when(overdue > 0, clamp(overdue * 30))),
                ]
            )
        )
    ).cast("int")


def health_score(interests: Column, days_since_contact: Column, open_objections: Column, resolved: Column, kept: Column, overdue: Column, decision_maker: Column, has_history: Column) -> Column:
    """Account health 0..100: last interest .3, trend .15, recency .15, objections answered .15, promises
    kept .15, a decision maker in the cycle .1, renormalised; 50 without history."""
    last3 = F.slice(interests, F.greatest(F.lit(1), F.size(interests) - 2), 3)
    trend = F.when(F.size(interests) >= 2, clamp(50 + F.element_at(last3, -1) - F.get(last3, F.lit(0))))
    recency = F.when(days_since_contact <= 15, 100).when(days_since_contact >= 90, 0).otherwise(rounded(100 - (days_since_contact - 15) / 75 * 100))
    share = lambda part, whole: F.when(whole > 0, rounded(part / whole * 100))
    score = _weighted(
        [
            (0.3, F.when(F.size(interests) > 0, clamp(F.element_at(interests, -1)))),
            (0.15, trend),
            (0.15, F.when(days_since_contact.isNotNull(), recency)),
            (0.15, share(resolved, open_objections + resolved)),
            (0.15, share(kept, kept + overdue)),
            (0.1, F.when(decision_maker, 100).otherwise(25)),
        ]
    )
    return F.when(has_history, rounded(clamp(score))).otherwise(50).cast("int")


def band(score: Column) -> Column:
    """high from 67, medium from 34, else low; null stays null."""
    return F.when(score >= 67, "high").when(score >= 34, "medium").when(score.isNotNull(), "low")


churn_band = band


def bant(budget: Column, authority: Column, need: Column, timing: Column) -> Column:
    """Struct (score 0..4, missing): which of budget, authority, need and timing are known."""
    facts = {"budget": budget, "authority": authority, "need": need, "timing": timing}
    known = sum((F.coalesce(c, F.lit(False)).cast("int") for c in facts.values()), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in facts.items())))
    return F.struct(known.alias("score"), missing.alias("missing"))


def quality_index(words: Column, fillers: Column, inaudible: Column, sentences: Column, diarised: Column, speakers: Column, unknown_sides: Column) -> Column:
    """Reliability 0..100 of a transcript."""
    fragmented = diarised & (speakers > 6)
    ratio = F.when(sentences > 0, inaudible / sentences).otherwise(0.0)
    density = F.when(words > 0, fillers / words).otherwise(0.0)
    lost = (
        F.when(~diarised, 25).otherwise(0)
        + F.least(F.lit(30), rounded(ratio * 200))
        + F.when(words < 150, 15).otherwise(0)
        + F.when(density > 0.08, 10).otherwise(0)
        + F.when(diarised & (speakers < 2), 10).otherwise(0)
        + F.when(fragmented, F.least(F.lit(45), 15 + (speakers - 6) * 2)).when(diarised & (unknown_sides > 0), 8).otherwise(0)
    )
    return clamp(100 - lost).cast("int")


def quality_facts(tokens: Column, fillers: Column, inaudible: Column, sentences: Column, diarised: Column, speakers: Column, unknown_sides: Column, attributable: Column) -> Column:
    """Struct (minutes, diversity, density, warnings) of a transcript from its word tokens.

    Minutes of speech at 140 words each, distinct lower-cased words over all, fillers over all, and the
    names of what lowers :func:`quality_index` or keeps scores from being given. Null tokens are none.
    """
    words = F.coalesce(F.size(tokens), F.lit(0))
    share = lambda n: F.when(words > 0, n / words).otherwise(0.0)
    types = F.coalesce(F.size(F.array_distinct(F.transform(tokens, F.lower))), F.lit(0))
    fragmented = diarised & (speakers > 6)
    notes = {
        "no speakers": ~diarised,
        "inaudible": (sentences > 0) & (inaudible > 0),
        "short": words < 150,
        "fillers": share(fillers) > 0.08,
        "one speaker": diarised & (speakers < 2),
        "fragmented": fragmented,
        "unknown sides": diarised & ~fragmented & (unknown_sides > 0),
        "no scores": ~attributable,
    }
    warnings = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in notes.items())))
    return F.struct(F.round(words / 140, 1).alias("minutes"), F.round(share(types), 3).alias("diversity"), F.round(share(fillers), 3).alias("density"), warnings.alias("warnings"))


def with_abstention(scores: DataFrame, attributable: Column, columns: tuple[str, ...] = ("interest_score", "churn_risk")) -> DataFrame:
    """Scores are null where sides can't be told apart: not measured is not zero."""
    return scores.withColumns({c: F.when(attributable, F.col(c)) for c in columns if c in scores.columns})


def business_value(contract: Column, churn: Column, first_budget: Column, probabilities: Column) -> Column:
    """Struct (at_risk, opportunity): the contract when churn is high, and the budget times each chance."""
    at_risk = F.when(churn >= 67, contract)
    chance = F.aggregate(F.coalesce(probabilities, F.array().cast("array<double>")), F.lit(0.0), lambda acc, p: acc + p)
    return F.struct(at_risk.alias("at_risk"), (F.coalesce(first_budget, F.lit(0.0)) * chance).alias("opportunity"))
