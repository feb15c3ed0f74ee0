"""Means of clauses at a threshold, in any order of the rows."""

from __future__ import annotations

from colloquy.operators.sentiment import aspect_sentiment, overall_sentiment


def test_a_mean_on_the_threshold_is_charged_in_any_order(spark):
    """2.2 over 10 terms is 0.22, which sums of floating point numbers miss in some orders of the rows."""
    clauses = [(1, "a", 0.9, 4), (1, "a", -0.2, 1), (1, "a", 0.4, 1), (1, "a", -0.4, 4)]
    for order in (clauses, [clauses[0], clauses[3], *clauses[1:3]]):
        scored = spark.createDataFrame(order, "doc_id long, text string, score double, terms int").coalesce(1)
        rows = overall_sentiment(scored.where("true")).first()
        assert rows["score"] == 0.22 and aspect_sentiment(scored, {"x": "a"}).first()["polarity"] == "positive"
