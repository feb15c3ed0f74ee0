"""Measures of an analysis against annotated gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["accuracy", "band_error", "binary_scores", "confusion", "corpus_coverage", "false_positives", "holdout_gap", "nearest_rank", "role_accuracy", "set_scores"]


def _scores(hit: Column, extra: Column, missed: Column) -> list[Column]:
    """Precision, recall and F1; an empty denominator is 1."""
    safe = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    p, r = safe(hit, hit + extra), safe(hit, hit + missed)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1")]


def corpus_coverage(samples: DataFrame, price: str, units: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts of annotated samples: total, dev, holdout, with_rival, with_price, with_churn,
    with_upsell, with_budget, without_signal, one count for each of ``units``, scenarios.

    ``samples`` has part, rivals, objections and units (arrays), churn and upsell (booleans), budget and
    scenario; null arrays count as empty, null booleans as false.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c, name: F.count_if(true(c)).alias(name)
    rival, objection = true(F.size("rivals") > 0), true(F.size("objections") > 0)
    said = rival | objection | true(F.col("churn")) | true(F.col("upsell")) | F.col("budget").isNotNull()
    return samples.agg(
        F.count("*").alias("total"),
        count(F.col("part") == "dev", "dev"),
        count(F.col("part") == "holdout", "holdout"),
        count(rival, "with_rival"),
        count(F.array_contains("objections", price), "with_price"),
        count(F.col("churn"), "with_churn"),
        count(F.col("upsell"), "with_upsell"),
        count(F.col("budget").isNotNull(), "with_budget"),
        count(~said, "without_signal"),
        *(count(F.array_contains("units", u), f"unit_{u}") for u in units),
        F.countDistinct("scenario").alias("scenarios"),
    )


def set_scores(gold: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("field",)) -> DataFrame:
    """keys, hits, extra, missed, precision, recall, f1 of items (keys, sample, item), each counted once."""
    columns = [*keys, "sample", "item"]
    both = gold.select(*columns).distinct().withColumn("g", F.lit(1)).join(found.select(*columns).distinct().withColumn("f", F.lit(1)), columns, "full")
    count = lambda g, f: F.sum(F.when((F.col("g").isNotNull() == g) & (F.col("f").isNotNull() == f), 1).otherwise(0))
    sums = both.groupBy(*keys).agg(count(True, True).alias("hits"), count(False, True).alias("extra"), count(True, False).alias("missed"))
    return sums.select(*keys, "hits", "extra", "missed", *_scores(F.col("hits"), F.col("extra"), F.col("missed")))


def binary_scores(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, hits, extra, missed, precision, recall, f1 of booleans gold and found."""
    count = lambda g, f: F.coalesce(F.sum(((F.col("gold") == g) & (F.col("found") == f)).cast("long")), F.lit(0))
    sums = pairs.groupBy(*keys).agg(count(True, True).alias("hits"), count(False, True).alias("extra"), count(True, False).alias("missed"))
    return sums.select(*keys, "hits", "extra", "missed", *_scores(F.col("hits"), F.col("extra"), F.col("missed")))


def accuracy(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, judged, right, accuracy; rows with a null found value abstained and are not judged."""
    sums = pairs.where("found is not null").groupBy(*keys).agg(F.count("*").alias("judged"), F.sum((F.col("found") == F.col("gold")).cast("long")).alias("right"))
    return sums.withColumn("accuracy", F.col("right") / F.col("judged"))


def band_error(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, judged, mae: mean distance of a score from the middle of its gold range low..high."""
    off = F.abs(F.col("score") - (F.col("low") + F.col("high")) / 2)
    return rows.where("score is not null").groupBy(*keys).agg(F.count("*").alias("judged"), F.avg(off).alias("mae"))


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row per gold label with the count of each found label."""
    return pairs.groupBy("gold").pivot("found", list(labels)).agg(F.count(F.lit(1))).fillna(0)


def false_positives(found: DataFrame, quiet: DataFrame) -> DataFrame:
    """field, false_positives: items found in samples that hold no signal."""
    return found.join(quiet.select("sample").distinct(), "sample", "left_semi").groupBy("field").agg(F.count("*").alias("false_positives"))


def nearest_rank(values: DataFrame, percents: tuple[int, ...] = (50, 95), keys: tuple[str, ...] = (), column: str = "value") -> DataFrame:
    """keys, percent, value: the value at index min(n-1, floor(percent * n / 100)) in order.

    Values are counted first and ranked by running sums, so no group is gathered in an array.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("c"))
    group = list(keys) or [F.lit(1)]
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    wanted = ranked.select("*", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    index = F.least(F.col("n") - 1, F.floor(F.col("percent") * F.col("n") / 100))
    return wanted.where(F.col("upto") > index).groupBy(*keys, "percent").agg(F.min("value").alias("value"))


def role_accuracy(roles: DataFrame) -> DataFrame:
    """One row over speakers (sample, gold, found, decided): judged, right, first_right, inverted.

    ``first_right`` is what calling each sample's first speaker the seller would get right; a sample is
    inverted when it has decided speakers and all of them are wrong.
    """
    right = F.col("found") == F.col("gold")
    samples = roles.groupBy("sample").agg(
        F.count("*").alias("judged"),
        F.sum(right.cast("long")).alias("right"),
        F.sum(F.when(F.col("position") == 0, F.col("gold") == "seller").otherwise(F.col("gold") != "seller").cast("long")).alias("first_right"),
        F.coalesce(F.bool_and(F.when(F.col("decided"), ~right)), F.lit(False)).alias("inverted"),
    )
    return samples.agg(F.sum("judged").alias("judged"), F.sum("right").alias("right"), F.sum("first_right").alias("first_right"), F.sum(F.col("inverted").cast("long")).alias("inverted"))


def holdout_gap(scores: DataFrame, suspect: float = 0.15) -> DataFrame:
    """field, dev, holdout, gap, suspect from rows (field, part, f1)."""
    rows = scores.groupBy("field").agg(F.avg(F.when(F.col("part") == "dev", F.col("f1"))).alias("dev"), F.avg(F.when(F.col("part") == "holdout", F.col("f1"))).alias("holdout"))
    gap = F.abs(F.col("dev") - F.col("holdout"))
    return rows.withColumn("gap", gap).withColumn("suspect", gap > suspect)
