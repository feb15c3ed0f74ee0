"""Customer memory: what earlier meetings say about a customer, meeting by meeting and as a portrait.

A meeting sees strictly earlier ones in the order (meeting_date, meeting_id). The order makes the
feedback of earlier scores into later ones a window, so all customers run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["bant_cycle", "before_each", "competitor_portrait", "customer_peaks", "latest_analyses", "mention_counts", "memory_before", "objections_before", "score_series", "strongest_stack", "task_status"]

# Product statuses, the strongest first.
STATUSES = ("em_uso", "em_avaliacao", "oportunidade", "mencionado")


def latest_analyses(analyses: DataFrame, key: str = "meeting_id", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The latest row of each key: a partial aggregate, so rows of a key need not meet sorted.

    Rows that agree in ``order`` are ordered by their other columns in turn, so exactly one is the latest
    whatever the order of the input; a null comes before every value.
    """
    rest = [c for c in analyses.columns if c != key]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("r")
    return analyses.groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def customer_peaks(meetings: DataFrame, powers: tuple[str, ...]) -> DataFrame:
    """customer_id, top_power, top_meeting, budget, budget_meeting: the persona of most power, the first that
    has it, and the latest budget that names an amount.

    ``powers`` goes from least to most; a power that isn't listed is below all, null is no persona.
    """
    at = F.struct("meeting_date", "meeting_id")
    rank = F.array_position(F.array(*map(F.lit, powers)), F.col("power"))
    level = meetings.where("power is not null").groupBy("customer_id", rank.alias("rank")).agg(F.min_by(F.struct("power", "meeting_id"), at).alias("p"))
    top = level.groupBy("customer_id").agg(F.max_by("p", "rank").alias("p"))
    latest = meetings.where("budget is not null").groupBy("customer_id").agg(F.max_by(F.struct("budget", "meeting_id"), at).alias("b"))
    rows = meetings.select("customer_id").distinct().join(top, "customer_id", "left").join(latest, "customer_id", "left")
    return rows.select("customer_id", F.col("p.power").alias("top_power"), F.col("p.meeting_id").alias("top_meeting"), F.col("b.budget").alias("budget"), F.col("b.meeting_id").alias("budget_meeting"))


#: Scores of earlier meetings that later ones use.
DEPTH = 3


def before_each(meetings: DataFrame, sums: dict[str, Column], last: str, period: str = "month") -> DataFrame:
    """Adds to each meeting what its customer's earlier ones come to: ``sums`` by name, and ``last``, an array of the
    last :data:`DEPTH` values of the column ``last`` that are not null, the oldest first, as ``last_values``.

    Meetings go by (meeting_date, meeting_id), a null date before all. A customer's meetings of one period are
    summed up first, the periods are carried on as one row each, and every meeting adds its own period's part: so
    the state that is carried has a fixed size, the work is linear, and a customer with very many meetings is as
    many tasks as periods.
    """
    own = "customer_id, _period"
    at = "meeting_date, meeting_id"
    rows = meetings.withColumn("_period", F.coalesce(F.trunc("meeting_date", period), F.lit("0001-01-01").cast("date")))
    rows = rows.withColumns({f"_add_{k}": c.cast("long") for k, c in sums.items()}).withColumn("_last", F.col(last))
    window = Window.partitionBy("customer_id", "_period").orderBy("meeting_date", "meeting_id")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    lags = [F.expr(f"lag(_last, {k}) IGNORE NULLS OVER (PARTITION BY {own} ORDER BY {at})") for k in range(1, DEPTH + 1)]
    rows = rows.withColumn("_lags", F.array_compact(F.array(*lags)))
    rows = rows.withColumns({f"_sum_{k}": F.coalesce(F.sum(f"_add_{k}").over(earlier), F.lit(0)) for k in sums})
    with_own = F.slice(F.array_compact(F.concat(F.array("_last"), F.col("_lags"))), 1, DEPTH)
    periods = rows.groupBy("customer_id", "_period").agg(
        *(F.sum(f"_add_{k}").alias(f"_all_{k}") for k in sums), F.max_by(with_own, F.struct(F.col("meeting_date").isNotNull(), "meeting_date", "meeting_id")).alias("_state")
    )
    periods = periods.withColumn("_state", F.when(F.size("_state") > 0, F.col("_state")))
    carried = [F.expr(f"lag(_state, {k}) IGNORE NULLS OVER (PARTITION BY customer_id ORDER BY _period)") for k in range(1, DEPTH + 1)]
    past = Window.partitionBy("customer_id").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    periods = periods.select(
        "customer_id", "_period", F.flatten(F.array_compact(F.array(*carried))).alias("_carried"), *(F.coalesce(F.sum(f"_all_{k}").over(past), F.lit(0)).alias(f"_past_{k}") for k in sums)
    )
    both = rows.withColumnRenamed("customer_id", "_customer").join(periods, F.col("_customer").eqNullSafe(F.col("customer_id")) & (rows["_period"] == periods["_period"]))
    last_values = F.reverse(F.slice(F.concat("_lags", "_carried"), 1, DEPTH))
    return both.select(*(F.col("_customer").alias(c) if c == "customer_id" else F.col(c) for c in meetings.columns), *((F.col(f"_sum_{k}") + F.col(f"_past_{k}")).alias(k) for k in sums), last_values.alias("last_values"))


def memory_before(meetings: DataFrame, period: str = "month") -> DataFrame:
    """Adds what each meeting remembers: prior_meetings, prior_interest_count, prior_interests (the last three that
    aren't abstentions, the oldest first), prior_interest_last, and has_memory (a prior interest exists)."""
    rows = before_each(meetings, {"prior_meetings": F.lit(1), "prior_interest_count": F.col("interest_score").isNotNull().cast("int")}, "interest_score", period)
    rows = rows.withColumnRenamed("last_values", "prior_interests").withColumn("has_memory", F.size("prior_interests") > 0)
    return rows.withColumn("prior_interest_last", F.when(F.col("has_memory"), F.element_at("prior_interests", -1)))


def objections_before(meetings: DataFrame, objections: DataFrame, period: str = "month") -> DataFrame:
    """Adds recurring (labels that earlier meetings of the customer raised) and unresolved (those that two or more did).

    ``objections`` has meeting_id and label. Of each label the first and the second meeting are all that counts.
    """
    at = F.struct("meeting_date", "meeting_id")
    raised = objections.select("meeting_id", "label").distinct().join(meetings.select("meeting_id", "customer_id", "meeting_date"), "meeting_id")
    firsts = raised.groupBy("customer_id", "label").agg(F.min(at).alias("first"))
    same = (F.col("customer_id") == F.col("c")) & (F.col("label") == F.col("l"))
    later = raised.join(firsts.select(F.col("customer_id").alias("c"), F.col("label").alias("l"), "first"), same).where(at > F.col("first"))
    seconds = later.groupBy("customer_id", "label").agg(F.min(at).alias("second"))
    events = firsts.select(F.col("first.meeting_id").alias("e"), F.lit(1).alias("_first"), F.lit(0).alias("_second")).unionAll(seconds.select("second.meeting_id", F.lit(0), F.lit(1)))
    events = events.groupBy("e").agg(F.sum("_first").alias("_first"), F.sum("_second").alias("_second"))
    rows = meetings.join(events, F.col("meeting_id") == F.col("e"), "left").drop("e").fillna(0, ["_first", "_second"])
    rows = before_each(rows, {"recurring": F.col("_first"), "unresolved": F.col("_second")}, "_first", period)
    return rows.drop("_first", "_second", "last_values")


def mention_counts(mentions: DataFrame, key: Column) -> DataFrame:
    """customer_id, key, meetings, first_text, last_text, last_resolved of needs or objections.

    A key counts once for each meeting; the text is the first mention's, resolution the latest's.
    ``mentions`` has customer_id, meeting_id, meeting_date, ordinal, text, resolved.
    """
    at = F.struct("meeting_date", "meeting_id", "ordinal", "text", "resolved")
    return (
        mentions.withColumn("key", key)
        .groupBy("customer_id", "key")
        .agg(
            F.countDistinct("meeting_id").alias("meetings"),
            F.min_by("text", at).alias("first_text"),
            F.max_by("text", at).alias("last_text"),
            F.max_by("resolved", at).alias("last_resolved"),
        )
    )


def strongest_stack(products: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """customer_id, product, status: the strongest status a product ever had with the customer."""
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    known = products.withColumn("rank", F.when(rank > 0, rank)).where("rank is not null")
    return known.groupBy("customer_id", "product").agg(F.min_by("status", "rank").alias("status"))


def competitor_portrait(competitors: DataFrame) -> DataFrame:
    """customer_id, competitor, mentions (each counts), active (ever)."""
    return competitors.groupBy("customer_id", "competitor").agg(F.count("*").alias("mentions"), F.bool_or("active").alias("active"))


def task_status(tasks: DataFrame, as_of: Column) -> DataFrame:
    """customer_id, open, overdue, done, most_days_late; overdue is relative to ``as_of``."""
    late = ~F.col("done") & (F.col("due_date") < as_of)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return tasks.groupBy("customer_id").agg(
        count(~F.col("done")).alias("open"),
        count(late).alias("overdue"),
        count(F.col("done")).alias("done"),
        F.max(F.when(late, F.datediff(as_of, F.col("due_date")))).alias("most_days_late"),
    )


def score_series(meetings: DataFrame) -> DataFrame:
    """customer_id, interests, trusts by date; abstained interests are left out, trust is kept."""
    at = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("meeting_date", "meeting_id", F.col(c).alias("v")))))
    rows = meetings.groupBy("customer_id").agg(at("interest_score").alias("i"), at("trust_score").alias("t"))
    return rows.select("customer_id", F.transform("i", lambda x: x.v).alias("interests"), F.transform("t", lambda x: x.v).alias("trusts"))


def bant_cycle(meetings: DataFrame) -> DataFrame:
    """customer_id and budget, authority, need, timing: known in any meeting of the cycle; score."""
    facts = ("budget", "authority", "need", "timing")
    rows = meetings.groupBy("customer_id").agg(*(F.bool_or(c).alias(c) for c in facts))
    return rows.withColumn("score", sum((F.col(c).cast("int") for c in facts), F.lit(0)))
