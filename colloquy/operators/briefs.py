"""Texts for people: the summary of a meeting and the brief before the next one, from facts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["recommendations", "rendered", "summary", "throughput"]

MOST_SENTENCES = 6


def _first(rows: Column, keep) -> Column:
    return F.get(F.filter(rows, keep), F.lit(0))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def summary(analyses: DataFrame) -> DataFrame:
    """Adds summary: up to six sentences on who speaks, the main pain, contrasts, a rival, the best chance and
    money, an open objection and the next step, in this order.

    Columns: products array<struct<label,status>>, role, pains array<string>, aspects
    array<struct<aspect,polarity>>, rivals array<struct<label,active,threat>>, chances
    array<struct<label,probability>>, budget double, objections array<struct<label,resolved>>, next_steps
    array<string>. Null and empty arrays say nothing.
    """
    listed = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, ", "))
    used = listed(F.transform(F.filter("products", lambda p: p.status == "in_use"), lambda p: p.label))
    of = lambda polarity: listed(F.transform(F.filter("aspects", lambda a: a.polarity == polarity), lambda a: a.aspect))
    good, bad = of("positive"), of("negative")
    rival = _first(F.col("rivals"), lambda r: r.active)
    best = F.get(F.sort_array(F.transform("chances", lambda c: F.struct((-c.probability).alias("p"), c.label.alias("label")))), F.lit(0))
    money = F.when(F.col("budget") > 0, _text("A budget of R$ ", F.format_number("budget", 2), " was named."))
    chance = F.when(best.isNotNull(), _text("Chance to sell ", best.label, ": ", F.floor(-best.p * 100 + 0.5), "%."))
    objection = _first(F.col("objections"), lambda o: ~o.resolved)
    steps = F.coalesce(F.size("next_steps"), F.lit(0))
    who = F.array_compact(F.array(F.when(used.isNotNull(), _text("The client works with ", used, ".")), F.when(F.col("role").isNotNull(), _text("The speaker is ", F.col("role"), "."))))
    said = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, " "))
    more = F.size("pains") - 1
    lines = F.array_compact(
        F.array(
            said(who),
            F.when(F.size("pains") > 0, F.concat(_text("The main pain is ", F.get("pains", F.lit(0))), F.when(more > 0, _text(", with ", more, " more.")).otherwise("."))),
            F.when(good.isNotNull() & bad.isNotNull(), _text("Content with ", good, ", discontent with ", bad, ".")),
            F.when(rival.isNotNull(), _text(rival.label, " is in the race, threat ", rival.threat, ".")),
            said(F.array_compact(F.array(chance, money))),
            F.when(objection.isNotNull(), _text("The objection ", objection.label, " has no answer yet.")),
            F.when(steps > 0, _text("Next step: ", F.get("next_steps", F.lit(0)))).otherwise("No next step was agreed."),
        )
    )
    return analyses.withColumn("summary", F.array_join(F.slice(lines, 1, MOST_SENTENCES), " "))


def recommendations(customers: DataFrame) -> DataFrame:
    """customer_id, ordinal, advice, reason: what to do before the next meeting, the most pressing first.

    Columns: objections array<struct<category,text,mentions,resolved>>, decision_maker boolean, interests
    array<int>, late array<struct<task,days_late>> (ours), asks_return boolean, rivals
    array<struct<label,mentions,active>>, bant_missing array<string>, next_steps int (null without a meeting).
    """
    open_ = F.filter("objections", lambda o: ~F.coalesce(o.resolved, F.lit(False)))
    of = lambda c: _first(open_, lambda o: o.category == c)
    late = F.get(F.sort_array(F.transform(F.filter("late", lambda t: t.days_late > 0), lambda t: F.struct((-t.days_late).alias("d"), t.task.alias("task")))), F.lit(0))
    rival = _first(F.col("rivals"), lambda r: r.active)
    seen = F.coalesce(F.size("interests"), F.lit(0))
    last = F.when(seen > 0, F.get("interests", seen - 1))
    fall = F.when(seen > 1, F.get("interests", seen - 2) - last)
    absent = ~F.coalesce("decision_maker", F.lit(False))
    price = of("price")

    def advise(when: Column, advice: str, *reason: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(advice).alias("advice"), _text(*reason).alias("reason")))

    def told(o: Column) -> tuple[Column | str, ...]:
        return "open after ", o.mentions, " meetings: ", o.text

    authority, technical = of("authority"), of("technical")
    authority_open = F.coalesce(F.size(F.filter(open_, lambda o: o.category == "authority")), F.lit(0)) > 0
    rows = F.array_compact(
        F.array(
            F.coalesce(
                advise(authority_open, "settle who approves first", *told(authority)),
                advise(~authority_open & absent & (seen >= 2), "bring the decision maker", "no meeting of the cycle had one"),
            ),
            advise(late.isNotNull(), "deliver what is late before the call", late.task, ", ", -late.d, " days late"),
            advise(technical.isNotNull(), "show the integration live", *told(technical)),
            F.coalesce(
                advise(price.mentions >= 2, "speak about return, not price", *told(price)),
                advise(price.isNotNull(), "answer the price by scope", *told(price)),
            ),
            advise(F.col("asks_return"), "bring the return on investment with its calculation", "the history asks for it"),
            advise(rival.isNotNull(), "compare scope with the rival", rival.label, " in ", rival.mentions, " mentions"),
            advise(F.size("bant_missing") > 0, "close the gaps of the cycle", F.array_join("bant_missing", ", ")),
            advise(F.col("next_steps") == 0, "leave with a date", "the last meeting agreed on no next step"),
            advise(fall > 0, "ask what has changed", "interest fell by ", fall, " to ", last),
        )
    )
    listed = customers.select("customer_id", F.posexplode(rows).alias("k", "r"))
    return listed.select("customer_id", (F.col("k") + 1).alias("ordinal"), "r.advice", "r.reason")


def rendered(advice: DataFrame) -> DataFrame:
    """customer_id, text: recommendations as numbered lines."""
    line = _text(F.col("ordinal"), ". ", F.col("advice"), " (", F.col("reason"), ")")
    rows = advice.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x"))
    return rows.select("customer_id", F.array_join(F.transform("x", lambda r: r.line), "\n").alias("text"))


def throughput(items: Column, seconds: Column, planned: Column) -> Column:
    """Struct (per_minute, planned_seconds): the measured rate and how long ``planned`` items take at it."""
    rate = F.when(seconds > 0, items / seconds)
    return F.struct((rate * 60).alias("per_minute"), F.when(rate > 0, planned / rate).alias("planned_seconds"))
