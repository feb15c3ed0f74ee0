"""Memory of earlier meetings: the same as a loop, at a cost that follows the meetings."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from colloquy.operators.memory import before_each, memory_before, objections_before


def plain(rows):
    out = {}
    for c in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is not None, r[2], r[0]) if r[2] else (False, dt.date.min, r[0]))
        seen = []
        for k, r in enumerate(own):
            out[r[0]] = (k, len(seen), seen[-3:], seen[-1] if seen else None)
            seen += [] if r[3] is None else [r[3]]
    return out


def test_memory_is_what_a_loop_gives(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(400))
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), day(), None if rng.random() < 0.3 else rng.randrange(101)) for i in range(600)]
    df = spark.createDataFrame(rows, "meeting_id int, customer_id int, meeting_date date, interest_score int").withColumn("_row", F.lit("clash"))
    for period in ("month", "year"):
        got = {r["meeting_id"]: (r["prior_meetings"], r["prior_interest_count"], r["prior_interests"], r["prior_interest_last"]) for r in memory_before(df, period).collect()}
        assert got == plain(rows)
    assert memory_before(df.limit(0)).collect() == []


def test_objections_that_earlier_meetings_raised(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(300))) for i in range(120)]
    said = [(rng.randrange(120), rng.choice("abcd")) for _ in range(150)] + [(None, "a"), (999, "b")]
    frames = spark.createDataFrame(rows, "meeting_id int, customer_id int, meeting_date date"), spark.createDataFrame(said, "meeting_id int, label string")
    got = {r["meeting_id"]: (r["recurring"], r["unresolved"]) for r in objections_before(*frames).collect()}
    for i, c, d in rows:
        earlier = {(j, s) for j, s in said if j is not None and j < 120 and rows[j][1] == c and (rows[j][2], j) < (d, i)}
        times = [sum(s == x for _, s in earlier) for x in "abcd"]
        assert got[i] == (sum(t >= 1 for t in times), sum(t >= 2 for t in times))


def test_a_customer_with_very_many_meetings_costs_rows_not_squares(spark):
    def cost(n):
        df = spark.range(n).select(F.col("id").alias("meeting_id"), F.lit(1).alias("customer_id"), F.date_add(F.lit(dt.date(1950, 1, 1)), (F.col("id") % 20000).cast("int")).alias("meeting_date"), (F.col("id") % 101).cast("int").alias("interest_score"))
        began = time.perf_counter()
        rows = before_each(df, {"n": F.lit(1)}, "interest_score").agg(F.sum("n").alias("n"), F.max(F.size("last_values")).alias("w")).first()
        assert rows["n"] == n * (n - 1) // 2 and rows["w"] == 3
        return time.perf_counter() - began

    cost(1000)
    assert cost(100_000) < 60
