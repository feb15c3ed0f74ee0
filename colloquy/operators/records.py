"""Tables that change: re-analysed meetings, customers' portraits, corrections, corpora and queues.

Each function returns rows to write; doing so again from the written table changes nothing. ``appended``
adds rows to a table, ``overwritten`` replaces the partitions that the rows name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.memory import latest_analyses, mention_counts, strongest_stack

__all__ = [
    "appended", "memory_without_self", "new_corrections", "new_samples", "overwritten", "portraits", "reanalysed", "refused_correction", "triage_queue", "triage_records",
]

# What a correction does, the longest name of a field, the trust of a customer without meetings,
# and the least length of a text that is judged.
ACTIONS = ("add", "edit", "remove", "confirm")
FIELD_CHARS = 60
TRUST = 50
LEAST_CHARS = 2000


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to the table at ``path``, which may not exist yet."""
    rows.write.mode("append").parquet(path)


def overwritten(rows: DataFrame, path: str, column: str) -> None:
    """Writes a table partitioned by ``column``; partitions that ``rows`` doesn't name stay as they are."""
    rows.write.partitionBy(column).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def memory_without_self(meetings: DataFrame, value: str) -> DataFrame:
    """``meetings`` with others (how many) and others_sum of ``value`` in the customer's other meetings up to
    the same day. A meeting without customer or date remembers nothing and is in no memory.

    Meetings are summed by day first, so the window of a customer holds days, however many meetings it has.
    """
    key = ["customer_id", "meeting_date"]
    days = meetings.where("customer_id is not null and meeting_date is not null").groupBy(*key).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    so_far = Window.partitionBy("customer_id").orderBy("meeting_date").rowsBetween(Window.unboundedPreceding, 0)
    known = days.select(*key, F.sum("n").over(so_far).alias("known"), F.sum("s").over(so_far).alias("known_sum"))
    found = F.col("known").isNotNull()
    others = F.when(found, F.col("known") - F.col(value).isNotNull().cast("long")).otherwise(0)
    others_sum = F.when(found, F.coalesce("known_sum", F.lit(0)) - F.coalesce(value, F.lit(0))).otherwise(0)
    return meetings.join(known, key, "left").withColumn("others", others).withColumn("others_sum", others_sum).drop("known", "known_sum")


def reanalysed(derived: DataFrame, again: DataFrame, fresh: DataFrame, key: str = "meeting_id") -> DataFrame:
    """``derived`` without the rows of meetings in ``again``, and their ``fresh`` rows.

    A meeting without fresh rows loses its rows; null keys in ``again`` name nothing.
    """
    return derived.join(again.select(key).distinct(), key, "left_anti").unionByName(fresh)


def portraits(customers: DataFrame, meetings: DataFrame, products: DataFrame, objections: DataFrame, opportunities: DataFrame) -> DataFrame:
    """customer_id, health, stack ("product: status"), open_objections (keys), trust_level, upsell_potential.

    Lists are sorted and empty where there is nothing. Trust is that of the latest meeting that has one, else
    50. Upsell is the sum of value by chance over the latest meeting's opportunities, one without a value
    counting the latest budget; rounded, null unless it is positive. Money is added in decimals, each product
    to six places, so that no order of rows moves a half over the rounding. Facts are aggregated before they
    are joined, so a customer meets at most one row of each.
    """
    money = lambda c: c.cast("decimal(28,6)")
    stack = strongest_stack(products).groupBy("customer_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "product", "status"))).alias("stack"))
    still = mention_counts(objections, F.col("text")).where("not last_resolved")
    still = still.groupBy("customer_id").agg(F.sort_array(F.collect_list("key")).alias("open_objections"))
    at = F.struct("meeting_date", "meeting_id")
    latest = meetings.groupBy("customer_id").agg(
        F.max_by("meeting_id", at).alias("meeting_id"),
        F.max_by("trust_score", F.when(F.col("trust_score").isNotNull(), at)).alias("trust"),
        F.max_by("budget", F.when(F.col("budget").isNotNull(), at)).alias("latest_budget"),
    )
    offered = opportunities.groupBy("customer_id", "meeting_id").agg(
        F.coalesce(F.sum(money(F.col("value") * F.col("probability"))), money(F.lit(0))).alias("priced"),
        F.coalesce(F.sum(money(F.when(F.col("value").isNull(), F.col("probability")))), money(F.lit(0))).alias("unpriced"),
    )
    budgeted = money(F.col("unpriced").cast("double") * F.coalesce("latest_budget", F.lit(0.0)))
    upsell = F.floor(F.col("priced") + budgeted + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    latest = latest.join(offered, ["customer_id", "meeting_id"], "left").select("customer_id", "trust", upsell.alias("upsell"))
    rows = customers.select("customer_id", "health")
    for facts in (stack, still, latest):
        rows = rows.join(facts, "customer_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "customer_id",
        "health",
        F.coalesce("stack", none).alias("stack"),
        F.coalesce("open_objections", none).alias("open_objections"),
        F.coalesce("trust", F.lit(TRUST)).alias("trust_level"),
        F.when(F.col("upsell") > 0, F.col("upsell")).alias("upsell_potential"),
    )


def refused_correction() -> Column:
    """Why a correction (analysis_id, field, action) can't be logged; null if it can."""
    size = F.length(F.trim("field"))
    return (
        F.when(F.col("analysis_id").isNull(), "no analysis")
        .when(F.col("field").isNull() | ~size.between(1, FIELD_CHARS), "field")
        .when(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS), "action")
    )


def new_corrections(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of ``batch`` (analysis_id, user_id, created_at, field, action, before_value, after_value) to be
    appended to ``log``: those that are valid, under a correction_key of all their values, each once."""
    own = ("analysis_id", "user_id", "created_at", "field", "action", "before_value", "after_value")
    valid = batch.where(refused_correction().isNull()).select(*(F.trim("field").alias("field") if c == "field" else F.col(c) for c in own))
    keyed = valid.distinct().withColumn("correction_key", F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256))
    return keyed.join(log.select("correction_key").distinct(), "correction_key", "left_anti").select("correction_key", *own)


def new_samples(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """The samples (title, date, customer, sample_id, ..) that aren't in ``known`` by title, oldest first.

    Of a title, the first by (date, sample_id) is taken. A sample without customer would belong to nobody
    and is left out, as is one without title.
    """
    named = corpus.where((F.trim("customer") != "") & F.col("title").isNotNull())
    rest = [c for c in corpus.columns if c != "title"]
    first = named.groupBy("title").agg(F.min_by(F.struct(*rest), F.struct(F.col("date").isNull(), "date", "sample_id")).alias("s"))
    new = first.join(known.select("title").distinct(), "title", "left_anti")
    return new.select("title", *(F.col(f"s.{c}").alias(c) for c in rest)).orderBy(F.asc_nulls_last("date"), "sample_id")


def triage_records(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """Records of JSON lines, a trailing comma allowed. Blank and broken lines give none."""
    parsed = F.try_parse_json(F.regexp_replace(F.trim(line), ",$", ""))
    text = lines.where(parsed.isNotNull()).select(F.from_json(F.regexp_replace(F.trim(line), ",$", ""), schema).alias("r"))
    return text.where("r is not null").select("r.*")


def triage_queue(records: DataFrame, judged: DataFrame, *, kind: str = "customer", least: int = LEAST_CHARS) -> DataFrame:
    """The records (id, kind, text) still to be judged: of one kind, at least ``least`` characters long, with an
    id that ``judged`` doesn't have. A record without text is too short."""
    wanted = records.where((F.col("kind") == kind) & (F.length("text") >= least))
    return wanted.join(judged.select("id").distinct(), "id", "left_anti")
