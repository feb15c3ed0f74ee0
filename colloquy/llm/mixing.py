"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed

__all__ = ["mix_plan", "mixed_documents", "source_targets"]

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
REPEATS = 2
#: Slices of the shuffle order and of the virtual time, each summed before the exact running sums.
SLICES = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """Columns source, source_size, source_no, target from one row (source, source_size) per source.

    Sources by code point, null last, take ``weights`` in turn. They share ``budget_percent`` of all
    words by weight; no target is above ``repeats`` times its source's size, and what is over goes to
    the others by weight. The table has a row per source, so its ranking is one small task.
    """
    one = F.lit(1)
    ranked = sizes.withColumn("source_no", F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(one)
    budget = F.sum("source_size").over(everything) * (budget_percent / 100)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("weight"))
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)
    full = F.col("water").isNull() | (F.struct("ratio", "source_no") < F.struct(F.col("water.ratio"), F.col("water.source_no")))
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("water.level") * F.col("weight"))
    return leveled.withColumn("water", water).withColumn("target", target).select("source", "source_size", "source_no", "target")


def _running(part: list[str], order: list[str]) -> Column:
    return F.sum("size").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """128 bits of a row's id, source and text, each of which may be null."""
    parts = [F.col(id_col).cast("long").cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string")]
    return F.md5(F.concat_ws(":", *(F.concat(F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts)).cast("binary"))


def _queue(
    documents: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], budget_percent: int, repeats: int, seed: str, distinct: bool = False
) -> tuple[DataFrame, Column, float]:
    """Documents with the finish time of their first copy, the test that a copy is taken, the budget.

    ``distinct``: rows that repeat id, source and text are one document, with a row_key.
    """
    text = F.col(text_col).cast("string")
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (_row_key(id_col, text_col, source_col) if distinct else F.lit(None).cast("string")).alias("row_key"),
    )
    if distinct:
        docs = docs.distinct()
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    docs = checkpointed(docs.withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    sources = checkpointed(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_percent, repeats))
    rows = docs.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("slice", F.shiftright("key", 44))
    # A hot source is cut along the shuffle order: slices are summed first, then each has its own window.
    slices = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("size"))
    slices = slices.withColumn("before", _running(["source_no"], ["slice"]) - F.col("size")).drop("size")
    rows = rows.join(slices, ["source_no", "slice"]).withColumn("cum", F.col("before") + _running(["source_no", "slice"], ["key", "doc_id", "size"]))
    rows = checkpointed(rows.select("doc_id", "row_key", "source_no", "size", "source_size", "target", "key", "cum"))
    copies = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")).withColumn("finish", finish(F.col("copy")))
    copies = copies.withColumn("slice", F.least(F.floor(F.col("finish") * SLICES), F.lit(4 * SLICES)))
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    times = copies.groupBy("slice").agg(F.sum("size").alias("size")).withColumn("sum", _running([], ["slice"]))
    crossing = times.where(F.col("sum") > budget).orderBy("slice").limit(1).first()
    if crossing is None:
        return rows, lambda copy: F.col("size") > 0, budget
    place = ["finish", "source_no", "copy", "key", "doc_id", "size"]
    inside = copies.where(F.col("slice") == crossing["slice"]).withColumn("sum", _running(["slice"], place) + (crossing["sum"] - crossing["size"]))
    last = inside.where(F.col("sum") <= budget).orderBy(*[F.desc(c) for c in place]).select(*place).first()
    if last is None:
        edge = F.lit(crossing["slice"] / SLICES)
        return rows, lambda copy: (F.col("size") > 0) & (finish(copy) < edge), budget
    kinds = dict(copies.dtypes)
    cut = F.struct(*(F.lit(last[c]).cast(kinds[c]).alias(c) for c in place))

    def taken(copy: Column) -> Column:
        mine = {"finish": finish(copy), "copy": copy.cast(kinds["copy"])}
        return (F.col("size") > 0) & (F.struct(*(mine.get(c, F.col(c)).alias(c) for c in place)) <= cut)

    return rows, taken, budget


def finish(copy: Column) -> Column:
    """Virtual finish time: words of the source up to and with this copy, over the source's target."""
    return (copy * F.col("source_size") + F.col("cum")) / F.col("target")


def mix_plan(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies.

    ``size`` is the number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0), ``target`` its source's (see
    :func:`source_targets`). Documents of a source queue in the order of a keyed digest of their id, as
    often as ``repeats``; a copy's virtual finish time is its source's words so far over its target. All
    copies, in the order of finish time, are taken while their words stay within the budget; ``taken`` is
    size times ``copies``. Equal times are ordered by source, copy, digest, id and size, so reruns agree.

    A null source is a source of its own, after the others; a null id counts as empty in the digest.
    Wordless texts take nothing. Rows repeating an id queue one after another. Other columns are not read.
    """
    rows, taken, _ = _queue(documents, id_col, text_col, source_col, weights, budget_percent, repeats, seed)
    copies = sum((taken(F.lit(k)).cast("long") for k in range(repeats)), F.lit(0).cast("long"))
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: rows of ``documents`` with mix_copy and mix_finish, range-sorted by finish time.

    Rows that repeat id, source and text are one document, in the plan as in the result; it comes once for
    each copy that the plan takes, so the words planned are the words delivered.
    """
    rows, taken, _ = _queue(documents, id_col, text_col, source_col, weights, budget_percent, repeats, seed, distinct=True)
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("mix_copy"))
    copies = copies.where(taken(F.col("mix_copy"))).select(F.col("row_key").alias("mix_key"), "mix_copy", finish(F.col("mix_copy")).alias("mix_finish"))
    # Copies of a row meet once a task; one shuffle by the key serves both the distinct rows and the join.
    keyed = documents.withColumn("mix_key", _row_key(id_col, text_col, source_col)).dropDuplicates(["mix_key"])
    return keyed.join(copies, "mix_key").select(*documents.columns, "mix_copy", "mix_finish").orderBy("mix_finish", id_col, "mix_copy")
