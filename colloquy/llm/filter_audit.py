"""How filters that run one after another interact, in every order.

A filter's effect depends on which filters ran before it, not on their order, so every run is a path
through the lattice of subsets of the filters. Documents are counted once for each edge of the lattice (the
filters already applied, the next one), n * 2^(n-1) of them; the n! orders of n steps each are then paths
over the counted edges. Which filters a document fails is aggregated first, so a part never holds more than
2^n kinds of documents times the outcomes, however many documents it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

__all__ = ["lattice_edges", "order_steps", "repeats_smaller_id", "text_filters"]

WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: str | Column) -> dict[str, Column]:
    """Four filters on a text alone, true where it fails: short, repetitive, shouting, symbols."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats_smaller_id(kinds: DataFrame, digest: str, first: str, n: str, n_first: str) -> DataFrame:
    """Splits counted kinds of documents into those that repeat a text of a smaller id and those that don't.

    ``kinds`` has a row for each digest and kind: the least id ``first``, how many rows ``n`` and how many of
    them have that least id or none (``n_first``). Only the rows of the least id of all of a digest's kinds,
    and rows without an id, repeat nothing. Adds ``repeats`` and sets ``n``.
    """
    least = F.min(first).over(Window.partitionBy(digest))
    fresh = F.when(F.col(first) == least, F.col(n_first)).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("repeats"), fresh.alias("rows")), F.struct(F.lit(True).alias("repeats"), (F.col(n) - fresh).alias("rows")))
    rest = [c for c in kinds.columns if c != n]
    split = kinds.withColumn("both", both).select(*rest, F.inline("both"))
    return split.where("rows > 0").withColumnRenamed("rows", n)


def lattice_edges(kinds: DataFrame, filters: Sequence[str], *, part: str, n: str, outcomes: Mapping[str, str] | None = None) -> DataFrame:
    """Counts of each edge: ``part``, applied (bits of the filters before), filter, kept, removed, redundant, unique_fails.

    ``kinds`` has booleans named as the filters (true: fails), the part and the number ``n`` of documents;
    ``outcomes`` names further counts, each of removed documents for which a boolean column holds. Every part
    has all edges, with zeros.
    """
    outcomes = outcomes or {}
    bit = {f: 1 << i for i, f in enumerate(filters)}
    mask = sum((F.when(F.col(f), bit[f]).otherwise(0) for f in filters), F.lit(0))
    few = kinds.groupBy(F.col(part), mask.alias("mask"), *(F.col(c) for c in outcomes.values())).agg(F.sum(n).alias("docs"))
    edges = [(s, f, bit[f]) for f in filters for s in range(1 << len(filters)) if not s & bit[f]]
    table = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(b).alias("bit")) for s, f, b in edges))
    rows = few.select("*", F.inline(table))
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def docs(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("docs")).otherwise(0)).cast("long")

    return rows.groupBy(part, "applied", "filter").agg(
        docs(~before & ~fails).alias("kept"),
        docs(~before & fails).alias("removed"),
        docs(before & fails).alias("redundant"),
        docs(F.col("mask") == F.col("bit")).alias("unique_fails"),
        *(docs(~before & fails & F.col(c)).alias(name) for name, c in outcomes.items()),
    )


def order_steps(edges: DataFrame, filters: Sequence[str], *, part: str) -> DataFrame:
    """Every order of the filters as a path over ``edges``: filter_order, step, the edge's counts, shapley.

    ``shapley`` is what a filter removes in all orders together. The table of steps has n * n! rows, fixed
    by the number of filters, and goes to every task.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(p), k + 1, sum(bit[f] for f in p[:k]), f) for p in permutations(filters) for k, f in enumerate(p)]
    spark = edges.sparkSession
    table = spark.createDataFrame(steps, "filter_order string, step int, applied int, filter string")
    paths = edges.join(F.broadcast(table), ["applied", "filter"])
    alike = Window.partitionBy(part, "filter")
    return paths.withColumn("shapley", F.sum("removed").over(alike)).drop("applied")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Kinds of documents for :func:`lattice_edges`: part, A to E, good, toxic, n.

    A null text is empty, a null language the part "". Filter E fails a text that a smaller id has too; a
    null id is neither smaller nor larger than another. Labels of one id are taken together: one of them
    that says so is enough. Rows that repeat count each. Texts are read once and leave their task as a
    digest; copies in one task become one row before anything is shuffled, so a large group of copies
    meets as a row for each task, not as its documents.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = rows.select("id", "part", F.sha2("body", 256).alias("digest"), *(c.alias(k) for k, c in text_filters("body").items()))
    rows = rows.groupBy("id", "part", "digest", "A", "B", "C", "D").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, "id", "left").fillna(False, ["good", "toxic"])
    unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    at_first = F.coalesce(F.min_by("n", "id"), F.lit(0))
    kinds = rows.groupBy("digest", "part", "A", "B", "C", "D", "good", "toxic").agg(
        F.min("id").alias("first"), F.sum("n").alias("n"), at_first.alias("n_first"), unnamed.alias("unnamed")
    )
    named = repeats_smaller_id(kinds.withColumn("n", F.col("n") - F.col("unnamed")), "digest", "first", "n", "n_first").withColumnRenamed("repeats", "E")
    without = kinds.where("unnamed > 0").withColumn("n", F.col("unnamed")).withColumn("E", F.lit(False))
    keep = ["part", "A", "B", "C", "D", "E", "good", "toxic", "n"]
    return named.select(*keep).unionByName(without.select(*keep))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs`` in all 120 orders: part, filter_order, step and the counts of each step."""
    filters = ("A", "B", "C", "D", "E")
    edges = lattice_edges(audit_documents(docs, labels), filters, part="part", n="n", outcomes={"good_lost": "good", "toxic_lost": "toxic"})
    return order_steps(edges, filters, part="part")
