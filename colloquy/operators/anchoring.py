"""Anchoring: what a model proposes stays only if its quote stands in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import once

__all__ = ["anchored", "coverage", "evidence_coverage", "evidence_rows", "quote_offset"]

LEAST_CHARS = 8


def _index(text: Column) -> Column:
    """Struct of a text, and the text with every white space made one blank."""
    return F.struct(text.alias("text"), F.regexp_replace(text, r"\s+", " ").alias("bare"))


def _found(index: Column, quote: Column, least: int) -> Column:
    """Struct (start, end) of a quote in an indexed text; null if it isn't there or is shorter than ``least``."""
    plain = F.regexp_replace(F.trim(quote), r"^\s+|\s+$", "")

    def spaced(bare: Column) -> Column:
        """Where the words of a quote stand with any white space between them; sought only where they do."""
        literal = F.replace(bare, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        words = F.concat(F.lit("\\Q"), F.replace(literal, F.lit(" "), F.lit("\\E\\s+\\Q")), F.lit("\\E"))
        first = F.length(F.call_function("regexp_extract", index.text, F.concat(F.lit("(?s)^(.*?)"), words), F.lit(1)))
        size = F.length(F.call_function("regexp_extract", index.text, words, F.lit(0)))
        return F.when(F.contains(index.bare, bare), F.struct(first.alias("start"), (first + size).alias("end")))

    def of(q: Column) -> Column:
        literal = F.instr(index.text, q)
        whole = F.struct((literal - 1).alias("start"), (literal - 1 + F.length(q)).alias("end"))
        return F.when(F.length(q) >= least, F.when(literal > 0, whole).otherwise(once(F.regexp_replace(q, r"\s+", " "), spaced)))

    return once(plain, of)


def quote_offset(text: Column, quote: Column, least: int = LEAST_CHARS) -> Column:
    """Struct (start, end) of a quote's first occurrence, literally or else whatever the white space between its
    words; null if it isn't there or is shorter than ``least``."""
    return once(_index(text), lambda index: _found(index, quote, least))


def anchored(items: DataFrame, texts: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Items (doc_id, quote, ..) with ``span``, null where the quote isn't in the text or there is no text: those
    are to be discarded and counted.

    A text is indexed once, for all quotes that are said to stand in it: it travels once, not once an item,
    and no expression is built for a quote. Quotes that repeat are sought once.
    """
    asked = items.where("quote is not null").groupBy("doc_id").agg(F.collect_set("quote").alias("quotes"))
    rows = texts.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(asked, "doc_id")
    told = once(_index(F.col("text")), lambda index: F.transform("quotes", lambda q: F.struct(q.alias("quote"), _found(index, q, least).alias("span"))))
    spans = rows.select(F.col("doc_id").alias("_doc"), F.explode(told).alias("_t")).select("_doc", F.col("_t.quote").alias("_quote"), F.col("_t.span").alias("span")).where("span is not null")
    return items.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("quote") == F.col("_quote")), "left").drop("_doc", "_quote")


def evidence_rows(found: DataFrame) -> DataFrame:
    """The index of all that findings quote: kind, doc_id, ordinal, quote, start, end, by place in each text and kind.

    ``found`` is of ``analysis.findings``; ``start`` is the place of what was found, ``end`` where its quote ends as
    long as it begins there. Findings without a quote are items without evidence.
    """
    order = Window.partitionBy("kind", "doc_id").orderBy(F.col("start").asc_nulls_last(), "label", "quote")
    rows = found.withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select("kind", "doc_id", "ordinal", "quote", "start", (F.col("start") + F.length("quote")).alias("end"))


def coverage(items: DataFrame, texts: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """kind, items, quoted, covered, coverage: how many items (kind, doc_id, quote) have a quote, and how many one that stands in their text."""
    rows = anchored(items, texts, least).groupBy("kind").agg(
        F.count("*").alias("items"), F.count("quote").alias("quoted"), F.count("span").alias("covered"),
    )
    return rows.withColumn("coverage", F.col("covered") / F.col("items"))


def evidence_coverage(index: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, items, covered, coverage: how many quoted items say just what their offsets hold."""
    said = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = index.join(texts.select("doc_id", "text"), "doc_id")
    out = rows.groupBy("kind").agg(F.count("*").alias("items"), F.sum((said == F.col("quote")).cast("long")).alias("covered"))
    return out.withColumn("coverage", F.col("covered") / F.col("items"))
