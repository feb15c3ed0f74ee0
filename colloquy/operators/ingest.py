"""Ingestion over tables: keys, deduplication, manifests, the evidence index and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["batch_duplicates", "csv_line", "customer_key", "evidence_index", "manifest_join", "meeting_key", "new_meetings"]


def meeting_key(title: Column, date: Column, masked_text: Column) -> Column:
    """A deterministic key, so that ingesting a meeting again changes nothing."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\x1f", empty(title), empty(date), empty(masked_text)), 256)


def customer_key(organisation: Column, name: Column) -> Column:
    """Customers are one by organisation and name, whatever the case."""
    return F.sha2(F.concat_ws("\x1f", organisation.cast("string"), F.lower(F.trim(name))), 256)


def new_meetings(batch: DataFrame, known: DataFrame, key: str = "meeting_key") -> DataFrame:
    """Rows of a batch whose key isn't known yet."""
    return batch.join(known.select(key).distinct(), key, "left_anti")


def batch_duplicates(items: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Adds content_key, first_id and kind (text or ignored) and reason to the items of a batch.

    Texts are equal when their lower-cased, whitespace-collapsed forms are; the least id stays, others
    are ignored with a reason. Rows are not dropped. The first id is a partial aggregate, joined back.
    """
    key = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+", " ")), 256)
    keyed = items.withColumn("content_key", key)
    firsts = keyed.groupBy("content_key").agg(F.min(id_col).alias("first_id"))
    again = F.col(id_col) != F.col("first_id")
    return keyed.join(firsts, "content_key").withColumn("kind", F.when(again, "ignored").otherwise("text")).withColumn("reason", F.when(again, "duplicate"))


def manifest_join(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path) with the manifest row (file, ordinal, ..) that names them: by whole path, else by the end
    of the path that has most folders, else by base name, with or without extension; the first row wins.
    Each form of the manifest keeps its first row before the join, so a file meets one row for each of its
    folders and two more at most."""
    base = lambda c: F.element_at(F.split(F.lower(c), "/"), -1)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    forms = lambda c: F.array_distinct(F.array(F.lower(c), base(c), stem(base(c))))
    parts = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    named = F.array_distinct(F.concat(ends, F.array(stem(base(F.col("path"))))))
    left = files.select("path", F.posexplode(named).alias("rank", "form"))
    rest = manifest.columns
    file = F.trim(F.regexp_replace("file", r"\\", "/"))
    right = manifest.select(F.struct(*rest).alias("m"), F.explode(forms(file)).alias("form"))
    right = right.groupBy("form").agg(F.min_by("m", "m.ordinal").alias("m"))
    best = left.join(right, "form").groupBy("path").agg(F.min_by("m", "rank").alias("m"))
    return files.join(best, "path", "left").select(*files.columns, *(F.col(f"m.{c}").alias(c) for c in rest))


def evidence_index(lists: dict[str, DataFrame]) -> DataFrame:
    """One flat row per quoted item: kind, doc_id, ordinal, quote, start, end."""
    rows = [df.select(F.lit(kind).alias("kind"), "doc_id", "ordinal", "quote", "start", "end") for kind, df in lists.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def csv_line(columns: list[Column], separator: str = ";") -> Column:
    """A CSV line: fields with the separator, quotes or line breaks are quoted, null is empty."""
    special = rf'[{separator}"\r\n]'

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike(special), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)

    return F.concat_ws(separator, *(field(c) for c in columns))
