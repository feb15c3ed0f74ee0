"""Delimited files and pasted layouts into transcripts, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import fold

__all__ = ["delimited_rows", "reflowed", "sniffed_separator", "tables_to_texts"]

# Separators in order of preference, and (folded) headers of the columns that matter.
SEPARATORS = (";", ",", "\t", "|")
TEXTS = ("texto", "transcricao", "text", "transcript", "fala", "conteudo", "mensagem")
SPEAKERS = ("falante", "speaker", "participante", "nome", "name", "autor")
FILES = ("arquivo", "file", "filename", "caminho")
#: Texts of this many characters on average are whole meetings.
MEETING_CHARS = 150


def sniffed_separator(text: Column) -> Column:
    """The separator that the first line has most of (ties: the first in SEPARATORS); null without any."""
    line = F.regexp_extract(text, r"^﻿?([^\r\n]*)", 1)
    counts = [F.struct(F.length(F.regexp_replace(line, rf"[^{'\\' if s == '|' else ''}{s}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)]
    best = F.array_max(F.array(*counts))
    return F.when(best.n > 0, best.s)


def delimited_rows(files: DataFrame, text_col: str = "text") -> DataFrame:
    """path, row, cells of every record: fields in quotes may hold separators, line breaks and doubled
    quotes. A quote without its other half is left out. Files without a separator have one cell a line."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^﻿", ""), r"\r\n?", "\n")
    records = F.regexp_extract_all(text, F.lit(r'(?:[^"\n]++|"[^"]*+")++'), F.lit(0))
    rows = files.select("path", F.coalesce(sniffed_separator(F.col(text_col)), F.lit(",")).alias("sep"), F.posexplode(records).alias("row", "record"))

    def fields(s: str) -> Column:
        mark = "\\|" if s == "|" else s
        return F.regexp_extract_all(F.concat("record", F.lit(s)), F.lit(rf'((?:[^"{mark}]++|"[^"]*+")*+){mark}'), F.lit(1))

    split = F.coalesce(*(F.when(F.col("sep") == s, fields(s)) for s in SEPARATORS))
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return rows.select("path", "row", F.transform(split, lambda x: bare(F.trim(x))).alias("cells"))


def tables_to_texts(rows: DataFrame) -> DataFrame:
    """path, row, shape, text of tables (path, row, cells) whose first record is a header.

    meetings: a text a record, of 150 characters on average or more. utterances: a speaker and a text a
    record, joined to one text at the first record. manifest: a column of file names; its records have no
    text. Tables of no known header: unknown, with the cells joined by blanks.
    """
    header = F.transform(F.get(F.collect_list(F.when(F.col("row") == 0, F.col("cells"))).over(Window.partitionBy("path")), F.lit(0)), lambda h: fold(F.trim(h)))
    place = lambda names: F.coalesce(*(F.when(F.array_contains("header", n), F.array_position("header", n)) for n in names))
    body = rows.withColumn("header", header).where("row > 0")
    body = body.select("path", "row", "cells", place(TEXTS).alias("t"), place(SPEAKERS).alias("s"), place(FILES).alias("f"))
    cell = lambda c: F.get("cells", (F.col(c) - 1).cast("int"))
    body = body.withColumn("said", cell("t")).withColumn("mean", F.avg(F.length("said")).over(Window.partitionBy("path")))
    shape = F.when(F.col("f").isNotNull(), "manifest").when(F.col("mean") >= MEETING_CHARS, "meetings").when(F.col("s").isNotNull() & F.col("t").isNotNull(), "utterances").otherwise("unknown")
    body = body.withColumn("shape", shape)
    text = F.when(F.col("shape") == "meetings", F.col("said")).when(F.col("shape") == "unknown", F.array_join("cells", " "))
    single = body.where("shape <> 'utterances'").select("path", "row", "shape", text.alias("text"))
    line = F.concat_ws(": ", cell("s"), F.col("said"))
    spoken = body.where("shape = 'utterances'").groupBy("path").agg(F.min("row").alias("row"), F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("x"))
    return single.unionByName(spoken.select("path", "row", F.lit("utterances").alias("shape"), F.array_join(F.transform("x", lambda r: r.line), "\n").alias("text")))


# A name, then a time in the same or the next line, then what was said.
BLOCK = r"(?m)^[ \t]*(\p{Lu}[\p{L}.'’ -]{1,40}?)[ \t]*\n?[ \t]+?\(?(?:\d{1,2}:)?\d{1,2}:\d{2}\)?[ \t]*\n+[ \t]*(?=\S)|(?m)^[ \t]*(\p{Lu}[\p{L}.'’ -]{1,40}?)[ \t]*\n[ \t]*\(?(?:\d{1,2}:)?\d{1,2}:\d{2}\)?[ \t]*\n+[ \t]*(?=\S)"


def reflowed(text: Column) -> Column:
    """Meeting layouts of a name, a time and speech in separate lines as ``Name: speech``, where two blocks or
    more look so; other texts as they are."""
    return F.when(F.regexp_count(text, F.lit(BLOCK)) >= 2, F.regexp_replace(text, BLOCK, "$1$2: ")).otherwise(text)
