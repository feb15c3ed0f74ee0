"""Dates, titles, folders and quotes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators.anchoring import anchored, evidence_coverage
from colloquy.sources import metadata as M


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2026-09-10T10:00", dt.date(2026, 9, 10)),
        ("10/09/2026", dt.date(2026, 9, 10)),
        ("31/02/2026", None),
        ("45000", dt.date(2023, 3, 15)),
        ("1700000000", dt.date(2023, 11, 14)),
        ("1700000000000", dt.date(2023, 11, 14)),
        ("GMT20260910-143000_reuniao", dt.date(2026, 9, 10)),
        ("call_05-03-2025.vtt", dt.date(2025, 3, 5)),
        ("nada", None),
        (None, None),
    ],
)
def test_dates(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(M.normalised_date(F.col("v"))).first()[0] == want


def test_titles_and_folders(spark):
    rows = [("lote/Loja_Azul/2026/Q1/2026-01-05_primeira_reuniao.vtt",), ("a.txt",), ("semana 2/x.txt",)]
    df = spark.createDataFrame(rows, "p string").select(M.title_of_name(F.col("p")).alias("t"), M.customer_of_folders(F.col("p"), ("lote",)).alias("c"))
    assert [tuple(r) for r in df.collect()] == [("primeira reuniao", "Loja Azul"), ("a", None), ("x", None)]


def test_quotes_are_anchored(spark):
    texts = spark.createDataFrame([(1, "o preço (alto) pesa\nmuito para nós")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "preço (alto)"), (1, "pesa  muito para"), (1, "não está aqui"), (1, "nós")], "doc_id long, quote string")
    got = {r.quote: r.span and tuple(r.span) for r in anchored(items, texts).collect()}
    assert got == {"preço (alto)": (2, 14), "pesa  muito para": (15, 30), "não está aqui": None, "nós": None}
    index = spark.createDataFrame([("k", 1, "preço", 2, 7), ("k", 1, "preço", 3, 8)], "kind string, doc_id long, quote string, start int, end int")
    assert evidence_coverage(index, texts).first().coverage == 0.5
