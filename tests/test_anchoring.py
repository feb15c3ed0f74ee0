"""Quotes sought in texts, literally and whatever the white space."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from colloquy.operators.anchoring import anchored, coverage, quote_offset


def plain(text, quote, least=8):
    if text is None or quote is None:
        return None
    q = quote.strip(" \t\n\r\x0b\x0c")
    if len(q) < least:
        return None
    at = text.find(q)
    if at >= 0:
        return at, at + len(q)
    m = re.search(r"[ \t\n\r\x0b\x0c]+".join(map(re.escape, re.split(r"[ \t\n\r\x0b\x0c]+", q))), text)
    return m.span() if m else None


def test_quotes_against_a_pattern_for_each(spark):
    rng = random.Random(3)
    words = ["casa", "é", "😀", "(a+b)", "\\E", "x.y", "no", "sim,"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(n))
    texts = [(i, text(rng.randrange(60))) for i in range(40)] + [(90, None), (91, "")]
    items = []
    for i, t in texts[:40]:
        for _ in range(6):
            a = rng.randrange(len(t) + 1)
            q = t[a : a + rng.randrange(30)]
            items.append((i, rng.choice([q, " ".join(q.split()), q.replace(" ", " \n "), q + "z", f"  {q}"])))
    items += [(90, "qualquer coisa"), (91, "qualquer coisa"), (99, "qualquer coisa"), (0, None), (0, ""), items[0], items[0]]
    df = spark.createDataFrame(items, "doc_id int, quote string").withColumn("_own", F.lit("clash"))
    got = anchored(df, spark.createDataFrame(texts, "doc_id int, text string")).collect()
    whole = dict(texts)
    assert len(got) == len(items)
    for r in got:
        assert (r["span"] and tuple(r["span"])) == plain(whole.get(r["doc_id"]), r["quote"]), r
    assert sum(r["span"] is not None for r in got) > 60


def test_one_quote_and_coverage(spark):
    df = spark.createDataFrame([("um  dois\ntres quatro",)], "t string")
    assert tuple(df.select(quote_offset(F.col("t"), F.lit("dois tres"))).first()[0]) == (4, 13)
    assert df.select(quote_offset(F.col("t"), F.lit("dois"))).first()[0] is None
    items = spark.createDataFrame([("a", 1, "um dois tres"), ("a", 1, "nunca dito isso"), ("b", 1, None), ("b", 2, "um dois tres")], "kind string, doc_id int, quote string")
    rows = coverage(items, df.select(F.lit(1).alias("doc_id"), F.col("t").alias("text"))).collect()
    assert {r["kind"]: (r["items"], r["quoted"], r["covered"], r["coverage"]) for r in rows} == {"a": (2, 2, 1, 0.5), "b": (2, 1, 0, 0.0)}
