"""Texts with many matches, turns and sentences: equal to plain Python, and linear."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from colloquy.functions.text import CUT, matches, parts, running_sums
from colloquy.operators import transcripts as T


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [None, [], [5], *([rng.randrange(9) for _ in range(n)] for n in (63, 64, 65, 128, 1000, 5000))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", running_sums(F.col("x")).alias("s")).collect()
    for r in got:
        x = lists[r["i"]]
        assert r["s"] == (None if x is None else [sum(x[:k]) for k in range(len(x))])


def test_parts_and_a_cut_mark_in_the_text(spark):
    df = spark.createDataFrame([(["a", "!b", "cé", "!d"],), (["!x", f"y{CUT}z"],), ([],)], "x array<string>")
    got = [[(p.at, p.text) for p in r[0]] for r in df.select(parts(F.col("x"), lambda x: F.startswith(x, F.lit("!")))).collect()]
    assert got == [[(0, "a"), (1, "!bcé"), (5, "!d")], [(0, ""), (0, "!xy z")], [(0, "")]]


def test_matches_of_a_long_text(spark):
    rng = random.Random(2)
    texts = ["", "ab", "é😀1", "".join(rng.choice("ab1 é😀") for _ in range(60_000)), None]
    began = time.perf_counter()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", matches(F.col("t"), "[0-9]+|a").alias("m")).collect()
    assert time.perf_counter() - began < 60
    for r in rows:
        t = texts[r["i"]]
        want = None if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+|a", t)]
        assert (r["m"] and [tuple(m) for m in r["m"]]) == want or (want == [] and r["m"] == [])


def test_long_transcripts_and_texts_of_one_speaker(spark):
    lines = [f"{'Ana' if i % 2 else 'Rui (Diretor)'}: Bom dia. O sr. Silva disse {i}. Certo?\nObs: nada\nmais texto" for i in range(3000)]
    long = "antes de tudo\n" + "\n".join(lines)
    texts = [(1, long), (2, "Ana: só eu falo. E mais."), (3, "Sem rótulo nenhum. Fim"), (4, ""), (5, None), (6, "Ana: oi\nAna: sim"), (7, "ANA: a\nana b: c\nBruno: d")]
    df = spark.createDataFrame(texts, "doc_id int, safe string")
    began = time.perf_counter()
    spans = T.spans(df).collect()
    assert time.perf_counter() - began < 60
    of = {i: sorted((r for r in spans if r["doc_id"] == i), key=lambda r: r["turn"]) for i in range(1, 8)}
    whole = dict(texts)
    assert len(of[1]) == 3000 and all(r["diarised"] for r in of[1]) and not of[5]
    assert all(whole[1][r["start"] :].startswith(r["text"]) for r in of[1])
    assert of[1][7]["text"].endswith("Obs: nada\nmais texto") and of[1][8]["speaker"] == "Rui" and of[1][8]["title"] == "Diretor"
    assert [(r["speaker"], r["start"], r["text"], r["diarised"]) for i in (2, 3, 4, 6) for r in of[i]] == [
        (None, 0, "Ana: só eu falo. E mais.", False), (None, 0, "Sem rótulo nenhum. Fim", False), (None, 0, "", False), (None, 0, "Ana: oi\nAna: sim", False)
    ]
    assert [r["speaker"] for r in of[7]] == ["ANA", "Bruno"]
    said = T.sentences(T.spans(df)).collect()
    assert all(whole[r["doc_id"]][r["sentence_start"] : r["sentence_end"]] == r["sentence"] for r in said)
    assert sum(r["doc_id"] == 1 for r in said) == 3000 * 4
    assert {r["sentence"] for r in said if r["doc_id"] == 3} == {"Sem rótulo nenhum.", "Fim"}
