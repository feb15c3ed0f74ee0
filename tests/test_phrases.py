"""The word-by-word matcher against plain Python and against one expression an entry."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators.phrases import Phrase, compiled, lexicon_from, phrase_hits

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def plain_hits(text, phrases):
    """Entries by trying every one at every token."""
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    out = set()
    for key, rest, ordinal, *_ in compiled(phrases):
        for i, (start, end, word) in enumerate(tokens):
            if word != key and not (len(key) > 1 and key.endswith("*") and word.startswith(key[:-1])):
                continue
            places = {(i, end)}
            for want, stem, gap in rest:
                places = {(j, tokens[j][1]) for k, _ in places for j in range(k + 1, min(len(tokens), k + gap + 2)) if (tokens[j][2].startswith(want) if stem else tokens[j][2] == want)}
            if places:
                out.add((ordinal, start, min(e for _, e in places)))
    best = {}
    for o, s, e in out:
        best[o, s] = min(e, best.get((o, s), e))
    return {(o, s, e) for (o, s), e in best.items()}


def made_phrases(n, rng):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"]
    out = []
    for i in range(n):
        parts = [rng.choice(words)]
        for _ in range(rng.randrange(4)):
            kind = rng.random()
            if kind < 0.2:
                parts.append(f"~{rng.randrange(1, 4)}")
            parts.append(rng.choice([rng.choice(words), f"{rng.choice(words)}|{rng.choice(words)}", f"{rng.choice(words)}?", rng.choice("abcdefgh") + "*", "-", ","]))
            if parts[-1].endswith("?"):
                parts.append(rng.choice(words))
        if rng.random() < 0.1:
            parts[0] = rng.choice("abcdefgh") + rng.choice("aeiou")[:1] + "*"
        out.append(Phrase(f"p{i}", " ".join(parts), float(i), "g"))
    return out


def texts(n, rng, words=30):
    pool = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"] + ["aab", "éa", "-", ",", ".", "_", "(", "1a"]
    return ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rng.randrange(words))) for _ in range(n)]


def test_three_hundred_entries_against_plain_python(spark):
    rng = random.Random(6)
    phrases, lines = made_phrases(300, rng), [*texts(150, rng), "", "ba be"]
    df = spark.createDataFrame([(i, 100 * i, t) for i, t in enumerate(lines)] + [(999, 0, None)], "doc_id int, start int, search string")
    got = {}
    for r in phrase_hits(df, phrases).collect():
        got.setdefault(r["doc_id"], set()).add((r["ordinal"], r["hit_start"] - r["start"], r["hit_end"] - r["start"]))
        assert r["label"] == f"p{r['ordinal']}" and r["weight"] == r["ordinal"] and r["grp"] == "g"
    want = {i: h for i, t in enumerate(lines) if (h := plain_hits(t, phrases))}
    assert got == want and sum(map(len, want.values())) > 500


def test_entries_equal_their_expressions(spark):
    """Where words are divided by blanks, an entry hits where its expression does."""
    rng = random.Random(7)
    phrases = [p for p in made_phrases(520, rng) if not re.search(r"[-,]", p.words)][:300]
    lines = [" ".join(t.replace("_", " ").split()) for t in texts(60, rng)]
    lines = [re.sub(r"[^\w\s]", " . ", t) for t in lines]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, search string")
    got = {(r["doc_id"], r["ordinal"], r["hit_start"]) for r in phrase_hits(df, phrases).collect()}
    plain = lambda p: p.pattern.replace(r"[^\p{L}\p{N}\s]", r"(?:[^\w\s]|_)").replace(r"[\p{L}\p{N}]", r"[^\W_]")
    edges = [re.compile(rf"(?<![^\W_])(?=(?:{plain(p)})(?![^\W_]))") for p in phrases]
    want = {(i, k, m.start()) for i, t in enumerate(lines) for k, e in enumerate(edges) for m in e.finditer(t)}
    assert got == want and len(phrases) == 300


def test_the_plan_and_its_cost_do_not_follow_the_number_of_entries(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3000, rng, 60))], "doc_id int, search string").cache()
    df.count()
    few = [Phrase(f"p{i}", f"zz{i} ba ~2 be") for i in range(10)]
    many = [Phrase(f"p{i}", f"zz{i} ba ~2 be") for i in range(3000)]

    def cost(phrases):
        hits = phrase_hits(df, phrases)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert hits.count() == 0
            best.append(time.perf_counter() - began)
        return min(best)

    cost(few)
    assert cost(many) < 3 * cost(few) + 1
    df.unpersist()


def test_a_lexicon_is_a_table(spark):
    rows = spark.createDataFrame([("price", "caro|salgado", 2.0, "a"), ("price", "preco muito? alto", None, None), (None, "x", 1.0, "b")], "label string, words string, weight double, grp string")
    lexicon = lexicon_from(rows)
    assert lexicon == [Phrase("price", "caro|salgado", 2.0, "a"), Phrase("price", "preco muito? alto")]
    df = spark.createDataFrame([(1, "o preco alto, e o preco muito alto: salgado")], "doc_id int, search string")
    assert sorted((r["hit_start"], r["hit_end"]) for r in phrase_hits(df, lexicon).collect()) == [(2, 12), (18, 34), (36, 43)]


@pytest.mark.parametrize("words", ["", "~2 a", "a ~2", " ".join("ab" for _ in range(40)), " ".join("a|b|c" for _ in range(8))])
def test_phrases_that_cannot_be_read(words):
    with pytest.raises(ValueError):
        compiled([Phrase("x", words)])


def test_clashing_columns_are_refused_and_others_stay(spark):
    df = spark.createDataFrame([("m", 1, "oi ba be")], "side string, doc_id int, search string")
    row = phrase_hits(df, [Phrase("x", "ba be")]).first()
    assert (row["side"], row["hit_start"], row["hit_end"]) == ("m", 3, 8)
    with pytest.raises(ValueError):
        phrase_hits(df.withColumn("label", F.lit(1)), [Phrase("x", "ba")])
    assert phrase_hits(df, []).collect() == []
