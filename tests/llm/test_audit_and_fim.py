from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from sql_compare import DATA, compare

from colloquy.llm import queries
from colloquy.llm.fill_in_middle import fill_in_middle, restored_text
from colloquy.llm.filter_audit import filter_interactions, lattice_edges, order_steps

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(rows):
    """The letters of the filters that each (doc_id, text, lang) fails."""
    out = []
    for doc_id, text, _, *_ in rows:
        t = text or ""
        words = WORDS.findall(t)
        hit = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, *_ in rows),
        }
        out.append({k for k, v in hit.items() if v})
    return out


def plain_audit(rows, labels):
    out = {}
    failed = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                gone = [i for i, f in own if letter in f and not f & before]
                shapley[letter] += len(gone)
                out[part, "".join(order), step + 1] = (
                    sum(not f & (before | {letter}) for _, f in own),
                    len(gone),
                    sum(letter in f and bool(f & before) for _, f in own),
                    sum(f == {letter} for _, f in own),
                    sum(i in good for i in gone),
                    sum(i in toxic for i in gone),
                )
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, shapley[order[step - 1]])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COUNTS, "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd, odd_rows):
    labels = [(5, 1, 0), (9, 1, None), (9, 0, 1), (4, None, 1), (14, 1, 1), (None, 1, 1), (77, 1, 1)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(odd_rows, labels)
    rows = got(filter_interactions(odd, df))
    assert rows == want and len(rows) == 600 * len({r[2] or "" for r in odd_rows})


def test_audit_of_many_copies_and_parts(spark):
    rng = random.Random(3)
    pool = ["", "AB CD", "x # y", " ".join(f"w{i}" for i in range(120)), "same " * 130, "UP " * 120]
    rows = [(rng.randrange(90) if rng.random() < 0.95 else None, rng.choice(pool), rng.choice(["en", "fr", None, ""])) for _ in range(400)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)]
    frames = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_interactions(*frames)) == plain_audit(rows, labels)


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(none, labels).collect() == []


def test_other_filters_and_no_outcomes(spark):
    kinds = spark.createDataFrame([("p", True, False, 5), ("p", True, True, 2), ("p", False, False, 1)], "part string, X boolean, Y boolean, docs long")
    edges = lattice_edges(kinds, ("X", "Y"), part="part", n="docs")
    assert edges.count() == 4
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in order_steps(edges, ("X", "Y"), part="part").collect()}
    assert rows == {("XY", 1): (1, 7, 0, 5, 12), ("XY", 2): (1, 0, 2, 0, 2), ("YX", 1): (6, 2, 0, 0, 2), ("YX", 2): (1, 5, 2, 5, 12)}


def plain_fim(doc_id, text, seed=7, percent=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hard_texts():
    rng = random.Random(9)
    texts = ["\n", "\n\n\n", "a", "a\n", "\na", "x\r\ny\r", "<P", "P>\n<", "<\n<S\n>M>\n", "a <M> b\nc", "<S>", "é\n😀\n" * 40, " \u0085\n\x0b", "long " * 300_000, "l\n" * 200_000]
    return texts + ["".join(rng.choice("ab<PSM>\n é😀") for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("share", [{}, {"percent": 40, "spm_percent": 90, "seed": 11}])
def test_fim_against_plain_python_and_back(spark, odd, odd_rows, share):
    rows = [r[:2] for r in odd_rows] + [(1000 + i, t) for i, t in enumerate(hard_texts())]
    docs = odd.select("doc_id", "text", "key", "n_chars").unionByName(spark.createDataFrame([r for r in rows if (r[0] or 0) >= 1000], "doc_id long, text string"), allowMissingColumns=True)
    out = fill_in_middle(docs, **share).withColumn("back", restored_text("output", "form")).collect()
    made = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    plain = {"seed": share.get("seed", 7), "percent": share.get("percent", 100), "spm": share.get("spm_percent", 50)}
    assert made == Counter((i, *plain_fim(i, t, **plain)) for i, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_fim_with_other_units_and_sentinels(spark):
    docs = spark.createDataFrame([(i, "one two.three ") for i in range(50)], "doc_id long, text string")
    out = fill_in_middle(docs, units=r"\S+\s*", sentinels=("[pre.]", "[suf+]", "[mid*]")).collect()
    assert {r["n"] for r in out} == {2} and any("[pre.]" in r["output"] for r in out)
    back = fill_in_middle(docs, sentinels=("[pre.]", "[suf+]", "[mid*]"))
    assert {r[0] for r in back.select(restored_text("output", "form", ("[pre.]", "[suf+]", "[mid*]"))).collect()} == {"one two.three "}


@pytest.mark.parametrize("sentinels", [("aba", "x", "y"), ("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "z"), ("long", "on", "z")])
def test_sentinels_that_could_be_misread(spark, none, sentinels):
    with pytest.raises(ValueError):
        fill_in_middle(none, sentinels=sentinels)


def test_fim_of_nothing(none):
    assert fill_in_middle(none).collect() == []


@pytest.mark.parametrize("name", ["op11_filter_interactions", "op12_fill_in_middle"])
def test_queries_match_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], DATA)
