from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest

from colloquy.llm import char_tagger as ct
from colloquy.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The rules by the letter, one regular expression a kind."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * 2 for c in digits[-2::-2]]
            checksum = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and checksum % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((pii.KINDS.index(kind), *m.span()))
    return out


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def tiny(rng, states=3, features=2, tags=3):
    f = lambda *s: rng.normal(0, 0.6, s).astype(np.float32)
    return ct.Tagger(f(features, ct.SYMBOLS), f(2, 4 * states, states + features + 1), f(2, tags, states), f(tags), f(tags, tags))


def test_rules_against_plain_expressions():
    rng = random.Random(4)
    pieces = ["1.2.3.4", "+", "@", ".", "-", " ", "a", "b.c", "255", "256", "(12)", "4111111111111111", "4111-1111 1111 1111", "0000", "x@y.zz", "é", "%", "007", "\n", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    texts += ["1.2.3.4.5.6.7.8.9", "a@b@c.d@e.f.g.", "a@b.c.@d.e", "+1 (234) 555-1234 +44 20 1234", "000.0255.0256.1 0.0.0.0", "١٢٣.1.2.3", "a" * 50 + "@" + "b" * 50 + ".c", "@.@a.b"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_rules_are_linear_in_long_runs():
    began = time.perf_counter()
    n = 400_000
    for text in ("a" * n, "1" * n, "1." * n, "1-" * n, "+1" + " (" * n, "a@" * n, "a.b" * n + "@", "@" * n, "+" * n, "1.2.3.4" * (n // 7), "a@" + "b" * n):
        pii.base_spans(text)
    assert time.perf_counter() - began < 40


def test_loss_and_gradients_against_enumeration_and_differences():
    rng = np.random.default_rng(1)
    m = tiny(rng)
    windows, tags = rng.integers(0, ct.SYMBOLS, (5, 4)).astype(np.uint8), rng.integers(0, 3, (5, 4))
    loss, slopes = ct.gradients(m, windows, tags)
    length = np.full(4, 5)
    scores = ct._emissions(m, windows, length)

    def score(path, w):
        return sum(float(scores[t, k, w]) for t, k in enumerate(path)) + sum(float(m.moves[a, b]) for a, b in zip(path[:-1], path[1:], strict=True))

    total = 0.0
    for w in range(4):
        every = [score(p, w) for p in product(range(3), repeat=5)]
        total += np.log(np.sum(np.exp(every))) - score(tags[:, w], w)
    assert loss == pytest.approx(total / 4, rel=1e-4)
    for part, slope in zip(m.parts(), slopes, strict=True):
        way = rng.normal(0, 1, part.shape).astype(np.float32)
        part += 0.01 * way
        up, _ = ct.gradients(m, windows, tags)
        part -= 0.02 * way
        down, _ = ct.gradients(m, windows, tags)
        part += 0.01 * way
        assert (up - down) / 0.02 == pytest.approx(float((slope * way).sum()), rel=0.02, abs=2e-3)


def test_windows_of_unlike_length_against_enumeration():
    rng = np.random.default_rng(2)
    m = tiny(rng)
    text = rng.integers(0, ct.SYMBOLS, 60).astype(np.uint8)
    start, length = np.array([0, 7, 20, 30, 59]), np.array([6, 1, 4, 6, 1])
    got = {}
    for w, a, b, tag, gain in ct.decode_windows(m, text, start, length, batch=3):
        got.setdefault(w, []).append((a, b, tag, gain))
    for w in range(5):
        one = ct._emissions(m, text[start[w] : start[w] + length[w]][:, None], length[w : w + 1])[:, :, 0]
        value = lambda p: sum(one[t, k] for t, k in enumerate(p)) + sum(m.moves[a, b] for a, b in zip(p[:-1], p[1:], strict=True))  # noqa: B023, E731
        best = max(product(range(3), repeat=int(length[w])), key=value)
        runs, a = [], 0
        for t in range(1, len(best) + 1):
            if t == len(best) or best[t] != best[a]:
                if best[a]:
                    runs.append((a, t, best[a], pytest.approx(float((one[a:t, best[a]] - one[a:t, 0]).sum()), abs=1e-4)))
                a = t
        assert got.get(w, []) == runs


def test_windows_cover_texts_and_overlap():
    sizes = np.array([0, 1, pii.WINDOW, pii.WINDOW + 1, 10_000, 0, 33])
    text, start, length = pii.window_bounds(sizes)
    for i, n in enumerate(sizes):
        own = [(a, a + k) for t, a, k in zip(text, start, length, strict=True) if t == i]
        assert all(b - a <= pii.WINDOW for a, b in own)
        for width in range(1, min(n, pii.OVERLAP) + 1):
            assert all(any(a <= s and s + width <= b for a, b in own) for s in {0, n - width, *range(0, n - width, 7)})


def test_reconciled_against_all_choices():
    rng = random.Random(8)
    for _ in range(300):
        runs = [(a := rng.randrange(20), a + rng.randrange(1, 8), rng.randrange(1, 3), float(rng.randrange(1, 40)), False, False) for _ in range(rng.randrange(7))]
        whole = {}
        for a, b, k, s, *_ in runs:
            whole[a, b, k] = whole.get((a, b, k), 0) + s
        best = max(
            sum(whole[r] for r in some)
            for n in range(len(whole) + 1)
            for some in combinations(whole, n)
            if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(some, 2))
        )
        kept = pii.reconciled(runs)
        assert sum(whole[a, b, k] for k, a, b in kept) == best
        assert all(x[2] <= y[1] for x, y in zip(kept[:-1], kept[1:], strict=True))


def test_runs_that_windows_cut_are_joined():
    runs = [(150, 192, 1, 5.0, False, True), (160, 352, 1, 9.0, True, True), (320, 400, 1, 4.0, True, False), (170, 180, 2, 3.0, False, False)]
    assert pii.reconciled(runs) == [(1, 150, 400)]


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit_pii(docs, pieces=800, rounds=350)


def test_held_out_accuracy(learnt):
    """The tagger alone, over planted forms that the rules don't know and over texts that it hasn't seen."""
    import duckdb

    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id >= 1000 AND text IS NOT NULL ORDER BY doc_id LIMIT 700").fetchall()
    texts = [r[0] for r in rows]
    base, found = [pii.base_spans(t) for t in texts], pii.tagged(learnt, texts)
    seen = right = extra = 0
    for text, spans, runs in zip(texts, base, found, strict=True):
        own = {(k - 1, *pii.trimmed(text, a, b)) for k, a, b in pii.reconciled(runs)}
        seen, right = seen + len(spans), right + len(own & set(spans))
        extra += len(pii.added_spans(text, spans, runs))
    assert seen >= 40 and right >= 0.8 * seen
    assert extra <= 3
    rng = np.random.default_rng(50)
    planted = hit = 0
    for i in range(400):
        span = pii.planted_span(rng, i % 4)
        if not pii.base_spans(span):
            words = texts[i].split(" ")[:60]
            before = " ".join(words[:30]) + " "
            text = before + span + " " + " ".join(words[30:])
            planted += 1
            hit += (i % 4, len(before), len(before) + len(span)) in pii.added_spans(text, pii.base_spans(text), pii.tagged(learnt, [text])[0])
    assert planted > 120 and hit >= 0.7 * planted


def test_long_texts_and_odd_rows(spark, learnt, odd, odd_rows):
    phone, card = "+1 (234) 555-1234", "4111 1111 1111 1111"
    long = "la casa de\n" * 120_000 + f"é {phone} y {card} " + "x" * 300_000 + " a.b@c.de"
    rows = [r[:2] for r in odd_rows] + [(100, long), (101, "a@b.cc"), (101, "a@b.cc"), (102, "😀 1.2.3.4 +4 (111) 222-3333")]
    docs = odd.select("doc_id", "text", "spans", "score").unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"), allowMissingColumns=True)
    got = pii.find_personal_data(docs, learnt).collect()
    want = Counter()
    for doc_id, text in rows:
        base = plain_spans(text or "")
        want[doc_id, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
        places = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert places == sorted(places)
    assert {s for r in got if r["doc_id"] == 102 for s in r["spans"].split(",")} >= {"ip:2:9", "phone:10:27"}


def test_nothing_to_learn_from_and_nothing_to_read(spark, none):
    m = pii.fit_pii(none, rounds=2)
    assert pii.find_personal_data(none, m).collect() == []


def test_fitting_again_gives_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = pii.fit_pii(docs, rounds=5), pii.fit_pii(docs.repartition(7).unionByName(docs), rounds=5)
    assert all((a == b).all() for a, b in zip(one.parts(), two.parts(), strict=True))


def test_query_over_whole_texts(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    got = queries.queries()["op13_personal_data"](spark, sf_dir).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    base = {i: plain_spans(t or "") for i, t in rows}
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(joined(s).encode()).hexdigest() for i, s in base.items()}
    for r in got:
        assert set(joined(base[r["doc_id"]]).split(",")) - {""} <= set(r["spans"].split(","))
