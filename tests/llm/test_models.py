"""Quality, language and language-model operators: accuracy, brute force and odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sql_compare import DATA
from pyspark.sql import functions as F

from colloquy.llm import queries as Q
from colloquy.llm import brown_lm
from colloquy.llm.blocks import Block
from colloquy.llm.brown_lm import exchange_clusters, score_texts
from colloquy.llm.language_id import SCRIPTS, fit_languages, identify_languages, script_numbers, viterbi
from colloquy.llm.quality_knn import LatentVectors, fit_quality, score_quality
from colloquy.llm import quality_rules as rules
from colloquy.llm.quality_rules import FEATURES, least_determinant, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in Q.op3_quality_neighbours(spark, DATA).collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if fold(r.doc_id, 3) == 1]
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(rows[r.doc_id].held_out for r in labels)
    right = [rows[r.doc_id].predicted == r.quality for r in labels]
    assert np.mean(right) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_votes_match_plain_neighbours():
    rng = np.random.default_rng(2)
    counts, seen = rng.random((300, 20)).astype(np.float32), rng.random((70, 20)).astype(np.float32)
    counts[5] = 0
    model = LatentVectors(np.ones(20, np.float32), np.eye(20, 6, dtype=np.float32), np.zeros(0), rng.integers(0, 2, 70), rng.random(70) + 0.5, 0.25)
    model.vectors = model.project(seen)
    got = model.votes(counts, 9)
    for k, row in enumerate(counts):
        own = np.log1p(100.0 * row)[:6]
        near = []
        for j, other in enumerate(seen):
            theirs = np.log1p(100.0 * other)[:6]
            cosine = own @ theirs / max(1e-9, math.dist(own, np.zeros(6)) * math.dist(theirs, np.zeros(6)))
            near.append((-cosine, j))
        votes = [((-c) ** 8 * model.weights[j], model.labels[j]) for c, j in sorted(near)[:9]]
        want = sum(w * label for w, label in votes) / sum(w for w, _ in votes) if row.any() else 0.25
        assert math.isclose(got[k], want, abs_tol=1e-4)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (9, 0), (3, 0), (None, 1), (99, 1), (7, 5)], "doc_id long, label int")
    got = score_quality(odd, fit_quality(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score_quality(odd, fit_quality(none, labels.limit(0))).collect()} == {0.5}
    assert score_quality(none, fit_quality(odd, labels)).count() == 0


def base_facts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base(spark, odd, odd_rows, none):
    extra = [(40, "a b c a b c d\nx\nx\n \n", "en", "a"), (41, "a a a a", "en", "a"), (42, "#* $%\n|<>&|", "en", "a")]
    got = quality_rules(odd.select("doc_id", "text", "lang", "source").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")))
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert found == Counter((d, *base_facts(t)) for d, t, *_ in [*odd_rows, *extra])
    assert all(not r.kept for r in got.collect() if r.base_failed)
    assert quality_rules(none).count() == 0


def test_quality_rules_outliers(spark):
    rng = np.random.default_rng(4)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n))
    rows = [(k, line(int(rng.integers(80, 300))), "en", "s") for k in range(300)]
    rows += [(1000 + k, line(150).replace(" ", "### "), "en", "s") for k in range(20)] + [(2000 + k, line(150).replace(" ", "!!!!!! "), "en", "s") for k in range(20)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept for r in got if r.doc_id < 1000 and not r.base_failed)
    assert not any(r.kept for r in got if r.doc_id >= 1000)


def test_least_determinant_against_many_starts(spark):
    rng = np.random.default_rng(9)
    noise = np.array(rules.NOISE)
    groups = {}
    for g, (n, bad) in {"a": (120, 0.0), "b": (160, 0.2)}.items():
        x = rng.normal(size=(n, 5)) * noise * 4 + 3
        x[: int(n * bad)] += noise * 60
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r.grp: r for r in least_determinant(rows, 0.75, 12).collect()}

    def fit(part):
        return part.mean(axis=0), np.cov(part.T, bias=True) + np.diag(noise**2)

    for g, x in groups.items():
        h, least = math.ceil(len(x) * 0.75), math.inf
        for _ in range(300):
            own = x[rng.choice(len(x), 6, replace=False)]
            for _ in range(30):
                mean, cov = fit(own)
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                own = x[np.argsort(d)[:h]]
            least = min(least, np.linalg.slogdet(fit(own)[1])[1])
        # Rows that tie within a bin of 1 % enlarge the fitted part a little.
        assert least - 1e-6 <= got[g].logdet <= least + 0.15, (g, least, got[g].logdet)
        if g == "b":
            assert all(abs(got[g][f"m{k}"] - 3) < noise[k] * 2 for k in range(5))


def test_language_held_out(spark):
    got = {r.doc_id: r for r in Q.op9_language_spans(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held = [d for d in docs if fold(d.doc_id, 5) == 0]
    assert all(got[d.doc_id].held_out == (fold(d.doc_id, 5) == 0) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) >= 0.95


def test_language_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_languages(docs)
    part = {r.lang: r.text for r in docs.where("lang in ('en', 'fr') and length(text) between 800 and 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = part["en"] + " " + part["fr"]
    rows = [(1, mixed), (2, None), (3, "12 34 !!"), (4, ""), (5, "Привет мир")]
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {s.lang for s in got[1].spans} >= {"en", "fr"}
    edge = len(part["en"].encode())
    assert any(abs(s.start - edge) < 40 for s in got[1].spans if s.lang == "fr")
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred in model.languages


def test_scripts_by_code_point():
    text = "aé ß1 Жд ქართ ሰላም tiếng 日本 かな 한국 αβ עב عر कख 😀 ไทย –"
    got = script_numbers(np.frombuffer(text.encode(), np.uint8))
    at, seen = 0, []
    for c in text:
        seen.append((c, SCRIPTS[got[at]]))
        assert not got[at + 1 : at + len(c.encode())].any()
        at += len(c.encode())
    want = {"é": "latin", "Ж": "cyrillic", "ქ": "georgian", "ሰ": "ethiopic", "ế": "latin", "日": "han", "か": "kana", "한": "hangul"}
    want |= {"α": "greek", "ע": "hebrew", "ع": "arabic", "क": "devanagari", "😀": "none", "ไ": "thai", "–": "none", "1": "none"}
    assert {c: s for c, s in seen if c in want} == want


def test_language_of_odd_rows(odd, none):
    assert identify_languages(odd, fit_languages(odd)).count() == odd.count()
    assert {r.lang_pred for r in identify_languages(odd, fit_languages(none)).collect()} == {"und"}
    assert identify_languages(none, fit_languages(odd)).count() == 0


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(counts.sum(), 2)).astype(np.float32)
    got, at = viterbi(scores, counts, 0.7), 0
    for n in counts:
        def total(path, at=at, n=n):
            return sum(scores[at + i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        assert math.isclose(total(got[at : at + n]), max(map(total, paths)), abs_tol=1e-5)
        at += n


def test_lm_base_scores(spark, odd, odd_rows, none):
    got = score_texts(odd, "doc_id % 2 = 1").collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    c = Counter(x for d, t, *_ in odd_rows if d is not None and d % 2 == 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 5)) for d, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert score_texts(none).count() == 0 and score_texts(odd, "false").count() == odd.count()


def test_lm_beats_unigrams(spark):
    held = [r for r in Q.op10_brown_class_lm(spark, DATA).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_classes():
    pairs = np.zeros((6, 6))
    pairs[:3, 3:] = 50  # types 0-2 are always followed by types 3-5
    pairs[3:, :3] = 50
    member = exchange_clusters(pairs, 2)
    assert len(set(member[:3])) == len(set(member[3:])) == 1 and member[0] != member[3]


def test_lm_class_scores(spark, odd, odd_rows, monkeypatch):
    fitted = []
    fit = brown_lm._fit
    monkeypatch.setattr(brown_lm, "_fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    got = score_texts(odd, "doc_id % 2 = 1", vocabulary=20, least=3, classes=5).collect()
    model = fitted[0]
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]

    def kind(word):
        if word is None:
            return model.types.count - 1
        data = word.encode()
        block = Block(range(1), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return int(model.types.of(*brown_lm._words(block)[:2])[0])

    classes = {x: int(model.member[kind(x)]) for _, t, *_ in odd_rows for x in tokens(t)}
    train = [tokens(t) for d, t, *_ in odd_rows if d is not None and d % 2 == 1]
    count = Counter(x for t in train for x in t)
    pairs = Counter((classes[a], classes[b]) for t in train for a, b in zip([None, *t], t, strict=False))
    n = len(model.transitions)
    before = Counter()
    for (a, _), m in pairs.items():
        before[a] += m
    size, words = Counter(), Counter()
    for x, m in count.items():
        size[classes[x]] += m
        words[classes[x]] += 1

    def score(t):
        chain = zip([None, *tokens(t)], tokens(t), strict=False)
        return sum(
            math.log10((pairs[classes[a], classes[b]] + 0.5) / (before[classes[a]] + 0.5 * n)) + math.log10((count[b] + 0.5) / (size[classes[b]] + 0.5 * (words[classes[b]] + 1)))
            for a, b in chain
        )

    assert Counter((r.doc_id, round(r.score, 4)) for r in got) == Counter((d, round(score(t), 4)) for d, t, *_ in odd_rows)


def test_lm_clusters_words_outside_the_core(spark):
    rng = np.random.default_rng(3)
    # All words end alike; a-words and b-words alternate, and only the two of number 0 are in the core.
    name = lambda kind: f"{kind}{max(0, int(rng.integers(-6, 40)))}xx"
    rows = [(k, " ".join(name("ab"[at % 2]) for at in range(60))) for k in range(100)]
    good = " ".join(f"a{k}xx b{k + 1}xx" for k in range(1, 31))
    bad = " ".join([f"a{k}xx" for k in range(1, 31)] + [f"b{k}xx" for k in range(2, 32)])
    docs = spark.createDataFrame([*rows, (1000, good), (1001, bad)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(docs, "doc_id < 1000", vocabulary=2).collect()}
    assert math.isclose(got[1000].base_score, got[1001].base_score)
    assert got[1000].score > got[1001].score + 10


@pytest.mark.parametrize("spread", [1, 3])
def test_lm_moves_against_brute_force_likelihood(spark, spread):
    rng = np.random.default_rng(5)
    draw = lambda: " ".join(f"w{min(int(x), 40)}" for x in rng.zipf(1.4, 30))
    texts = spark.createDataFrame([(draw(),) for _ in range(60)], "text string")
    rows = brown_lm._word_counts(texts).collect()
    types = brown_lm._Types(np.unique(np.array([r.word for r in rows if r.total >= 2], np.int64).view(np.uint64)))
    n = types.count
    bigrams = brown_lm._bigrams(texts, types, 60 * 31).cache()
    pairs = brown_lm._mapped(bigrams, np.arange(n), n)
    member = np.append(rng.integers(0, 5, n - 1), 5)

    def grid_of(classes):
        hot = np.eye(6)[classes]
        return hot.T @ pairs @ hot

    grid = brown_lm._mapped(bigrams, member, 6)
    assert pairs.sum() == 60 * 31 and (grid == grid_of(member)).all()
    moves = {}
    for turn in range(spread):
        kinds, to = brown_lm._moves(bigrams, member, grid, turn, spread)
        assert not set(moves) & set(kinds.tolist())
        moves |= dict(zip(kinds.tolist(), to.tolist(), strict=True))
    seen = np.flatnonzero(pairs.sum(axis=0)[:-1] + pairs.sum(axis=1)[:-1])
    assert set(moves) <= set(seen.tolist()) and moves and (np.diagonal(pairs)[seen] > 0).any()
    for t in seen.tolist():
        scores = []
        for c in range(5):
            moved = member.copy()
            moved[t] = c
            scores.append(brown_lm._likelihood(grid_of(moved)))
        assert scores[moves.get(t, member[t])] > max(scores) - 1e-6
        assert t not in moves or max(scores) > scores[member[t]]


@pytest.mark.parametrize("spread", [1, 2, 3, 16])
def test_lm_class_bigrams_change_by_what_moved(spark, spread, monkeypatch):
    rng = np.random.default_rng(6)
    draw = lambda: " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.3, 40))
    texts = spark.createDataFrame([(draw(),) for _ in range(80)], "text string")
    rows = brown_lm._word_counts(texts).collect()
    types = brown_lm._Types(np.unique(np.array([r.word for r in rows if r.total >= 2], np.int64).view(np.uint64)))
    n = types.count
    bigrams = brown_lm._bigrams(texts, types, 80 * 41).cache()
    member = np.append(rng.integers(0, 5, n - 1), 5).astype(np.int16)
    grid = brown_lm._mapped(bigrams, member, 6)
    for turn in range(min(spread, 3)):
        own = np.flatnonzero((brown_lm._turns(np.arange(n), spread) == turn) & (np.arange(n) < n - 1))
        moved = member.copy()
        moved[own] = rng.integers(0, 5, len(own))
        assert (brown_lm._shifted(bigrams, member, grid, moved, turn, spread) == brown_lm._mapped(bigrams, moved, 6)).all()
        read = brown_lm._of_turn(bigrams, turn, spread)
        if spread > 1 and 16 % spread == 0:
            assert read.agg(F.sum("n")).first()[0] < 0.8 * bigrams.agg(F.sum("n")).first()[0]
