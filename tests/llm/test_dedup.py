"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from sql_compare import DATA, compare

from colloquy.llm import near_dedup
from colloquy.llm import queries as Q
from colloquy.llm.near_dedup import connected_components, near_duplicates
from colloquy.llm.suffix_dedup import SuffixFamily, merged_spans, remove_repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= percent * len(s | t) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_of_odd_rows(odd, odd_rows):
    rows = [(d, t) for d, t, *_ in odd_rows]
    want, got = brute_components(rows), near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = sorted(len(shingles(t)) for _, t in rows)
    assert sorted(r.n_shingles for r in got) == sizes
    lost = [r for r in got if r.doc_id is None]
    assert {(r.component_id, r.kept) for r in lost} == {(2, False), (None, True)}


def test_near_duplicates_of_nothing(none):
    assert near_duplicates(none).count() == 0


def test_chain_of_near_copies_is_one_group(spark):
    rng = random.Random(1)
    words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[rng.randrange(200)] = f"n{k}"
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 8):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, block=block).collect()} == want


def test_pipeline_drops_copies_of_080_to_085(spark):
    rng = random.Random(6)
    rows, likeness = [], []
    for k in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(240)]
        copy = list(words)
        for at in range(10, 10 + 40 * (4 + k % 2), 40):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = (shingles(t) for _, t in rows[-2:])
        likeness.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.85 for x in likeness) == 60
    want = {d for d, c in brute_components(rows, 80).items() if d == c}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()} == want


def test_contraction_grows_in_proportion(spark, monkeypatch):
    made = []
    contract = near_dedup.contracted

    def counted(members, *a):
        members = near_dedup.checkpointed(members)
        made.append(members.count())
        return contract(members, *a)

    monkeypatch.setattr(near_dedup, "contracted", counted)
    rows = {}
    for n in (300, 600):
        rng = random.Random(8)
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts = []
        for k in range(n):
            own = list(words)
            for _ in range(2):
                own[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
            texts.append((k, " ".join(own)))
        made.clear()
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        assert near_duplicates(docs, block=256).where("component_id = 0").count() == n
        rows[n] = sum(made)
    assert rows[600] < 2.2 * rows[300] and rows[600] < 40 * 600


def test_copies_do_not_repeat_the_pairs_of_their_label(spark):
    rng, rows = random.Random(4), []
    for k in range(400):
        # Near copies of two texts under one label, and a label of its own now and then.
        base = 100 * (k % 2)
        left, right = ([base + side * 50 + x if rng.random() < 0.995 else rng.randrange(900, 920) for x in range(20)] for side in (0, 1))
        rows.append((k, 7 if k % 50 else k, sorted(set(left)), sorted({-x for x in right})))
    nodes = spark.createDataFrame(rows, "node long, label long, left array<long>, right array<long>")
    found = [tuple(r) for r in near_dedup._pairs(nodes, 8).collect()]
    want = {(label, a, b) for _, label, left, right in rows for a in left for b in right}
    assert set(found) == want
    one = spark.createDataFrame([r for r in rows if r[0] % 2 == 0], nodes.schema)
    assert near_dedup._pairs(one, 8).count() < 0.25 * sum(len(left) * len(right) for k, _, left, right in rows if k % 2 == 0)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (None, 3), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def brute_repeats(rows, n=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - n + 1):
                w = b[i : i + n]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        if d is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < d:
                    gone[i + 1 : i + n + 1] = True
        kept = bytes(x for i, x in enumerate(b) if not gone[i + 1])
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut(df):
    return [tuple(r) for r in remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def test_repeats_of_odd_rows(odd, odd_rows):
    assert sorted(map(str, cut(odd))) == sorted(map(str, brute_repeats([(d, t) for d, t, *_ in odd_rows])))


def test_repeats_of_nothing(none):
    assert cut(none) == []


def test_repeats_across_piece_bounds_and_zero_bytes(spark):
    rng = random.Random(3)
    filler = "".join(rng.choice("abcdefgh\x00 ") for _ in range(1_100_000))
    passage = filler[1_048_500:1_048_700]
    rows = [(1, filler), (2, "x" * 30 + passage + "y" * 30), (3, passage[5:56] + "\x00" * 60), (4, "q" + "\x00" * 55)]
    assert sorted(map(str, cut(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(map(str, brute_repeats(rows)))


def test_family_levels_grow_geometrically():
    family, rng = SuffixFamily(4), np.random.default_rng(2)
    seen = {}
    for doc in range(40):
        strings = np.array(["".join(x) + "\x01" for x in rng.choice(list("ab\x00"), (30, 4))], dtype="S5")
        found = family.add(strings, np.full(30, doc))
        for s, f in zip(strings, found, strict=True):
            assert f == seen.get(s, doc)
        for s in strings:
            seen.setdefault(s, doc)
    sizes = [len(x[0]) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_merged_spans():
    assert merged_spans(np.array([[5, 9], [0, 3], [3, 4], [6, 7]])).tolist() == [[0, 4], [5, 9]]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, name, Q.queries()[name], Q.oracle_sql()[name], DATA) > 0
