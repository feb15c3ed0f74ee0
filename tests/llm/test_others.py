"""Rollups, decontamination, mixing, preference formatting and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from sql_compare import DATA
from pyspark.sql import functions as F

from colloquy.llm.decontamination import greedy_tiles, leaked_items
from colloquy.llm.mixing import mix_plan, mixed_documents
from colloquy.llm.preferences import branch_pairs, conversations_from_turns, format_preferences
from colloquy.llm.token_rollup import TokenRollup, bpe_counts, changes, inserts, token_counts

COUNTS = "doc_id long, source string, lang string, tokenizer string, tokens long"


def state(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_rollup_is_signed_and_idempotent(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", None, "v1", 5), (3, "b", "en", "v1", 7)], COUNTS)
    two = spark.createDataFrame([(1, "a", "en", "v1", 12), (3, "c", "en", "v1", 7), (4, "b", "en", "v1", 1)], COUNTS)
    rollup = TokenRollup(spark, str(tmp_path))
    assert state(rollup) == {}
    assert rollup.commit("b1", inserts(one)) and not rollup.commit("b1", inserts(one))
    assert state(rollup) == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 5), ("b", "en", "v1"): (1, 7)}
    rollup.compact()
    assert rollup.commit("b2", changes(one, two)) and not rollup.commit("b2", changes(one, two))
    want = {("a", "en", "v1"): (1, 12), ("c", "en", "v1"): (1, 7), ("b", "en", "v1"): (1, 1)}
    assert state(rollup) == want
    rollup.compact()
    assert state(rollup) == want and rollup.batches() == ["b1", "b2"] and not rollup.commit("b1", inserts(one))
    with pytest.raises(ValueError):
        rollup.commit("", inserts(one))


def test_broken_and_double_commits_count_once(spark, tmp_path, monkeypatch):
    rollup = TokenRollup(spark, str(tmp_path))
    rows = inserts(spark.createDataFrame([(1, "a", "en", "v1", 10)], COUNTS))

    class Lost(Exception):
        pass

    def breaks(*a, **b):
        raise Lost

    # The totals are written, the log row is not.
    with monkeypatch.context() as m, pytest.raises(Lost):
        append = TokenRollup._append
        m.setattr(TokenRollup, "_append", lambda *a: (append(*a), breaks()))
        rollup.commit("b1", rows)
    assert rollup.batches() == [] and state(rollup) == {}
    # Two writers that both found the batch missing.
    with monkeypatch.context() as m:
        m.setattr(TokenRollup, "_table", lambda self, name, schema: spark.createDataFrame([], schema))
        assert rollup.commit("b1", rows) and rollup.commit("b1", rows)
    assert rollup.batches() == ["b1"] and state(rollup) == {("a", "en", "v1"): (1, 10)}
    rollup.compact()
    assert state(rollup) == {("a", "en", "v1"): (1, 10)} and not rollup.commit("b1", rows)


def test_changes_of_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a", "en", "v", 3), (1, "a", "en", "v", 5), (None, "a", "en", "v", 1)], COUNTS)
    two = spark.createDataFrame([(1, "a", "en", "v", 3), (1, "b", "en", "v", 5), (None, "a", "en", "v", 2)], COUNTS)
    got = sorted(map(str, (tuple(r) for r in changes(one, two).collect())))
    assert got == sorted(map(str, [("a", "en", "v", 5, None), ("b", "en", "v", None, 5), ("a", "en", "v", 1, 2)]))


def test_counts_of_odd_rows(spark, odd, odd_rows, none, tmp_path):
    counts = token_counts(odd, "words-1")
    assert sorted(r.tokens for r in counts.collect()) == sorted(len((t or "").split()) for _, t, *_ in odd_rows)
    rollup = TokenRollup(spark, str(tmp_path))
    rollup.commit("none", inserts(token_counts(none, "pieces-1")))
    assert state(rollup) == {}


def test_byte_pair_counts(odd):
    P = pytest.importorskip("public_tokenizers")
    got = bpe_counts(odd, "bpe-50k", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == odd.count() and {r.tokens for r in got if r.doc_id in (3, 4)} == {0}


def test_tiles_are_greedy_and_reordered(spark):
    item = "a1 a2 a3 a4 a5 a6 b1 b2 b3 b4 b5 b6 c1 c2"
    rows = [
        (1, f"x y z b1 b2 b3 b4 B5 b6 q q A1 a2 a3 a4 a5 a6 z"),
        (2, "a1 a2 a3 q a4 a5 a6 q b1 b2 b3"),
        (3, None),
        (4, ""),
        (None, item),
        (5, item + " " + item),
        (6, "short one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "size", "block")})
    items = spark.createDataFrame([(7, item), (8, "Short ONE"), (9, None), (10, " "), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in leaked_items(docs, items).collect()}
    assert got == {(1, 7): (12, 2), (None, 7): (14, 1), (5, 7): (14, 1), (6, 8): (2, 1)}
    assert got == {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in leaked_items(docs, items, block_bytes=20).collect()}
    assert leaked_items(docs, items.limit(0)).count() == 0 and leaked_items(docs.limit(0), items).count() == 0


def brute_tiles(item, doc, match):
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and a + k not in used_i and b + k not in used_d:
                    k += 1
                if k >= match and (best is None or (-k, a, b) < best):
                    best = (-k, a, b)
        if best is None:
            return tiles
        k, a, b = -best[0], best[1], best[2]
        used_i.update(range(a, a + k))
        used_d.update(range(b, b + k))
        tiles.append((a, b, k))


def test_tiles_match_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        item, doc = ([rng.randrange(4) for _ in range(n)] for n in (18, 30))
        pairs = [(a, b) for a in range(16) for b in range(28) if item[a : a + 3] == doc[b : b + 3]]
        found = greedy_tiles(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), 3)
        assert found == brute_tiles(item, doc, 3)


def test_mix_of_odd_rows(odd, none):
    rows = mix_plan(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert Counter(mix_plan(odd).collect()) == Counter(rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-6
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own)
    assert mix_plan(none).count() == 0 and mixed_documents(none).count() == 0
    mixed = mixed_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert [r.mix_finish for r in mixed] == sorted(r.mix_finish for r in mixed)


def test_preferences(spark):
    turns = "array<struct<role:string,text:string>>"
    a = [("user", "hi"), ("assistant", "one"), ("user", "more"), ("assistant", "two")]
    b = [*a[:3], ("assistant", "2"), ("user", None)]
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, a), (4, a, a[:2]), (None, [], [])], f"pair_id long, chosen {turns}, rejected {turns}").withColumn("prompt", F.lit("x"))
    got = {r.pair_id: r for r in format_preferences(pairs).collect()}
    r = got[1]
    assert r.prefix_turns == 3 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\none<|end|>\n<|user|>\nmore<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["two<|end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["2<|end|>\n"]
    assert (got[2].prefix_turns, got[2].chosen, got[2].rejected) == (4, "", "")
    assert got[3].prefix_turns == 0 and got[3].chosen == "" and got[3].rejected.count("<|end|>") == 4
    assert got[4].prefix_turns == 2 and got[4].rejected == "" and got[None].prompt == ""


def test_conversations_with_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (0, 0, None, None), (0, 1, "assistant", "c"), (None, 0, "user", "x"), (3, 0, "user", "alone")]
    talks = conversations_from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: len(r.turns) for r in talks.collect()} == {1: 3, 0: 2, 3: 1}
    pairs = {r.pair_id: r for r in branch_pairs(talks).collect()}
    said = lambda turns: [t.text for t in turns]
    assert {k: (said(r.chosen), said(r.rejected)) for k, r in pairs.items()} == {0: (["", "c"], ["a", "b", "b"]), 1: (["a", "b", "b"], ["a", "c"]), 3: (["alone"], [])}
    assert format_preferences(branch_pairs(talks.limit(0))).count() == 0


def test_branches_part_at_different_depths(spark):
    talks = conversations_from_turns(spark.read.parquet(f"{DATA}/conversations.parquet"))
    got = format_preferences(branch_pairs(talks)).collect()
    assert len(got) == talks.count() and len({r.prefix_turns for r in got}) > 2


def test_benchmark_blocks_and_pieces_agree(spark, monkeypatch):
    from colloquy.llm import decontamination

    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(30)}" for _ in range(n))
    items = [(k, text(12)) for k in range(20)]
    docs = [(k, " ".join([text(40), items[k % 20][1], text(40)])) for k in range(50)] + [(99, "v1 " * 300)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (50, "v1 " * 40)], "item_id long, text string")
    whole = Counter(leaked_items(docs, items).collect())
    assert whole == Counter(leaked_items(docs, items, block_bytes=100).collect()) and len(whole) >= 51
    # A closure refers to the module's constant by name, so tasks see a small limit only here.
    hit, n, of = np.arange(6), np.array([1, 5, 2, 2, 9, 1]), np.array([0, 0, 1, 2, 3, 4])
    monkeypatch.setattr(decontamination, "PAIRS", 7)
    pieces = list(decontamination._pieces(hit, n, of))
    assert [p.tolist() for p in pieces] == [[0, 1], [2, 3], [4], [5]]


def test_pipeline_stages_keep_contract(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= left
        left = n
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs.select(*corpus_pipeline.COLUMNS), DATA).count() <= 2 * docs.count()


def test_pipeline_stages_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    prose = lambda n=120: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows_of = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    def staged(stage, rows):
        return rows_of(stage(spark, spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema), DATA))

    a, b, c, d, e = (prose() for _ in range(5))
    near = lambda t: t + " tail"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (7, d), (8, near(c)), (9, e), (9, e), (None, "")]
    got = staged(corpus_pipeline.near_dedup, rows)
    assert got[None, b] + got[None, near(b)] == 1
    del got[None, b], got[None, near(b)]
    assert got == Counter([(1, a), (7, c), (7, d), (9, e), (9, e), (None, "")])

    one, two = prose(20), prose(20)
    rows = [(1, one + " " + two), (5, a + one), (5, a + one), (5, b + two), (None, c + one), (None, c + one)]
    got = staged(corpus_pipeline.repeated_passages, rows)
    assert got == Counter([(1, one + " " + two), (5, a), (5, a), (5, b), (None, c + one), (None, c + one)])

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").orderBy(F.length("text").desc(), "item_id").first().text
    rows = [(None, item), (None, a), (5, item), (5, b), (6, c), (6, c)]
    assert staged(corpus_pipeline.decontaminate, rows) == Counter([(None, a), (5, b), (6, c), (6, c)])

    from colloquy.llm.quality_knn import fit_quality, score_quality

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = rows_of(corpus_pipeline.quality(spark, docs, DATA))
    assert kept == rows_of(docs.join(score_quality(docs, fit_quality(docs, labels.where(corpus_pipeline._fold(3) != 1).withColumnRenamed("quality", "label"))).where("predicted = 1"), "doc_id", "left_semi"))
    # The third of the rows whose id is lost, and those that share an id, fare as their texts do.
    base = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select(*corpus_pipeline.COLUMNS)
    good = {t for _, t in kept}
    lost = base.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, -1 - F.col("doc_id") % 2))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(*corpus_pipeline.COLUMNS)
    got = rows_of(corpus_pipeline.quality(spark, known.unionAll(lost), DATA).where("doc_id is null or doc_id < 0"))
    assert got == Counter({k: n for k, n in rows_of(lost).items() if k[1] in good}) and None in {k[0] for k in got}
