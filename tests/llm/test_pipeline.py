"""The pipeline as a whole against plain Python, over all rows of the smallest tables and planted ones."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F
from sql_compare import DATA
from test_dedup import brute_components
from test_others import brute_tiles

from colloquy.llm.quality_knn import fit_quality, score_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text)]


def brute_passages(rows, n=50):
    """Texts without the characters of which a byte is in an n-byte string that starts in a smaller id."""
    first, out = {}, {}
    for d, text in rows.items():
        b = text.encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    for d, text in rows.items():
        b = text.encode()
        gone = {k for i in range(len(b) - n + 1) if first[b[i : i + n]] < d for k in range(i, i + n)}
        rest = bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")
        if lower(rest):
            out[d] = rest
    return out


def brute_leaks(rows, items, match=4):
    def seeds(words):
        return {tuple(words[i : i + match]) for i in range(len(words) - match + 1)}

    leaked = set()
    for d, text in rows.items():
        words = lower(text)
        own = seeds(words)
        for item in map(lower, items):
            if own & seeds(item) and 2 * sum(k for _, _, k in brute_tiles(item, words, match)) >= len(item):
                leaked.add(d)
                break
    return leaked


def brute_mix(rows, source):
    """(doc_id, copy) up to the budget, in the order of virtual finish times, then ids."""
    size = {d: len(WORDS.findall(t)) for d, t in rows.items()}
    names = sorted({source[d] for d in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in rows if source[d] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2.0 * total[s] for s in full)
        open_ -= full
        if not full or not open_:
            break
    target |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    queue, so_far = [], dict.fromkeys(names, 0)
    for d in sorted(rows, key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest()[:15], d)):
        s = source[d]
        so_far[s] += size[d]
        queue += [((copy * total[s] + so_far[s]) / target[s], names.index(s), copy, d) for copy in (0, 1)]
    out, words = [], 0
    for finish, _, copy, d in sorted(queue):
        words += size[d]
        if words > sum(target.values()):
            break
        out.append((finish, d, copy))
    return [(d, copy) for _, d, copy in sorted(out)]


def planted(spark, folder):
    """The smallest tables with five more documents made of clean ones, written to ``folder``."""
    docs, labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    clean = docs.join(labels.where("quality = 1"), "doc_id").where("length(text) between 1500 and 4000").orderBy("doc_id").limit(5).collect()
    last = docs.agg(F.max("doc_id")).first()[0]
    item = items.where("text is not null").orderBy(F.length("text").desc(), "item_id").first().text
    words = [r.text.split(" ") for r in clean]
    nearly = [w if k % 60 != 30 else "changed" for k, w in enumerate(words[0])]
    texts = [" ".join(nearly), clean[1].text, " ".join(words[2][: len(words[2]) // 2] + words[3][: len(words[3]) // 3]), " ".join(words[3][::-1]) + " " + item, " ".join(words[4][::-1]) + " é€😀"]
    rows = [(last + 1 + k, t, "en", clean[k].source, len(t)) for k, t in enumerate(texts)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(*corpus_pipeline.COLUMNS).unionByName(more).write.parquet(f"{folder}/documents.parquet")
    for name, table in (("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{folder}/{name}.parquet")
    return [r for r in items.collect() if r.text is not None]


def test_pipeline_matches_plain_python(spark, tmp_path):
    items = planted(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    taught = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id", F.col("quality").alias("label"))
    good = {r.doc_id for r in score_quality(docs, fit_quality(docs, taught)).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    left = [len(rows)]

    texts = {d: r.text or "" for d, r in rows.items() if d in good}
    left.append(len(texts))
    texts = {d: texts[d] for d, c in brute_components(list(texts.items()), 80).items() if d == c}
    left.append(len(texts))
    before, texts = texts, brute_passages(texts)
    assert any(before[d] != t for d, t in texts.items())
    gone = brute_leaks(texts, [r.text for r in items])
    assert gone
    texts = {d: t for d, t in texts.items() if d not in gone}
    assert left[0] > left[1] > left[2] > len(texts) > 0
    want = brute_mix(texts, {d: r.source for d, r in rows.items()})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.mix_copy) for r in got] == want
    for r in got:
        assert r.text == texts[r.doc_id] and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
