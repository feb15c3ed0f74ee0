"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.storage import checkpointed, ensure_checkpoint_dir
from colloquy.llm.brown_lm import score_texts
from colloquy.llm.decontamination import leaked_items
from colloquy.llm.fill_in_middle import fill_in_middle, restored_text
from colloquy.llm.filter_audit import filter_interactions
from colloquy.llm.language_id import fit_languages, identify_languages
from colloquy.llm.mixing import mix_plan
from colloquy.llm.near_dedup import near_duplicates
from colloquy.llm.pii import KINDS, find_personal_data, fit_pii
from colloquy.llm.preferences import branch_pairs, conversations_from_turns, format_preferences
from colloquy.llm.quality_knn import fit_quality, score_quality
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.suffix_dedup import remove_repeats
from colloquy.llm.token_rollup import TOKENIZERS, TokenRollup, changes, inserts, pattern_tokens

__all__ = ["oracle_sql", "queries"]

WORDS = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = rf"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN array_to_string(w, ' ')
      ELSE unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM toks)
  WHERE s IS NOT NULL
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.d FROM reach r JOIN (SELECT a AS c, b AS d FROM links UNION ALL SELECT b, a FROM links) e ON e.c = r.seen
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(seen) AS component_id, d.doc_id = min(seen) AS kept
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM b)),
firsts AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
hit AS (SELECT doc_id, p FROM win JOIN firsts USING (w) WHERE m < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 50 AS e
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM runs
  UNION ALL SELECT b.doc_id, coalesce(max(e), 0), max(n) FROM b LEFT JOIN runs USING (doc_id) GROUP BY b.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k FROM gaps JOIN b USING (doc_id) GROUP BY doc_id
), total AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][source_no % 3 + 1] AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (SELECT ratio, source_no, level FROM l WHERE level <= ratio ORDER BY ratio, source_no LIMIT 1),
t AS (
  SELECT l.source, l.source_size, l.source_no,
    CASE WHEN f.ratio IS NULL OR (l.ratio, l.source_no) < (f.ratio, f.source_no) THEN l.cap::DOUBLE ELSE f.level * l.weight END AS target
  FROM l LEFT JOIN f ON true
), q AS (
  SELECT doc_id, size, source_size, target, source_no, key,
    sum(size) OVER (PARTITION BY source_no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (copy * source_size + cum)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1]) AS copy) WHERE size > 0
), cut AS (
  SELECT doc_id, copy, sum(size) OVER (ORDER BY finish, source_no, copy, key, doc_id, size ROWS UNBOUNDED PRECEDING)
    <= (SELECT sum(target) FROM t) AS inside FROM c
), n AS (SELECT doc_id, count(*) AS copies FROM cut WHERE inside GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(copies, 0) AS BIGINT) AS taken FROM q LEFT JOIN n ON n.doc_id = q.doc_id
"""


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches of all documents: inserts, committed twice; copies deleted; digits blanked.

    Texts are read once, for their digest and all counts before and after the revision.
    """
    text = F.col("text")
    blanked = F.regexp_replace(text, "[0-9]+", " ")
    counts = F.array(*(F.struct(F.lit(v).alias("tokenizer"), pattern_tokens(text, v).alias("tokens"), pattern_tokens(blanked, v).alias("revised")) for v in TOKENIZERS))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5(text.cast("binary")).alias("digest"), counts.alias("counts"))
    docs = checkpointed(docs)
    firsts = docs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = docs.join(firsts, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)))
    rows = checkpointed(marked.select("doc_id", "source", "lang", "copy", F.inline("counts")))
    rollup = TokenRollup(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("all", inserts(rows))
    rollup.commit("all", inserts(rows))
    gone = rows.where("copy").select("source", "lang", "tokenizer", F.col("tokens").alias("old_tokens"), F.lit(None).cast("long").alias("new_tokens"))
    rollup.commit("copies", gone)
    rollup.compact()
    left = rows.where("not copy")
    rollup.commit("blanked", changes(left, left.withColumn("tokens", F.col("revised"))))
    return rollup.totals()


OP2_SQL = rf"""
WITH d AS (
  SELECT source, lang, regexp_replace(text, '[0-9]+', ' ', 'g') AS text FROM documents
  QUALIFY text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY md5(documents.text))
), t AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS n FROM d
  UNION ALL
  SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '{TOKENIZERS["pieces-1"]}')), 0) FROM d
)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY source, lang, tokenizer
"""


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs, labels)
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), ",")


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = branch_pairs(conversations_from_turns(_table(spark, sf_dir, "conversations")))
    rows = format_preferences(pairs)
    return rows.withColumns({c: _span_text(c) for c in ("chosen_spans", "rejected_spans")})


OP8_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, conv_id % count(*) OVER (PARTITION BY conv_id) AS depth
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT conv_id, place, role, text FROM own WHERE place < depth
  UNION ALL
  SELECT d.conv_id, o.place, o.role, o.text FROM own o JOIN (SELECT DISTINCT conv_id, depth FROM own) d ON o.conv_id = xor(d.conv_id, 1) AND o.place >= d.depth
), split AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
    coalesce(min(coalesce(c.place, r.place)) FILTER (WHERE (c.role, c.text) IS DISTINCT FROM (r.role, r.text)), count(*)) AS rest_from
  FROM own c FULL JOIN r ON c.conv_id = r.conv_id AND c.place = r.place GROUP BY 1
), both_sides AS (
  SELECT 'c' AS side, conv_id, place, role, text FROM own UNION ALL SELECT 'r', conv_id, place, role, text FROM r
), w AS (
  SELECT b.*, place >= rest_from AS rest, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn_text, length(text) + 8 AS trained
  FROM both_sides b JOIN split USING (conv_id)
), s AS (
  SELECT *, sum(CASE WHEN rest THEN length(turn_text) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY place) AS stop FROM w
)
SELECT conv_id AS pair_id, CAST(count(*) FILTER (WHERE side = 'c' AND NOT rest) AS BIGINT) AS prefix_turns,
  coalesce(string_agg(turn_text, '' ORDER BY place) FILTER (WHERE side = 'c' AND NOT rest), '') AS prompt,
  coalesce(string_agg(turn_text, '' ORDER BY place) FILTER (WHERE side = 'c' AND rest), '') AS chosen,
  coalesce(string_agg(turn_text, '' ORDER BY place) FILTER (WHERE side = 'r' AND rest), '') AS rejected,
  coalesce(string_agg((stop - trained) || '-' || stop, ',' ORDER BY place) FILTER (WHERE side = 'c' AND rest AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((stop - trained) || '-' || stop, ',' ORDER BY place) FILTER (WHERE side = 'r' AND rest AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id
"""


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(_fold(5) != 0))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"), s.lang)), ",")
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def op10_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    held_out = F.coalesce(_fold(5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM d
), l AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), k AS (
  SELECT part, m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, s, 1 << (ascii(substr(o, s, 1)) - 65) AS b,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS prior
  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders)
), c AS (
  SELECT part, o, s, b,
    sum(CASE WHEN m & (prior | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN m & prior = 0 AND m & b > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN m & prior > 0 AND m & b > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN m = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN m & prior = 0 AND m & b > 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN m & prior = 0 AND m & b > 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM k, steps GROUP BY part, o, s, b
)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM c
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(_table(spark, sf_dir, "documents"))
    shas = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored_text("output", "form"), 256)}
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(c.alias(k) for k, c in shas.items()))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), g AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS s
  FROM g
), o AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS out FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(out) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit_pii(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_token_rollup": op2_token_rollup,
        "op3_quality_neighbours": op3_quality_neighbours,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_benchmark_leaks": op6_benchmark_leaks,
        "op7_weighted_fair_mix": op7_weighted_fair_mix,
        "op8_preference_pairs": op8_preference_pairs,
        "op9_language_spans": op9_language_spans,
        "op10_brown_class_lm": op10_brown_class_lm,
        "op11_filter_interactions": op11_filter_interactions,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op2_token_rollup": OP2_SQL,
        "op5_suffix_array_dedup": OP5_SQL,
        "op7_weighted_fair_mix": OP7_SQL,
        "op8_preference_pairs": OP8_SQL,
        "op11_filter_interactions": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
    }
