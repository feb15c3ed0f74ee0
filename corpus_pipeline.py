"""The corpus pipeline: from raw documents to a deduplicated, decontaminated training mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; a runner may write each result and read it again. All stages but the last return the
columns of ``documents``.

Stages put decisions back on rows by :data:`ROW_KEY`, a digest of id and text, so rows with a null id and
texts that share an id are judged one by one. Rows that repeat both id and text share one fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.decontamination import leaked_items
from colloquy.llm.mixing import mixed_documents
from colloquy.llm.near_dedup import near_duplicates
from colloquy.llm.quality_knn import fit_quality, score_quality
from colloquy.llm.suffix_dedup import remove_repeats

#: SQL for the rows of :func:`run`; none, as the first stage learns a model and later ones search by hash.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Least similarity of near copies. With 20 + 20 halves about 5 in 100,000 pairs of 0.80 meet in no table.
NEAR_PERCENT = 80
NEAR_HALVES = 20

#: One number for the id, which may be null, and the text of a row.
ROW_KEY = "row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW_KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1 stay.

    Each row is judged by its own text, whatever its id. A null id has no label.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(3) != 1)
    model = fit_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))
    keyed = _keyed(docs)
    good = score_quality(keyed, model, id_col=ROW_KEY).where("predicted = 1").select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return keyed.join(good, ROW_KEY, "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies stays.

    Near copies have a similarity of 0.8 or more on shingles of five words. A null id comes after all
    others, so of a group of null ids only one text stays; of texts that share the least id of their group
    one stays. Ties go to the least row key. Texts without a word are copies of nothing.
    """
    keyed = _keyed(docs)
    groups = near_duplicates(keyed, id_col=ROW_KEY, percent=NEAR_PERCENT, halves=NEAR_HALVES)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", ROW_KEY)).alias("first")
    # Both sides have a row for each document, and a key names one id and one group.
    ids = keyed.select(ROW_KEY, F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("group"))
    both = ids.unionAll(groups.select(F.col("doc_id").alias(ROW_KEY), F.lit(None).cast("long").alias("doc_id"), F.col("component_id").alias("group")))
    both = both.groupBy(ROW_KEY).agg(F.max("doc_id").alias("doc_id"), F.max("group").alias("group"))
    kept = both.groupBy("group").agg(first).select(F.col(f"first.{ROW_KEY}").alias(ROW_KEY))
    return keyed.join(kept, ROW_KEY, "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that an earlier document has are cut; documents left without a word go.

    A cut character at a passage's edge is dropped. ``n_chars`` follows the text. A null id is neither
    earlier nor later than another, so its text is left whole and cuts no other. Texts that share an id are
    cut by smaller ids only, each by its own passages; rows are never multiplied.
    """
    cut = remove_repeats(docs).where("n_removed > 0").dropDuplicates(["doc_id", "text_key"])
    cut = cut.select("doc_id", "text_key", F.try_validate_utf8(F.col("kept").cast("string")).alias("whole"), "kept")
    cut = cut.select("doc_id", "text_key", F.coalesce("whole", F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")).alias("rest"))
    text = F.coalesce("rest", "text")
    keyed = docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(cut, ["doc_id", "text_key"], "left").withColumn("text", text).where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by its own text, with a null or shared id too."""
    keyed = _keyed(docs)
    leaked = leaked_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW_KEY).select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return keyed.join(leaked, ROW_KEY, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order by source weights, once for each copy that the mix takes.

    Null ids are ordered under one digest, by size; rows that repeat both id and text are one
    document, and texts that share an id are each their own.
    """
    return mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
