"""Token counts as delta-maintained totals by source, language and tokenizer version."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.functions.storage import checkpointed

__all__ = ["TOKENIZERS", "TokenRollup", "bpe_counts", "changes", "inserts", "pattern_tokens", "token_counts"]

#: Tokenizer versions that are patterns: a text has as many tokens as the pattern has matches.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]",
}
KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, documents long, tokens long, attempt string"
_LOG = "batch string, attempt string, snapshot string"


def pattern_tokens(text: Column, tokenizer: str) -> Column:
    """How many tokens of a pattern tokenizer ``text`` has; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def token_counts(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, source, lang, tokenizer, tokens of every whole text (null: 0 tokens)."""
    tokens = pattern_tokens(F.col(text_col), tokenizer)
    return documents.select(F.col(id_col).alias("doc_id"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"))


def bpe_counts(documents: DataFrame, tokenizer: str, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`token_counts`, with a byte-pair vocabulary of ranks at ``path`` (on every executor).

    ``pattern`` splits a text before merging; ``tokenizer`` names the version in the totals.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(tokenizer, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [len(encoding.encode_ordinary(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    kinds = StructType([docs.schema["doc_id"], docs.schema["source"], docs.schema["lang"]])
    counted = docs.mapInArrow(count, StructType([*kinds.fields, *StructType.fromDDL("tokens long").fields]))
    return counted.withColumn("tokenizer", F.lit(tokenizer)).select("doc_id", "source", "lang", "tokenizer", "tokens")


def inserts(counts: DataFrame) -> DataFrame:
    """The changes that add every row of ``counts``."""
    return counts.select(*KEYS, F.lit(None).cast("long").alias("old_tokens"), F.col("tokens").alias("new_tokens"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes from one state of counts to another, by (doc_id, tokenizer).

    A document only in ``before`` is deleted, one only in ``after`` inserted; one in both is revised,
    and moves between totals when its source or language changed. Equal rows give no change. Rows that
    repeat a key are matched one to one, in order of source, language and count; a null id is a key.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "tokenizer").orderBy("source", "lang", "tokens"))
    key = ("doc_id", "tokenizer", "place")
    old = before.select(F.col("doc_id").alias("doc_id_"), F.col("tokenizer").alias("tokenizer_"), place.alias("place_"), F.struct("source", "lang", "tokens").alias("old"))
    new = after.select("doc_id", "tokenizer", place.alias("place"), F.struct("source", "lang", "tokens").alias("new"))
    both = old.join(new, [F.col(f"{c}_").eqNullSafe(F.col(c)) for c in key], "full")
    both = both.select(F.coalesce("tokenizer_", "tokenizer").alias("tokenizer"), "old", "new").where(~F.col("old").eqNullSafe(F.col("new")))
    same = F.col("old.source").eqNullSafe(F.col("new.source")) & F.col("old.lang").eqNullSafe(F.col("new.lang"))
    none = F.lit(None).cast("long")

    def row(of: str, old_tokens: Column, new_tokens: Column) -> Column:
        return F.struct(F.col(f"{of}.source").alias("source"), F.col(f"{of}.lang").alias("lang"), old_tokens.alias("old_tokens"), new_tokens.alias("new_tokens"))

    removed = F.when(F.col("old").isNotNull(), row("old", F.col("old.tokens"), none))
    added = F.when(F.col("new").isNotNull(), row("new", none, F.col("new.tokens")))
    revised = F.array(row("new", F.col("old.tokens"), F.col("new.tokens")))
    rows = F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & same, revised).otherwise(F.array_compact(F.array(removed, added)))
    return both.select("tokenizer", F.explode(rows).alias("r")).select("r.source", "r.lang", "tokenizer", "r.old_tokens", "r.new_tokens")


class TokenRollup:
    """Totals under a folder that all executors share: a table of signed totals and a log.

    A commit appends a batch's totals under a name of its own, the attempt, and then a row to the log. Only
    what the log names counts: a write that broke off before its log row counts for nothing, and its batch
    can be committed again. A batch that the log names is never written again; where two writers committed
    one batch at once, the attempt of least name counts. A snapshot is an attempt that holds all totals so
    far; with it the log gets one row for each batch in it, so reading costs the snapshot and the batches
    since.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame:
        """The attempt of each batch, and the last snapshot that holds it."""
        rows = self._table("log", _LOG)
        return rows.groupBy("batch").agg(F.min("attempt").alias("attempt"), F.max("snapshot").alias("snapshot"))

    def batches(self) -> list[str]:
        """The names of committed batches."""
        return sorted(r["batch"] for r in self._log().select("batch").collect())

    def _append(self, totals: DataFrame, attempt: str) -> None:
        totals.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{self.folder}/totals")

    def commit(self, batch: str, batch_changes: DataFrame) -> bool:
        """Add a batch of changes (source, lang, tokenizer, old_tokens, new_tokens); False if it was there.

        A null old count is an insert, a null new count a delete, both set a revision, both null nothing.
        Only the batch's totals are written: partial sums first, a row per key and batch at last.
        """
        if not batch:
            raise ValueError("a batch needs a name")
        if not self._table("log", _LOG).where(F.col("batch") == batch).isEmpty():
            return False
        present = lambda c: F.col(c).isNotNull().cast("long")
        tokens = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
        signed = batch_changes.groupBy(*KEYS).agg(
            F.sum(present("new_tokens") - present("old_tokens")).alias("documents"), F.sum(tokens).cast("long").alias("tokens")
        )
        attempt = f"batch-{uuid.uuid4().hex}"
        self._append(signed, attempt)
        self.spark.createDataFrame([(batch, attempt, None)], _LOG).write.mode("append").parquet(f"{self.folder}/log")
        return True

    def _parts(self, log: DataFrame) -> DataFrame:
        """Signed totals to add up: the last snapshot, and the batches that it doesn't hold."""
        last = log.agg(F.max("snapshot")).first()[0]
        new = log.where(F.lit(last is None) | ~F.col("snapshot").eqNullSafe(last)).select("attempt")
        wanted = new if last is None else new.unionAll(self.spark.createDataFrame([(last,)], "attempt string"))
        return self._table("totals", _TOTALS).join(wanted, "attempt", "left_semi")

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return total.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Columns source, lang, tokenizer, documents, tokens; keys whose documents are all gone have no row."""
        return self._summed(self._parts(self._log()))

    def compact(self) -> None:
        """Fold every committed batch into a new snapshot."""
        log = checkpointed(self._log())
        if log.isEmpty():
            return
        before = self._table("log", _LOG).agg(F.count_distinct("snapshot")).first()[0]
        snapshot = f"snapshot-{before:08d}-{uuid.uuid4().hex}"
        self._append(self._summed(self._parts(log)), snapshot)
        log.select("batch", "attempt", F.lit(snapshot).alias("snapshot")).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
