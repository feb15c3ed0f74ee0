"""A store of meetings that batches are written to: several tables, one commit, and nothing twice.

A batch writes its rows of every table under a name of its own, the attempt, and then one row to the log.
Only attempts that the log names are read. So a write that breaks off between two tables counts for nothing
and can be repeated; a batch that the log names isn't written again; of two writers of one batch, the
attempt of least name counts; and a meeting that two batches bring is that of the batch first begun.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ingest import customer_key, meeting_key

__all__ = ["MeetingStore", "keyed"]

_LOG = "batch string, began long, attempt string"


def keyed(meetings: DataFrame) -> DataFrame:
    """Adds customer_key and meeting_key to meetings (organisation, customer, title, meeting_date, text, ..).

    A customer is one by organisation and name, whatever the case and the blanks around it; a meeting by its
    customer, title, date and text. Nulls count as empty.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    owner = customer_key(empty("organisation"), empty("customer"))
    return meetings.withColumn("customer_key", owner).withColumn("meeting_key", meeting_key(F.concat_ws("\x1f", owner, empty("title")), F.col("meeting_date"), F.col("text")))


class MeetingStore:
    """Tables customers, meetings and any others by meeting, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read
            return (reader.schema(schema) if schema else reader.option("mergeSchema", "true")).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema) if schema else None

    def _write(self, rows: DataFrame, name: str, attempt: str) -> None:
        """Every attempt has a folder of its own, so writers at the same time don't meet."""
        rows.write.parquet(f"{self.folder}/{name}/attempt={attempt}")

    def _log(self) -> DataFrame:
        """The attempt that counts of each batch, and its place in the order of batches."""
        one = self._read("log", _LOG).groupBy("batch").agg(F.min(F.struct("attempt", "began")).alias("a"))
        return one.select("batch", "a.attempt", F.struct("a.began", "a.attempt").alias("place"))

    def batches(self) -> list[str]:
        """The names of committed batches."""
        return sorted(r["batch"] for r in self._log().select("batch").collect())

    def _committed(self, name: str) -> DataFrame | None:
        rows = self._read(name)
        return None if rows is None else rows.join(F.broadcast(self._log().drop("batch")), "attempt")

    def ingest(self, batch: str, meetings: DataFrame, others: dict[str, DataFrame] | None = None) -> bool:
        """Writes a batch of :func:`keyed` meetings and of tables that have a meeting_key; False if it was there.

        Meetings that the store has, and rows of meetings that aren't in the batch, are left out; of rows that
        repeat a meeting one is written. The customers of all the batch's meetings are upserted.
        """
        if not batch or {"customers", "meetings", "log"} & set(others or {}):
            raise ValueError("a batch needs a name, and tables names of their own")
        log = self._read("log", _LOG)
        if not log.where(F.col("batch") == batch).isEmpty():
            return False
        began = log.count()
        attempt = f"of-{uuid.uuid4().hex}"
        held = self._committed("meetings")
        fresh = meetings.dropDuplicates(["meeting_key"])
        if held is not None:
            fresh = fresh.join(held.select("meeting_key").distinct(), "meeting_key", "left_anti")
        about = [c for c in ("organisation", "customer", "segment") if c in meetings.columns]
        self._write(meetings.groupBy("customer_key").agg(F.min(F.struct(*about)).alias("c")).select("customer_key", "c.*"), "customers", attempt)
        self._write(fresh, "meetings", attempt)
        keys = self._read("meetings").where(F.col("attempt") == attempt).select("meeting_key")
        for name, rows in (others or {}).items():
            self._write(rows.join(keys, "meeting_key", "left_semi"), name, attempt)
        self.spark.createDataFrame([(batch, began)], "batch string, began long").coalesce(1).write.parquet(f"{self.folder}/log/attempt={attempt}")
        return True

    def _winners(self) -> DataFrame | None:
        """The attempt whose row of a meeting counts: that of the batch first begun."""
        rows = self._committed("meetings")
        return None if rows is None else rows.groupBy("meeting_key").agg(F.min("place").alias("place"))

    def meetings(self) -> DataFrame | None:
        """Meetings, each once; None before the first commit."""
        return self.table("meetings")

    def table(self, name: str) -> DataFrame | None:
        """Rows of a table that belong to meetings as they count; None before the first commit."""
        rows = self._committed(name)
        if rows is None:
            return None
        return rows.join(self._winners(), ["meeting_key", "place"], "left_semi").drop("place", "attempt")

    def customers(self) -> DataFrame | None:
        """Customers, each once, as the batch begun last has them, with the number of their meetings."""
        rows = self._committed("customers")
        if rows is None:
            return None
        about = [c for c in rows.columns if c not in ("customer_key", "attempt", "place")]
        last = rows.groupBy("customer_key").agg(F.max_by(F.struct(*about), "place").alias("c")).select("customer_key", "c.*")
        counts = self._winners().join(self._read("meetings").select("meeting_key", "customer_key").distinct(), "meeting_key").groupBy("customer_key").agg(F.count("*").alias("meetings"))
        return last.join(counts, "customer_key", "left").fillna(0, ["meetings"])
