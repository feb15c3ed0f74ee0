"""Sinks of one file a batch: the report of a batch, read by people and spreadsheets.

Tasks write their lines under an attempt of their own; the commit joins the committed attempts' files in
order of partitions into one file beside the target and puts it in its place. A failing task or job leaves
nothing but what stood there before; a lost task's second attempt doesn't double its lines.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from colloquy.operators.ingest import csv_line

__all__ = ["ReportSource", "write_report"]

#: What marks a file as UTF-8 for spreadsheets.
MARK = "\ufeff"


@dataclass
class _Written(WriterCommitMessage):
    """The file of one task's lines, by the number of its partition."""

    partition: int
    path: str


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str, header: str) -> None:
        self.path, self.header = path, header
        self.parts = f"{path}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        part = f"{self.parts}/{context.partitionId()}-{context.taskAttemptId()}"
        with open(part, "w", encoding="utf-8", newline="") as out:
            for row in rows:
                out.write(f"{row[0]}\r\n")
        return _Written(context.partitionId(), part)

    def commit(self, messages: list) -> None:
        whole = f"{self.parts}.whole"
        with open(whole, "wb") as out:
            out.write(f"{MARK}{self.header}\r\n".encode())
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{self.parts}.whole")


class ReportSource(DataSource):
    """Format ``report``: one column of lines, options ``path`` (a folder that all share) and ``header``."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> _ReportWriter:
        return _ReportWriter(self.options["path"], self.options.get("header", ""))


def write_report(rows: DataFrame, path: str, order: list[str], separator: str = ";") -> None:
    """Writes ``rows`` as one CSV file: byte order mark, header, then the rows by ``order``, nulls empty.

    Rows are sorted by range, so any number of tasks write; only the joining of their files is one stream.
    Without rows the file has its header. The file takes the place of an earlier one when it is whole.
    """
    rows.sparkSession.dataSource.register(ReportSource)
    header = separator.join(rows.columns)
    lines = rows.orderBy(*order).select(csv_line([F.col(c) for c in rows.columns], separator).alias("line"))
    lines.write.format("report").mode("append").option("path", path).option("header", header).save()
