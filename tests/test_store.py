"""Batches of meetings: crashes between tables, two writers, repeats and overlapping batches."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from colloquy.operators.store import MeetingStore, keyed


def batch(spark, rows):
    return keyed(spark.createDataFrame(rows, "organisation string, customer string, title string, meeting_date string, text string, segment string"))


def rows(n, names=("Acme", " acme ", "Beta", None)):
    return [("org", names[i % len(names)], f"t{i}", "2024-01-01", f"text {i}", f"s{i % 2}") for i in range(n)]


def items(meetings):
    return meetings.select("meeting_key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))


def totals(store):
    return (
        {r["customer"]: r["meetings"] for r in store.customers().select(F.lower(F.trim("customer")).alias("customer"), "meetings").collect()},
        store.meetings().count(),
        store.table("items").count(),
    )


WANT = ({"acme": 6, "beta": 3, None: 3}, 12, 36)


def test_a_batch_is_written_once(spark, tmp_path):
    store, meetings = MeetingStore(spark, str(tmp_path)), batch(spark, rows(12) + rows(5))
    assert store.meetings() is None and store.customers() is None and store.batches() == []
    assert store.ingest("one", meetings, {"items": items(meetings.dropDuplicates(["meeting_key"]))})
    assert not store.ingest("one", meetings, {"items": items(meetings)})
    assert totals(store) == WANT and store.batches() == ["one"]


@pytest.mark.parametrize("tables", [0, 1, 2, 3])
def test_a_crash_between_tables_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, tables):
    store, meetings = MeetingStore(spark, str(tmp_path)), batch(spark, rows(12))
    half = batch(spark, rows(4))
    store.ingest("zero", half, {"items": items(half)})
    before, done, write = totals(store), [], MeetingStore._write

    def breaks(self, *a):
        if len(done) == tables:
            raise RuntimeError("lost")
        done.append(write(self, *a))

    monkeypatch.setattr(MeetingStore, "_write", breaks)
    with pytest.raises(RuntimeError):
        store.ingest("one", meetings, {"items": items(meetings), "more": items(meetings)})
    monkeypatch.setattr(MeetingStore, "_write", write)
    assert totals(store) == before and store.batches() == ["zero"]
    assert store.ingest("one", meetings, {"items": items(meetings), "more": items(meetings)})
    assert totals(store) == WANT


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    meetings, write = batch(spark, rows(12)), MeetingStore._write
    both = threading.Barrier(2)

    def waits(self, frame, name, attempt):
        if name == "customers":
            both.wait(60)
        write(self, frame, name, attempt)

    monkeypatch.setattr(MeetingStore, "_write", waits)
    run = [threading.Thread(target=lambda: MeetingStore(spark, str(tmp_path)).ingest("one", meetings, {"items": items(meetings)})) for _ in range(2)]
    for t in run:
        t.start()
    for t in run:
        t.join()
    store = MeetingStore(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert totals(store) == WANT and store.batches() == ["one"]


def test_batches_that_share_meetings_and_change_a_customer(spark, tmp_path):
    store = MeetingStore(spark, str(tmp_path))
    first, second = batch(spark, rows(8)), batch(spark, [(*r[:5], "new") for r in rows(12)[4:]])
    store.ingest("a", first, {"items": items(first)})
    store.ingest("b", second, {"items": items(second)})
    assert totals(store) == WANT
    assert {r["segment"] for r in store.customers().collect()} == {"new"}


def test_odd_batches(spark, tmp_path):
    store = MeetingStore(spark, str(tmp_path))
    none = batch(spark, [])
    assert store.ingest("empty", none, {"items": items(none)})
    assert store.meetings() is None or store.meetings().count() == 0
    odd = batch(spark, [(None, None, None, None, None, None), ("", "", "", "", "", ""), ("o", "x", None, "2024-01-01", "t", None)])
    assert store.ingest("odd", odd) and store.meetings().count() == 2
    with pytest.raises(ValueError):
        store.ingest("", odd)
    with pytest.raises(ValueError):
        store.ingest("x", odd, {"log": odd})
