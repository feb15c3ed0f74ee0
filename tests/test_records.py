"""Changing tables on rows with nulls and repeats, and two more document formats."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from colloquy.operators import records as R
from colloquy.operators.ingest import manifest_join
from colloquy.sources.files import items_of_files, odt_text, rtf_text

DAY = dt.date(2024, 1, 10)
LATER = DAY + dt.timedelta(1)


def test_memory_leaves_out_self_and_later(spark):
    rows = [(1, 1, DAY, 10), (2, 1, DAY, None), (3, 1, LATER, 30), (4, None, DAY, 5), (5, 2, None, 7)]
    meetings = spark.createDataFrame(rows, "meeting_id long, customer_id long, meeting_date date, score int")
    got = {r.meeting_id: (r.others, r.others_sum) for r in R.memory_without_self(meetings, "score").collect()}
    assert got == {1: (0, 0), 2: (1, 10), 3: (1, 10), 4: (0, 0), 5: (0, 0)}
    assert R.memory_without_self(meetings.limit(0), "score").count() == 0


def test_reanalysis_replaces_rows(spark):
    schema = "meeting_id long, score int"
    derived = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (None, 5)], schema)
    again = spark.createDataFrame([(1,), (1,), (3,), (None,)], "meeting_id long")
    got = R.reanalysed(derived, again, spark.createDataFrame([(1, 9)], schema))
    assert sorted(got.collect(), key=str) == sorted([(1, 9), (2, 3), (None, 5)], key=str)


def test_portraits_are_written_by_partition(spark, tmp_path):
    customers = spark.createDataFrame([(1, 80), (2, None)], "customer_id long, health int")
    meetings = spark.createDataFrame(
        [(1, 1, DAY, 40, 100.0), (2, 1, LATER, None, None)], "meeting_id long, customer_id long, meeting_date date, trust_score int, budget double"
    )
    products = spark.createDataFrame([(1, "b", "mencionado"), (1, "b", "em_uso"), (1, "a", "oportunidade"), (1, "c", None)], "customer_id long, product string, status string")
    objections = spark.createDataFrame(
        [(1, 1, DAY, 0, "price", False), (1, 1, DAY, 1, "time", False), (1, 2, LATER, 0, "time", True)], "customer_id long, meeting_id long, meeting_date date, ordinal int, text string, resolved boolean"
    )
    offers = spark.createDataFrame([(1, 2, None, 0.5), (1, 2, 10.0, 0.25), (1, 1, 999.0, 1.0)], "customer_id long, meeting_id long, value double, probability double")
    rows = R.portraits(customers, meetings, products, objections, offers)
    assert {r.customer_id: tuple(r)[1:] for r in rows.collect()} == {1: (80, ["a: oportunidade", "b: em_uso"], ["price"], 40, 53), 2: (None, [], [], 50, None)}
    path = str(tmp_path / "portraits")
    R.overwritten(rows, path, "customer_id")
    R.overwritten(rows.where("customer_id = 2").withColumn("health", F.lit(7)), path, "customer_id")
    assert {(r.customer_id, r.health) for r in spark.read.parquet(path).collect()} == {(1, 80), (2, 7)}


def test_corrections_are_logged_once(spark, tmp_path):
    schema = "analysis_id long, user_id long, created_at timestamp, field string, action string, before_value string, after_value string"
    at = dt.datetime(2024, 1, 1)
    good = [(1, 1, at, " budget ", "edit", None, "x"), (1, 1, at, "budget", "edit", None, "x"), (2, None, None, "pain", "confirm", None, None)]
    bad = [(None, 1, at, "a", "add", None, None), (3, 1, at, "  ", "add", None, None), (3, 1, at, "f" * 61, "add", None, None), (3, 1, at, None, "add", None, None), (3, 1, at, "a", "drop", None, None)]
    batch = spark.createDataFrame(good + bad, schema)
    path = str(tmp_path / "log")
    R.appended(R.new_corrections(batch, spark.createDataFrame([], "correction_key string")), path)
    log = spark.read.parquet(path)
    assert sorted((r.analysis_id, r.field) for r in log.collect()) == [(1, "budget"), (2, "pain")]
    assert R.new_corrections(batch, log).count() == 0


def test_samples_come_oldest_first_and_once(spark):
    rows = [("b", LATER, "x", 1), ("a", DAY, "y", 3), ("a", DAY, "y", 2), ("c", DAY, " ", 4), ("d", DAY, None, 5), (None, DAY, "x", 6), ("e", None, "x", 7), ("f", DAY, "x", 8)]
    corpus = spark.createDataFrame(rows, "title string, date date, customer string, sample_id long")
    known = spark.createDataFrame([("f",), (None,)], "title string")
    got = R.new_samples(corpus, known)
    assert [(r.title, r.sample_id) for r in got.collect()] == [("a", 2), ("b", 1), ("e", 7)]
    assert R.new_samples(corpus, corpus).count() == 0


def test_triage_takes_up_where_it_stopped(spark):
    long = "x" * 20
    lines = [f'{{"id": 1, "kind": "customer", "text": "{long}"}},', f' {{"id": 2, "kind": "customer", "text": "{long}"}}', f'{{"id": 3, "kind": "other", "text": "{long}"}}', '{"id": 4, "kind": "customer", "text": "short"}', "{broken", "", None]
    records = R.triage_records(spark.createDataFrame([(x,) for x in lines], "value string"), "id long, kind string, text string")
    judged = spark.createDataFrame([(2,), (None,)], "id long")
    assert [r.id for r in R.triage_queue(records, judged, least=20).collect()] == [1]


def test_manifest_by_end_of_path(spark):
    files = spark.createDataFrame([("in/Acme/q1/call.vtt",), ("in/beta/call.vtt",), ("x.txt",), (None,)], "path string")
    manifest = spark.createDataFrame([("call.vtt", 1), ("acme\\q1\\call.vtt", 2), ("in/beta/CALL", 3)], "file string, ordinal int")
    assert {r.path: r.ordinal for r in manifest_join(files, manifest).collect()} == {"in/Acme/q1/call.vtt": 2, "in/beta/call.vtt": 1, "x.txt": None, None: None}


def test_open_document_and_rich_text(spark):
    text = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    xml = f"<doc {text}><text:h>Pauta</text:h><text:p>Ana:<text:tab/>bom<text:s text:c='2'/>dia<text:line-break/>fim <text:span>já</text:span></text:p></doc>"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("content.xml", xml)
    assert odt_text(packed.getvalue()) == "Pauta\nAna:\tbom  dia\nfim já"
    rich = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator X;}\f0 Pre\'e7o \{alto\}\par Bom\tab dia \u8217?s \u-10179?\u-8704?\~fim}"
    assert rtf_text(rich) == "Preço {alto}\nBom\tdia ’s \U0001f600 fim"
    files = spark.createDataFrame([("a.odt", packed.getvalue()), ("b.rtf", rich), ("c.rtf", b"no"), ("d.odt", b"no")], "path string, content binary")
    assert {r.path: (r.kind, r.reason) for r in items_of_files(files).collect()} == {"a.odt": ("text", None), "b.rtf": ("text", None), "c.rtf": ("ignored", "unreadable"), "d.odt": ("ignored", "unreadable")}


def test_upsell_is_the_same_in_any_order(spark):
    """107953.5 in all, which sums of floating point numbers miss in some orders of the rows."""
    offers = [(1, 1, 81332.1, 0.4), (1, 1, 70475.25, 0.24), (1, 1, 90909.68, 0.48), (1, 1, 61958.14, 0.24)]
    customers = spark.createDataFrame([(1, 80)], "customer_id long, health int")
    meetings = spark.createDataFrame([(1, 1, DAY, 40, 1.0)], "meeting_id long, customer_id long, meeting_date date, trust_score int, budget double")
    products = spark.createDataFrame([], "customer_id long, product string, status string")
    objections = spark.createDataFrame([], "customer_id long, meeting_id long, meeting_date date, ordinal int, text string, resolved boolean")
    for order in (offers, offers[:2] + offers[:1:-1]):
        rows = spark.createDataFrame(order, "customer_id long, meeting_id long, value double, probability double").coalesce(1)
        assert R.portraits(customers, meetings, products, objections, rows).first()["upsell_potential"] == 107954
