"""Core operators: fixtures with known results, and every query against DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from spanloom.operators import flow, ledger, texts, units
from spanloom.plans import catalog
from spanloom.sources import interchange


def _fragment(i, text, box, page=0, order=None, role="body", cell=None, column=None, paragraph="paragraph-1", region="body-1", callout=None, style=0, size=10.0):
    return ("m", f"frag-{i}", text, page, box, i if order is None else order, region, cell, column, paragraph, callout, None, role, style, size)


SCHEMA = "manual_id string, fragment_id string, text string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, reading_order int, region_id string, cell_id string, column_id string, paragraph_id string, callout_id string, parent_id string, structural_role string, style int, font_size double"
CASES = {
    "inline style": ([_fragment(0, "Do ", (10.0, 10.0, 28.0, 20.0)), _fragment(1, "NOT", (28.0, 10.0, 48.0, 20.0), style=1), _fragment(2, " turn off the power while writing.", (48.0, 10.0, 220.0, 20.0))], ["first", "inline_emphasis", "inline_emphasis"]),
    "wrapped": ([_fragment(0, "Normal prose wrapped across", (10.0, 10.0, 180.0, 20.0)), _fragment(1, "multiple physical lines", (10.0, 22.0, 155.0, 32.0))], ["first", "same_paragraph"]),
    "cells": ([_fragment(0, "a", (10.0, 10.0, 105.0, 20.0), cell="A"), _fragment(1, "b", (106.0, 10.0, 250.0, 20.0), cell="B")], ["first", "rejected_cross_cell"]),
    "one cell unknown": ([_fragment(0, "a", (10.0, 10.0, 105.0, 20.0), cell="A"), _fragment(1, "b", (106.0, 10.0, 250.0, 20.0))], ["first", "rejected_cross_cell"]),
    "columns": ([_fragment(0, "l", (10.0, 10.0, 120.0, 20.0), column="1"), _fragment(1, "r", (130.0, 10.0, 240.0, 20.0), column="2")], ["first", "rejected_cross_column"]),
    "role": ([_fragment(0, "h", (10.0, 10.0, 120.0, 20.0), role="heading"), _fragment(1, "b", (10.0, 22.0, 240.0, 32.0))], ["first", "rejected_structural_role"]),
    "bullets": ([_fragment(0, "• Install the module", (10.0, 10.0, 150.0, 20.0)), _fragment(1, "• Connect the cable", (10.0, 22.0, 150.0, 32.0))], ["first", "rejected_linguistic_boundary"]),
    "pages": ([_fragment(0, "a", (10.0, 10.0, 150.0, 20.0)), _fragment(1, "b", (10.0, 22.0, 150.0, 32.0), page=1)], ["first", "first"]),
}


@pytest.mark.parametrize("case", CASES)
def test_unit_decisions(spark, case):
    rows, want = CASES[case]
    got = units.decisions(spark.createDataFrame(rows, SCHEMA)).orderBy("page", "ord").collect()
    assert [r.decision for r in got] == want


def test_ledger(spark):
    frags = spark.createDataFrame([("m", "frag-1"), ("m", "frag-2"), ("m", "frag-3")], "manual_id string, fragment_id string")
    occ = spark.createDataFrame([("o1", "m", ["span-1"]), ("o2", "m", ["span-1", "span-9"]), ("o2", "m", ["span-1", "span-9"]), ("o3", "m", None)], "occurrence_id string, manual_id string, source_span_ids array<string>")
    r = ledger.reconcile(frags, occ).first()
    assert (r.eligible, r.assigned, r.unassigned, r.unknown, r.duplicates) == (3, 2, 2, 1, 1)


def test_two_strike_stream_equals_batch(spark, tmp_path):
    from spanloom.streaming.strikes import two_strike_stream

    schema = "identity string, seq long, outcome string"
    rows = [(f"u{i % 5}", i, ["failure", "success", "transport", "failure"][(i * 7 + i // 3) % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, schema)
    for n in range(2):
        df.filter(f"seq >= {n * 40} AND seq < {n * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = two_strike_stream(stream).writeStream.format("memory").queryName("strikes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("strikes").collect()) == sorted(flow.two_strike(df).select("identity", "trusted_at").collect())


def test_interchange(spark, tmp_path):
    src = tmp_path / "s.jsonl"
    src.write_text('{"segment_id": "1", "src": "a"}\n{"src": "한"}\n')
    rows = interchange.read_segments(spark, str(src)).collect()
    assert {r.src for r in rows} == {"a", "한"} and all(r.segment_id for r in rows)
    interchange.write_lines(interchange.read_segments(spark, str(src)), str(tmp_path / "out"))
    assert interchange.read_segments(spark, str(tmp_path / "out")).count() == 2
    t = tmp_path / "t.jsonl"
    t.write_text('{"segment_id": "1", "dst": "x"}\n{"translations": [{"segment_id": "2", "dst": "y"}, {"segment_id": "3", "dst": "z"}]}\n')
    assert {(r.segment_id, r.dst) for r in interchange.read_translations(spark, str(t)).collect()} == {("1", "x"), ("2", "y"), ("3", "z")}
    assert sorted(r.page for r in interchange.page_selection(spark, "1,3-5").collect()) == [0, 2, 3, 4]
    with pytest.raises(Exception):
        interchange.page_selection(spark, "5-3").collect()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    assert {os.path.basename(r.path): r.ok for r in interchange.binary_guard(spark, str(tmp_path)).collect()} == {"a.pdf": True, "b.pdf": False}
    (tmp_path / "C.PDF").write_bytes(b"\xff\xfe %PDF-1.4")
    assert {os.path.basename(r.path) for r in interchange.binary_guard(spark, str(tmp_path)).filter("ok").collect()} == {"a.pdf", "C.PDF"}
    src.write_text('{"segment_id": "1", "src": "a"}\n\nno record\n')
    with pytest.raises(Exception, match="not a record: no record"):
        interchange.read_segments(spark, str(src)).collect()
    misses = spark.createDataFrame([("1",), ("2",), ("2",)], "segment_id string")
    assert [r.segment_id for r in interchange.enqueue_misses(misses, misses.filter("segment_id = '1'")).collect()] == ["2"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(df: pd.DataFrame) -> list:
    def value(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


TEXTS = "tbl string, field string, record_id string, text string"


def test_tag_nesting_of_a_table(spark):
    cases = {"Keep <b0></b0>": True, '<a href="x"><s1>NOT</s1></A> now': True, "<a><b></a></b>": False, "<x/> alone": True, "open <s2>": False, "</s3>": False, "<q:r-s>": False}
    rows = [("t", "f", str(i), t) for i, t in enumerate(cases)] + [("t", "f", "0", "Keep <b0></b0>"), ("t", "f", "n", None), ("t", "f", "p", "plain 1 < 2")]
    got = {int(r.record_id): r.balanced for r in texts.tag_nesting(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_formula_markers_of_a_table(spark):
    cases = {"Set {v0} to {v1}.": ("<b0></b0><b1></b1>", True), "{v2}{v2}": ("<b2></b2><b2></b2>", True), "{ V 1 2 }": ("<b12></b12>", False), "{v01}": ("<b1></b1>", False), "{v3} <b3></b3>": ("<b3></b3>", False), "<b4>": ("", False)}
    rows = [("t", "f", str(i), t) for i, t in enumerate(cases)] + [("t", "f", "n", None), ("t", "f", "p", "{x} and {v}")]
    got = {int(r.record_id): (r.masked, r.same) for r in texts.formula_markers(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == dict(enumerate(cases.values()))


PAGES = {
    "TOC": ["Contents", "Safety ........ 1", "Setup ........ 4"],
    "INDEX": [f"term{i}, {i} ff." for i in range(24)],
    "NOMENCLATURE": ["Nomenclature", *[x for i in range(6) for x in (f"a{i}", f"width of beam {i}")]],
    "REFERENCES": ["References", *[f"[{i}] A. Author, Title ({2000 + i})." for i in range(1, 5)]],
    None: ["Check the relay.", "The fuse must be replaced."],
}


def test_page_kinds_of_fragments(spark):
    rows = [_fragment(f"{p}-{i}", t, (10.0, 12.0 * i, 90.0, 12.0 * i + 10), page=p, order=i) for p, lines in enumerate(PAGES.values()) for i, t in enumerate(lines)]
    rows += [_fragment("9-0", "Index\r\n \u2003a\n", (10.0, 0.0, 90.0, 10.0), page=9, order=0), _fragment("8-0", None, (10.0, 0.0, 90.0, 10.0), page=8, order=0)]
    got = {r.page: (r.lines, r.kind) for r in texts.page_kinds(spark.createDataFrame(rows * 2, SCHEMA)).collect()}
    assert got == {p: (len(lines), kind) for p, (kind, lines) in enumerate(PAGES.items())} | {9: (2, "INDEX"), 8: (0, None)}




def test_queue_glossary_and_publishing(spark, tmp_path):
    misses = spark.createDataFrame([("1",), ("2",), ("2",)], "segment_id string")
    queue = str(tmp_path / "queue")
    assert interchange.append_misses(misses, queue) == 2 and interchange.append_misses(misses, queue) == 0
    (tmp_path / "g.json").write_text('{"relay": "rơ le", "fuse": "cầu chì"}')
    assert {(r.term, r.target) for r in interchange.read_glossary(spark, str(tmp_path / "g.json")).collect()} == {("relay", "rơ le"), ("fuse", "cầu chì")}
    (tmp_path / "g.json").write_text('{"relay": " "}')
    with pytest.raises(Exception, match="must not be empty"):
        interchange.read_glossary(spark, str(tmp_path / "g.json")).collect()
    assert interchange.publish(misses, str(tmp_path / "out"), str(tmp_path / "staged")) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and not (tmp_path / "staged").exists()
    with pytest.raises(FileExistsError):
        interchange.publish(misses, str(tmp_path / "out"), str(tmp_path / "staged"))


def test_injected_provider(spark):
    rows = [("1", "ab"), ("2", "ab"), ("3", None), ("4", "x" * 6000), ("5", " ")]
    df = spark.createDataFrame(rows, "segment_id string, src string")
    got = {r.segment_id: (r.dst, r.error) for r in interchange.call_provider(df, lambda texts: [f"&lt;{t}&gt;\x07" for t in texts]).collect()}
    none = (None, "UnresolvedSegmentError")
    assert got == {"1": ("<ab>", None), "2": ("<ab>", None), "3": none, "4": (None, "SegmentTooLongError"), "5": none}
