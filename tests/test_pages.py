"""Geometry, layout checks, logical units and the ledger: cases with known results and brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanloom.operators import geometry, layout, ledger, metrics, units

SCHEMA = "manual_id string, fragment_id string, text string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, reading_order int, region_id string, cell_id string, column_id string, paragraph_id string, callout_id string, parent_id string, structural_role string, style int, font_size double"


def fragment(i, text, box, page=0, order=None, role="body", cell=None, column=None, paragraph="paragraph-1", region="body-1", callout=None, parent=None, style=0, size=10.0):
    return ("m", f"frag-{i}", text, page, tuple(map(float, box)), order if order is not None else i if isinstance(i, int) else 0, region, cell, column, paragraph, callout, parent, role, style, size)


SPANS = "side string, ord int, span_id string, manual_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, block string, line int"
CELL = "manual_id string, page int, region_id string, cell_id string, x0 double, y0 double, x1 double, y1 double"
PAGE = "manual_id string, page int, x0 double, y0 double, x1 double, y1 double"


def warned(spark, spans, cells=(), page=(0, 0, 600, 800)):
    rows = [(side, n, f"s{n}", "m", 0, text, *map(float, box), float(size), str(block), 0) for n, (side, text, box, size, block) in enumerate(spans)]
    df = spark.createDataFrame(rows, SPANS)
    c = spark.createDataFrame([("m", 0, "r", f"c{n}", *map(float, b)) for n, b in enumerate(cells)], CELL)
    p = spark.createDataFrame([("m", 0, *map(float, page))], PAGE)
    return sorted(r.kind for r in layout.warnings(df, c, p).collect())


D100, LABEL = ("source", "D100", (10, 10, 40, 20), 10, 0), ("source", "Label", (10, 10, 30, 20), 10, 0)


@pytest.mark.parametrize(
    "spans,cells,page,kinds",
    [
        ([D100, ("target", "D100", (10, 10, 40, 20), 10, 0), ("target", "Áp suất", (20, 10, 70, 20), 10, 1)], [], (0, 0, 600, 800), ["translated_retained_overlap"]),
        ([D100, ("target", "Một", (10, 10, 40, 20), 10, 0), ("target", "Áp suất", (20, 10, 70, 20), 10, 1)], [], (0, 0, 600, 800), ["new_text_overlap"]),
        ([D100, ("source", "Pressure", (20, 10, 70, 20), 10, 1), ("target", "D100", (10, 10, 40, 20), 10, 0), ("target", "Áp suất", (20, 10, 70, 20), 10, 1)], [], (0, 0, 600, 800), []),
        ([LABEL, ("target", "Nhãn rất dài", (10, 10, 65, 20), 10, 0)], [(0, 0, 50, 30)], (0, 0, 40, 40), ["page_out_of_bounds", "table_cell_spill"]),
        ([("source", "Label", (10, 10, 65, 20), 10, 0), ("target", "Nhãn rất dài", (10, 10, 65, 20), 10, 0)], [(0, 0, 50, 30)], (0, 0, 40, 40), []),
        ([("source", "Text", (10, 10, 40, 20), 10, 0), ("target", "Chữ", (10, 10, 25, 15), 5, 0)], [(0, 0, 120, 60)], (0, 0, 600, 800), ["suspicious_micro_font"]),
        ([("target", "Chữ", (10, 10, 25, 15), 10, 0), ("target", "Chữ", (10, 10, 25, 15), 10, 0)], [], (0, 0, 600, 800), ["duplicate_local_render"]),
        ([], [], (0, 0, 600, 800), []),
    ],
)
def test_layout_warnings(spark, spans, cells, page, kinds):
    assert warned(spark, spans, cells, page) == kinds


def test_metadata(spark):
    def row(side, n, text, y):
        return (side, n, f"{side}{n}", "m", 0, text, 10.0, float(y), 200.0, float(y) + 10, 10.0, str(n), 0)

    rows = [row("source", 0, "ABC-12-X9 Rev. 1.2", 5), row("source", 1, "3 / 40", 780), row("source", 2, "2024-01-02 body", 400), row("target", 0, "ABC-12-X Rev. 1.2", 5), row("target", 1, "4/40", 780), row("target", 2, "각주", 785)]
    got = layout.metadata_warnings(spark.createDataFrame(rows, SPANS), spark.createDataFrame([("m", 0, 0.0, 0.0, 600.0, 800.0)], PAGE)).collect()
    assert {(r.kind, r.category) for r in got} == {("immutable_metadata_mismatch", "document_code"), ("page_number_mismatch", "page_number"), ("metadata_fragmentation", "document_code"), ("header_footer_untranslated_prose", "")}


def test_overlap_brute_force(spark):
    rng = random.Random(3)
    boxes = [(i % 2, x, y, x + rng.randint(5, 90), y + rng.randint(5, 40)) for i in range(120) for x, y in [(rng.randint(0, 300), rng.randint(0, 300))]]
    rows = [("source", i, f"s{i:03}", "m", b[0], "ab" if i % 9 else "a", *map(float, b[1:]), 10.0, str(i // 4), i % 2) for i, b in enumerate(boxes)]
    got = {(r.a, r.b) for r in geometry.overlap_pairs(spark.createDataFrame(rows, SPANS)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[8], b[8]) - max(a[6], b[6]), min(a[9], b[9]) - max(a[7], b[7])
            if a[2] < b[2] and a[4] == b[4] and w > 0 and h > 0 and len(a[5]) > 1 < len(b[5]) and (a[11] != b[11] or a[12] != b[12]) and w * h >= 9 and w * h / min((a[8] - a[6]) * (a[9] - a[7]), (b[8] - b[6]) * (b[9] - b[7])) >= 0.35:
                want.add((a[2], b[2]))
    assert got == want and len(want) > 5


def test_height_below_brute_force(spark):
    rng = random.Random(7)
    boxes = [(i % 3, x, y, x + rng.randint(5, 300), y + rng.randint(5, 30)) for i in range(150) for x, y in [(rng.randint(0, 500), rng.randint(0, 700))]]
    df = spark.createDataFrame([fragment(i, "", b[1:], page=b[0]) for i, b in enumerate(boxes)] * 2, SCHEMA)
    got = {int(r.fragment_id[5:]): r.height for r in geometry.height_below(df).collect()}
    for i, (page, x0, y0, x1, y1) in enumerate(boxes):
        under = [b[2] for j, b in enumerate(boxes) if j != i and b[0] == page and min(b[3], x1) - max(b[1], x0) > 0.1 * (x1 - x0) and b[2] >= y1 - 0.5]
        limit = min(under) if under else max(b[4] for b in boxes if b[0] == page)
        assert got[i] == max(limit - y0, y1 - y0)


def test_x_clusters(spark):
    words = {"Drive": (0, 20), "drum": (22, 45), "diameter": (47, 80), "dA": (160, 170)}
    df = spark.createDataFrame([fragment(n, w, (a, 0, b, 12), role="table_cell", region="table-1") for n, (w, (a, b)) in enumerate(words.items())], SCHEMA)
    got = geometry.x_clusters(df).orderBy("cluster").collect()
    assert [(r.x0, r.x1, r.fragments, r.cell_x0, r.cell_x1) for r in got] == [(0, 80, 3, 0, 120), (160, 170, 1, 120, 170)]


def test_cell_partition_does_not_overlap(spark):
    rng = random.Random(5)
    boxes = [(x, y, x + 20, y + 8) for x in (0, 30, 60) for y in (0, 12, 30)]
    df = spark.createDataFrame([fragment(i, "x", b, region="r") for i, b in enumerate(rng.sample(boxes, len(boxes)))], SCHEMA)
    got = [(r.x0, r.y0, r.x1, r.y1) for r in geometry.cell_partition(df).collect()]
    area = sum((c - a) * (d - b) for a, b, c, d in got)
    assert len(got) == 9 and area == pytest.approx(80 * 38)


def test_line_offsets_share_the_budget(spark):
    df = spark.createDataFrame([fragment(n, "x", (0, 20 * n, 10, 20 * n + h), size=10.0) for n, h in enumerate((10, 31, 41))], SCHEMA)
    free = [r.offset for r in layout.line_offsets(df, 1.0, None).orderBy("fragment_id").collect()]
    tight = [r.offset for r in layout.line_offsets(df, 1.0, 26.0).orderBy("fragment_id").collect()]
    assert free == [0.0, 31.0, 72.0] and tight == [0.0, 20.5, 46.0]


def test_right_limits(spark):
    df = spark.createDataFrame([fragment(0, "a", (0, 0, 50, 10)), fragment(1, "b", (100, 0, 400, 10)), fragment(2, "c", (2, 20, 60, 30))], SCHEMA)
    assert {r.fragment_id: r.limit for r in layout.right_limits(df).collect()} == {"frag-0": 97.0, "frag-1": 400.0, "frag-2": 97.0}


def test_best_overlap(spark):
    rows = [fragment(0, "a", (0, 0, 50, 10), region="t", cell="c1", parent="p1"), fragment(1, "b", (50, 0, 100, 10), region="t", cell="c2", parent="p1"), fragment(2, "c", (0, 200, 9, 210), region="u", parent="p2"), fragment(3, "d", (0, 300, 90, 310), region="u", parent=None)]
    got = {(r.region_id, r.parent_id, r.overlap, r.cells) for r in geometry.best_overlap(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("t", "p1", 1.0, 2)}


UNITS = {
    "inline style": ([fragment(0, "Do ", (10, 10, 28, 20)), fragment(1, "NOT", (28, 10, 48, 20), style=1), fragment(2, " turn off the power while writing.", (48, 10, 220, 20))], ["Do <s1>NOT</s1> turn off the power while writing."], "inline_emphasis"),
    "wrapped": ([fragment(0, "Normal prose wrapped across", (10, 10, 180, 20)), fragment(1, "multiple physical lines", (10, 22, 155, 32)), fragment(2, "remains one paragraph.", (10, 34, 145, 44))], ["Normal prose wrapped across multiple physical lines remains one paragraph."], "same_paragraph"),
    "hyphen": ([fragment(0, "Normal prose take-", (10, 10, 180, 20)), fragment(1, " up reel", (10, 22, 155, 32))], ["Normal prose take-up reel"], "same_paragraph"),
    "gap": ([fragment(0, "left", (10, 10, 30, 20)), fragment(1, "right", (33, 10, 60, 20))], ["left right"], "same_line_continuation"),
    "no gap": ([fragment(0, "le", (10, 10, 30, 20)), fragment(1, "ft", (30.5, 10, 60, 20))], ["left"], "same_line_continuation"),
    "taller line": ([fragment(0, "first line of it", (10, 10, 180, 14)), fragment(1, "second", (10, 26, 155, 40))], ["first line of it second"], "same_paragraph"),
    "bullets": ([fragment(0, "• Install the module", (10, 10, 150, 20)), fragment(1, "• Connect the cable", (10, 22, 150, 32))], ["• Install the module", "• Connect the cable"], ""),
    "callouts": ([fragment(0, "Warning text here", (10, 10, 150, 20), callout="a"), fragment(1, "Note", (10, 22, 150, 32), callout="b")], ["Warning text here", "Note"], ""),
    "tags are no text": ([fragment(0, "<s1>ab</s1>", (10, 10, 180, 20), paragraph=None), fragment(1, "more text", (10, 22, 155, 32), paragraph=None)], ["<s1>ab</s1>", "more text"], ""),
    "null text": ([fragment(0, None, (10, 10, 180, 20)), fragment(1, "text", (10, 22, 155, 32))], ["text"], "same_paragraph"),
}


@pytest.mark.parametrize("case", UNITS)
def test_unit_texts(spark, case):
    rows, want, reason = UNITS[case]
    got = units.logical_units(spark.createDataFrame(rows * 2, SCHEMA)).orderBy("unit_id").collect()
    assert [r.text for r in got] == want
    assert got[0].reasons.split(",")[0] == reason and got[0].unit_id.startswith("p1:frag-0..") and (got[0].x0, got[0].y0) == rows[0][4][:2]


def test_barrier(spark):
    df = spark.createDataFrame(UNITS["wrapped"][0], SCHEMA)
    line = lambda *b: spark.createDataFrame([("m", 0, *map(float, b))], PAGE)
    decided = lambda b: [r.decision for r in units.decisions(df, b).orderBy("ord").collect()]
    assert decided(line(10, 21, 180, 21.2)) == ["first", "rejected_geometry", "same_paragraph"]
    assert decided(line(10, 21, 12, 21.2)) == decided(line(500, 21, 900, 21.2)) == decided(None) == ["first", "same_paragraph", "same_paragraph"]


OCC = "occurrence_id string, manual_id string, source_span_ids array<string>, source_text string, status string, target_text string, preserve_reason string, preserve_reason_is_approved boolean, unresolved_reason string, validation_failures array<string>"


def test_ledger_demotes_and_delivers(spark):
    frags = spark.createDataFrame([("m", "frag-1"), ("m", "frag-2")], "manual_id string, fragment_id string")
    o = lambda i, span, status, reason=None, ok=False, failed=(): (i, "m", [span], "src", status, "dst", reason, ok, None, list(failed))
    run = lambda *rows, leaks=None: ledger.delivery(spark.createDataFrame(list(rows), OCC), frags, leaks).first()
    done, kept = o("1", "span-1", "TRANSLATED"), o("2", "span-2", "ALLOWED_PRESERVE", "literal_path", True)
    assert run(done, kept).delivery == "SUCCESS" and run(done, kept).coverage == 1.0
    r = run(done, o("2", "span-2", "ALLOWED_PRESERVE", "unknown", True))
    assert (r.unresolved, r.delivery, r.completion) == (1, "PARTIAL", 0.5)
    assert run(done).delivery == "FAIL" and run(done, o("2", "span-1", "TRANSLATED")).delivery == "FAIL" and run(done, o("2", "span-2", None)).delivery == "FAIL"
    assert run(done, o("2", "span-2", "TRANSLATED", failed=["hangul_leak"])).delivery == "FAIL"
    assert run(done, kept, leaks=spark.createDataFrame([("m", 3)], "manual_id string, leaks long")).delivery == "FAIL"
    rec = ledger.recorded(spark.createDataFrame([o("2", "span-2", "ALLOWED_PRESERVE", "unknown", True, ["a"])] * 2, OCC))
    assert [(x.status, x.target_text, x.unresolved_reason, x.validation_failures) for x in rec.collect()] == [("UNRESOLVED", "src", "unapproved_preserve", ["a", "unapproved_preserve"])]
    marks = spark.createDataFrame([("1", 1, "first", ["x"]), ("1", 2, "last", ["y"])], "occurrence_id string, seq int, reason string, failures array<string>")
    m = ledger.mark_unresolved(ledger.recorded(spark.createDataFrame([done, kept], OCC)), marks).orderBy("occurrence_id").collect()
    assert (m[0].status, m[0].unresolved_reason, m[0].validation_failures, m[1].status) == ("UNRESOLVED", "last", ["x", "y"], "ALLOWED_PRESERVE")


def test_conservation_counts_unknown(spark):
    frags = spark.createDataFrame([("m", "a"), ("m", "b")], "manual_id string, fragment_id string")
    made = spark.createDataFrame([("m", ["a", "x"]), ("m", ["a"])], "manual_id string, source_fragment_ids array<string>")
    r = units.conservation(frags, made).first()
    assert (r.candidates, r.assigned, r.unassigned, r.duplicates, r.unknown) == (2, 2, 1, 1, 1)


def test_health_and_percentiles(spark):
    made = spark.createDataFrame([("m", ["x"])] * 170 + [("m", ["x"] * 3)] * 10, "manual_id string, source_fragment_ids array<string>")
    assert metrics.health(made).first().health == "MANUAL_REVIEW_REQUIRED"
    rows = [(str(n), "vi", "x" * n) for n in (100, 200, 300, 400)]
    r = metrics.batch_percentiles(spark.createDataFrame(rows, "segment_id string, lang_out string, src string"), 5000).first()
    assert (r.p50, r.p90, r.p99, r.mean, r.used) == (250, 370, 397, statistics.mean((100, 200, 300, 400)), 0.05)


def test_small_geometry(spark):
    row = spark.createDataFrame([((10.0, 10.0, 50.0, 30.0), (10.0, 10.0, 12.0, 11.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    r = row.select(geometry.padded_cell(F.col("a"), F.lit(100.0)).alias("p"), geometry.padded_cell(F.col("b"), F.lit(100.0)).alias("q"), geometry.width_budget(F.lit(20.0), F.lit(0.0), F.lit(100.0), F.lit(3)).alias("w"), geometry.ends_paragraph(F.lit(70.0), F.lit(0.0), F.lit(100.0)).alias("e")).first()
    assert tuple(r.p) == (12.0, 71.0, 48.0, 89.0) and r.q is None and r.w == 280.0 and r.e is True


def test_stages(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("b", "a", 2.0)], "id string, parent string, seconds double")
    assert {r.id: r.exclusive for r in metrics.exclusive_time(df).collect()} == {"a": 3.0, "b": 2.0}
    assert {r.id: r.share for r in metrics.stage_shares(df, 10.0).collect()} == {"a": 0.3, "b": 0.2}


def test_excess_rows(spark):
    targets = spark.createDataFrame([("a", "m", 0, "x", 1), ("b", "m", 0, "x", 2), ("c", "m", 0, "x", 3), ("c", "m", 0, "x", 3), ("d", "m", 0, None, 4), ("e", "m", 0, "y", 5)], "k string, manual_id string, page int, text string, o int")
    sources = spark.createDataFrame([("m", 0, "x"), ("m", 0, None)], "manual_id string, page int, text string")
    assert {(r.k, r.excess) for r in layout.excess_rows(targets, sources, "k", "o").collect()} == {("b", 1), ("c", 2)}
    assert layout.excess_rows(targets, sources.limit(0), "k", "o").count() == 0
