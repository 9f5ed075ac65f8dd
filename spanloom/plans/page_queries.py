"""Queries of pages: overlaps, clusters, limits, cells, layout checks, and the SQL of the plain theta joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.patterns import SPACE
from spanloom.functions.tokens import matches
from spanloom.operators import blocks, fitting, geometry, layout, metrics, words
from spanloom.plans.common import Query
from spanloom.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOXES = "b AS (SELECT DISTINCT ON (fragment_id) fragment_id, manual_id, page, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, style, reading_order, region_id, cell_id, parent_id, font_size, structural_role FROM fragments)"
_PAGE = "l.manual_id = r.manual_id AND l.page = r.page"
_W, _H = "greatest(0.0, least(l.x1, r.x1) - greatest(l.x0, r.x0))", "greatest(0.0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_SMALL = f"least({_AREA.format('l')}, {_AREA.format('r')})"
#: Fragments and rebuilt units as spans of one page.
_SPANS = f"""s AS (SELECT 'source' AS side, reading_order AS ord, fragment_id AS span_id, manual_id, page, trim(regexp_replace(text, '[ \\t\\n\\r\\xA0]+', ' ', 'g')) AS text, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, coalesce(cell_id, paragraph_id, callout_id, region_id, 'page') AS block, reading_order AS line
 FROM (SELECT DISTINCT ON (fragment_id) * FROM fragments) WHERE text IS NOT NULL UNION ALL SELECT 'target', 0, logical_unit_id, manual_id, page, trim(regexp_replace(text, '[ \\t\\n\\r\\xA0]+', ' ', 'g')), bbox.x0, bbox.y0, bbox.x1, bbox.y1, logical_unit_id, 0 FROM logical_units WHERE text IS NOT NULL)"""


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return geometry.stacked_spans(table(spark, d, "fragments"), table(spark, d, "logical_units"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return geometry.bbox_union(table(spark, d, "fragments")).drop("fragments")


_add("overlap_pairs", lambda s, d: geometry.overlap_pairs(_spans(s, d)), f"""WITH {_SPANS} SELECT l.span_id AS a, r.span_id AS b, round({_W} * {_H} / {_SMALL}, 4) AS ratio FROM s l JOIN s r ON {_PAGE} AND l.span_id < r.span_id AND (l.block <> r.block OR l.line <> r.line)
    WHERE {_W} * {_H} >= 9 AND length(l.text) >= 2 AND length(r.text) >= 2 AND {_W} * {_H} / {_SMALL} >= 0.35""")
_add("bbox_union", lambda s, d: geometry.bbox_union(table(s, d, "fragments")), f"WITH {BOXES} SELECT manual_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS fragments FROM b GROUP BY manual_id, page")
_add(
    "x_clusters",
    lambda s, d: geometry.x_clusters(table(s, d, "fragments")),
    f"""WITH {BOXES}, g AS (SELECT *, greatest(3.0, 0.6 * median(greatest(0.1, y1 - y0)) OVER r) AS gap, min(x0) OVER r AS le, max(x1) OVER r AS re FROM b WHERE region_id IS NOT NULL AND structural_role = 'table_cell' AND x1 >= x0 WINDOW r AS (PARTITION BY manual_id, page, region_id)),
    m AS (SELECT *, max(x1) OVER (PARTITION BY manual_id, page, region_id ORDER BY x0, y0, fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
    c AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + gap THEN 1 ELSE 0 END) OVER (PARTITION BY manual_id, page, region_id ORDER BY x0, y0, fragment_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM m),
    p AS (SELECT manual_id, page, region_id, cluster, min(x0) AS x0, max(x1) AS x1, count(*) AS fragments, any_value(le) AS le, any_value(re) AS re FROM c GROUP BY ALL)
    SELECT manual_id, page, region_id, cluster, x0, x1, fragments, round(coalesce((lag(x1) OVER w + x0) / 2, le), 4) AS cell_x0, round(coalesce((x1 + lead(x0) OVER w) / 2, re), 4) AS cell_x1 FROM p WINDOW w AS (PARTITION BY manual_id, page, region_id ORDER BY cluster)""",
)
_add(
    "height_below",
    lambda s, d: geometry.height_below(table(s, d, "fragments")),
    f"""WITH {BOXES}, f AS (SELECT *, max(y1) OVER (PARTITION BY manual_id, page) AS fl FROM b), n AS (SELECT l.fragment_id, min(r.y0) AS below FROM f l JOIN f r ON {_PAGE} AND l.fragment_id <> r.fragment_id AND r.y0 >= l.y1 - 0.5
    AND (l.x1 <= l.x0 OR least(l.x1, r.x1) - greatest(l.x0, r.x0) > 0.1 * (l.x1 - l.x0)) GROUP BY 1)
    SELECT fragment_id, round(greatest(coalesce(below, fl) - y0, y1 - y0), 4) AS height FROM f LEFT JOIN n USING (fragment_id)""",
)
_add(
    "neighbour_iou",
    lambda s, d: geometry.neighbour_iou(table(s, d, "fragments")),
    f"""WITH {BOXES}, n AS (SELECT *, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1 FROM b WINDOW w AS (PARTITION BY manual_id, page ORDER BY reading_order, fragment_id)),
    i AS (SELECT fragment_id, greatest(0.0, least(x1, nx1) - greatest(x0, nx0)) * greatest(0.0, least(y1, ny1) - greatest(y0, ny0)) AS i, (x1 - x0) * (y1 - y0) + (nx1 - nx0) * (ny1 - ny0) AS t FROM n WHERE nx0 IS NOT NULL) SELECT fragment_id, round(i / (t - i), 4) AS iou FROM i""",
)
_add(
    "cell_partition",
    lambda s, d: geometry.cell_partition(table(s, d, "fragments")),
    f"""WITH {BOXES}, a AS (SELECT *, (y0 + y1) / 2 AS cy, (x0 + x1) / 2 AS cx, min(x0) OVER r AS rx0, min(y0) OVER r AS ry0, max(x1) OVER r AS rx1, max(y1) OVER r AS ry1 FROM b WHERE region_id IS NOT NULL WINDOW r AS (PARTITION BY manual_id, page, region_id)),
    n AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER w) <= 0.5 * greatest(y1 - y0, lag(y1 - y0) OVER w) THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY manual_id, page, region_id ORDER BY cy, cx, fragment_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY manual_id, page, region_id ORDER BY cy, cx, fragment_id ROWS UNBOUNDED PRECEDING) AS band FROM n), m AS (SELECT manual_id, page, region_id, band, avg(cy) AS m FROM g GROUP BY ALL),
    c AS (SELECT *, (lag(m) OVER v + m) / 2 AS top, (m + lead(m) OVER v) / 2 AS bottom FROM m WINDOW v AS (PARTITION BY manual_id, page, region_id ORDER BY band)),
    h AS (SELECT *, (lag(cx) OVER u + cx) / 2 AS le, (cx + lead(cx) OVER u) / 2 AS ri FROM g WINDOW u AS (PARTITION BY manual_id, page, region_id, band ORDER BY cx, fragment_id))
    SELECT fragment_id, round(coalesce(le, rx0), 4) AS x0, round(coalesce(top, ry0), 4) AS y0, round(coalesce(ri, rx1), 4) AS x1, round(coalesce(bottom, ry1), 4) AS y1 FROM h JOIN c USING (manual_id, page, region_id, band)""",
)
_CELLS = "c AS (SELECT manual_id, page, region_id, cell_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE cell_id IS NOT NULL GROUP BY ALL)"
_add(
    "words_in_cells",
    lambda s, d: geometry.words_in_cells(table(s, d, "fragments"), table(s, d, "logical_units")),
    f"""WITH {BOXES}, {_CELLS}, u AS (SELECT manual_id, page, (bbox.x0 + bbox.x1) / 2 AS cx, (bbox.y0 + bbox.y1) / 2 AS cy FROM logical_units)
    SELECT manual_id, page, region_id, cell_id, count(*) AS units FROM c JOIN u USING (manual_id, page) WHERE cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL""",
)
_box = "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1"
_add(
    "best_overlap",
    lambda s, d: geometry.best_overlap(table(s, d, "fragments")),
    f"""WITH {BOXES}, {_CELLS}, m AS (SELECT manual_id, page, region_id, {_box} FROM b WHERE region_id IS NOT NULL GROUP BY ALL), t AS (SELECT manual_id, page, parent_id, {_box} FROM b WHERE parent_id IS NOT NULL GROUP BY ALL),
    o AS (SELECT l.manual_id, l.page, l.region_id, l.x0, l.y0, l.x1, l.y1, r.parent_id, {_W} * {_H} / {_AREA.format('l')} AS o FROM m l JOIN t r ON {_PAGE} WHERE {_AREA.format('l')} > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY manual_id, page, region_id ORDER BY o DESC, parent_id) AS k FROM o)
    SELECT k.manual_id, k.page, k.region_id, k.parent_id, round(k.o, 4) AS overlap, count(*) FILTER (WHERE (c.x0 + c.x1) / 2 BETWEEN k.x0 AND k.x1 AND (c.y0 + c.y1) / 2 BETWEEN k.y0 AND k.y1) AS cells FROM k LEFT JOIN c ON c.manual_id = k.manual_id AND c.page = k.page WHERE k.k = 1 AND k.o >= 0.5 GROUP BY ALL""",
)
_add(
    "right_limits",
    lambda s, d: layout.right_limits(table(s, d, "fragments")),
    f"""WITH {BOXES}, n AS (SELECT l.fragment_id, min(r.x0) AS beside FROM b l JOIN b r ON {_PAGE} AND l.fragment_id <> r.fragment_id AND r.x0 >= l.x1 - 3 AND least(l.y1, r.y1) > greatest(l.y0, r.y0) GROUP BY 1),
    o AS (SELECT b.*, least(max(x1) OVER (PARTITION BY manual_id, page) - 40, coalesce(beside, 1e308)) AS lim, CASE WHEN x0 - lag(x0) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM b LEFT JOIN n USING (fragment_id) WINDOW w AS (PARTITION BY manual_id, page ORDER BY x0, fragment_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY manual_id, page ORDER BY x0, fragment_id ROWS UNBOUNDED PRECEDING) AS col FROM o)
    SELECT fragment_id, round(greatest(min(lim) OVER (PARTITION BY manual_id, page, col) - 3, x1), 4) AS "limit" FROM c""",
)
_add(
    "line_offsets",
    lambda s, d: layout.line_offsets(table(s, d, "fragments")),
    f"""WITH {BOXES}, a AS (SELECT *, coalesce(font_size, y1 - y0) * 1.1 AS base, y1 - y0 AS h FROM b WHERE region_id IS NOT NULL),
    e AS (SELECT *, greatest(0.0, coalesce(lead(h) OVER w, 0.0) - base) AS extra FROM a WINDOW w AS (PARTITION BY manual_id, page, region_id ORDER BY reading_order, fragment_id)),
    t AS (SELECT *, sum(extra) OVER (PARTITION BY manual_id, page, region_id) AS total FROM e), s AS (SELECT *, base + extra * CASE WHEN total > 20 THEN 20 / total ELSE 1 END AS step FROM t)
    SELECT fragment_id, round(coalesce(sum(step) OVER (PARTITION BY manual_id, page, region_id ORDER BY reading_order, fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS "offset" FROM s""",
)


def layout_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What the rebuilt units of a page have that its fragments have not: six kinds. No SQL; tested against brute force."""
    return layout.warnings(_spans(spark, d), geometry.cells_of(table(spark, d, "fragments")), _pages(spark, d))


def metadata_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of headers and footers that changed, broke up, or was left untranslated between fragments and rebuilt units."""
    return layout.metadata_warnings(_spans(spark, d), _pages(spark, d))


def metadata_zones(spark: SparkSession, d: str) -> DataFrame:
    """Metadata values of header and footer lines, counted by side and category."""
    return layout.metadata_values(_spans(spark, d), _pages(spark, d)).groupBy("side", "category").agg(F.count("*").alias("places"), F.countDistinct("value").alias("different"))


QUERIES["layout_warnings"] = layout_warnings
QUERIES["metadata_warnings"] = metadata_warnings
_b = f"(?:^|[^\\p{{L}}\\p{{N}}_])({{0}})(?:$|[^\\p{{L}}\\p{{N}}_])"
_S = f"[{SPACE}]"
_META = {
    "document_code": r"[A-Z]{2,}(?:-[A-Z0-9]+){2,}", "revision": rf"(?i:Rev\.{_S}*:?{_S}*\p{{Nd}}+(?:\.\p{{Nd}}+)+)", "page_number": rf"\p{{Nd}}{{1,4}}{_S}*/{_S}*\p{{Nd}}{{1,4}}",
    "date": rf"(?:19|20)\p{{Nd}}{{2}}[.-]{_S}*\p{{Nd}}{{1,2}}[.-]{_S}*\p{{Nd}}{{1,2}}", "time": r"(?:[01]\p{Nd}|2[0-3]):[0-5]\p{Nd}:[0-5]\p{Nd}", "author_id": r"[A-Z]{2,}[A-Z0-9]*\p{Nd}{2,}",
}


def _marked_meta(p: str) -> str:
    """A metadata pattern over text in which chr(1) follows every character that is no letter, figure or "_"."""
    out, i = "", 0
    marks = [r"\.", "[.-]", _S, "/"]
    while i < len(p):
        hit = next((m for m in marks if p.startswith(m, i)), None)
        if hit:
            i += len(hit)
            if p[i : i + 1] in ("*", "+"):
                out, i = out + f"(?:{hit}\x01){p[i]}", i + 1
            else:
                out += hit + "\x01"
        elif p.startswith("(?:-", i):
            out, i = out + "(?:-\x01", i + 4
        elif p.startswith(":?", i):
            out, i = out + "(?::\x01)?", i + 2
        elif p[i] == ":" and not p.startswith("(?", max(0, i - 2)) and not p.startswith("(?i", max(0, i - 3)):
            out, i = out + ":\x01", i + 1
        else:
            out, i = out + p[i], i + 1
    return out


def metadata_values(spark: SparkSession, d: str) -> DataFrame:
    """Metadata values in the texts of all documents, with the number of documents that hold each."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    each = F.array(*[F.struct(F.lit(n).alias("category"), matches(F.col("text"), p).alias("v")) for n, p in P.METADATA.items()])
    rows = docs.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.category", F.explode("m.v").alias("value"))
    return rows.groupBy("category", "value").agg(F.countDistinct("doc_id").alias("documents"))


def _metadata_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    values = [f"SELECT *, '{n}' AS category, unnest(regexp_extract_all(text, {quoted(_b.replace('{0}', p))}, 1)) AS v FROM z" for n, p in _META.items()]
    values.append(rf"SELECT *, 'confidential', unnest(regexp_extract_all(text, '(?i)CONFIDENTIAL(?:{_S}+\p{{Nd}}{{4}})?')) FROM z")
    even = "CASE WHEN category IN ('page_number', 'date', 'time') THEN replace(regexp_replace(v, '" + _S + "+', ' ', 'g'), ' ', '') ELSE trim(regexp_replace(v, '" + _S + "+', ' ', 'g')) END"
    return f"""WITH {_SPANS}, {BOXES}, p AS (SELECT manual_id, page, min(y0) AS py0, max(y1) - min(y0) AS ph FROM b GROUP BY ALL), z AS (SELECT s.* FROM s JOIN p USING (manual_id, page) WHERE s.y0 - py0 <= 0.15 * ph OR s.y1 - py0 >= 0.85 * ph),
    v AS ({' UNION ALL '.join(values)}), e AS (SELECT DISTINCT side, manual_id, page, category, {even} AS value, round(x0, 2) AS a, round(y0, 2) AS b, round(x1, 2) AS c, round(y1, 2) AS d FROM v)
    SELECT side, category, count(*) AS places, count(DISTINCT value) AS different FROM e GROUP BY side, category"""


_add("metadata_zones", metadata_zones, _metadata_sql())
_doubled = f"regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g')"
_add(
    "metadata_values",
    metadata_values,
    "WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category, replace(unnest(regexp_extract_all({_doubled}, '(?:^|[^\\p{{L}}\\p{{N}}_])(' || '{_marked_meta(p)}' || ')(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), chr(1), '') AS value FROM documents WHERE text IS NOT NULL" for n, p in _META.items())
    + rf" UNION ALL SELECT doc_id, 'confidential', unnest(regexp_extract_all(text, '(?i)CONFIDENTIAL(?:{_S}+\p{{Nd}}{{4}})?')) FROM documents WHERE text IS NOT NULL) SELECT category, value, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL",
)
_add("page_mode", lambda s, d: metrics.page_mode(table(s, d, "fragments")), f"WITH {BOXES}, n AS (SELECT manual_id, page, style, count(*) AS n FROM b WHERE style <> 0 GROUP BY ALL) SELECT manual_id, page, arg_max(style, (n, -style)) AS style, max(n) AS n FROM n GROUP BY manual_id, page")


def paragraph_ends(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end a paragraph as they stop short of their region, with the width that their region's lines have, and the padded box of cells."""
    b = table(spark, d, "fragments").dropDuplicates(["fragment_id"]).filter("region_id IS NOT NULL").select("fragment_id", "manual_id", "page", "region_id", "bbox")
    r = b.groupBy("manual_id", "page", "region_id").agg(F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"), F.count("*").alias("lines"))
    j = b.join(r, ["manual_id", "page", "region_id"])
    ends = geometry.ends_paragraph(F.col("bbox.x1"), F.col("x0"), F.col("x1"))
    cell = geometry.padded_cell(F.col("bbox"), F.lit(800.0))
    return j.select("fragment_id", ends.alias("ends"), F.round(geometry.width_budget(F.col("bbox.x0"), F.col("x0"), F.col("x1"), F.col("lines")), 4).alias("budget"), F.round(cell["x0"], 4).alias("left"), F.round(cell["y0"], 4).alias("low"))


_add(
    "paragraph_ends",
    paragraph_ends,
    f"""WITH {BOXES}, r AS (SELECT manual_id, page, region_id, min(x0) AS rx0, max(x1) AS rx1, count(*) AS lines FROM b WHERE region_id IS NOT NULL GROUP BY ALL)
    SELECT fragment_id, rx1 > rx0 AND x1 < rx0 + (rx1 - rx0) * 0.75 AS ends, round(CASE WHEN rx1 <= rx0 THEN 0 ELSE greatest(0, rx1 - greatest(x0, rx0)) + (lines - 1) * (rx1 - rx0) END, 4) AS budget,
    round(CASE WHEN x1 - 2 > x0 + 2 AND y1 - 1 > y0 + 1 THEN x0 + 2 END, 4) AS "left", round(CASE WHEN x1 - 2 > x0 + 2 AND y1 - 1 > y0 + 1 THEN 800 - y1 + 1 END, 4) AS low FROM b JOIN r USING (manual_id, page, region_id)""",
)


def formula_regions(spark: SparkSession, d: str) -> DataFrame:
    """Equations among the fragments, and tokens stacked to fractions."""
    return words.formula_regions(table(spark, d, "fragments"))


def structural_lines(spark: SparkSession, d: str) -> DataFrame:
    """The prose of every page's lines as a table of contents would have it, numbers and leaders left out."""
    f = table(spark, d, "fragments")
    pages = f.select("manual_id", "page").distinct().withColumn("kind", F.lit("TOC"))
    return words.structural_lines(words.words_of(f), pages).select("manual_id", "page", "block", "line", "text", F.round("render_x1", 4).alias("render_x1"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every page by columns and full lines; a fold over the page, without SQL."""
    return blocks.page_paragraphs(table(spark, d, "fragments")).select("manual_id", "page", "text", "x", "y", "lines", F.round("pitch", 4).alias("pitch"))


def font_fit(spark: SparkSession, d: str) -> DataFrame:
    """The size at which each translation fits the box of its rebuilt unit."""
    return fitting.font_fit(table(spark, d, "fragments"), table(spark, d, "logical_units"), table(spark, d, "occurrences"))


for _f in (formula_regions, structural_lines, page_paragraphs, font_fit):
    QUERIES[_f.__name__] = _f
_add(
    "layout_class",
    lambda s, d: words.layout_class(table(s, d, "fragments")),
    f"""WITH {BOXES}, r AS (SELECT manual_id, page, region_id AS region, {_box} FROM b WHERE region_id IS NOT NULL GROUP BY ALL)
    SELECT l.fragment_id, max(region) AS region FROM b l JOIN r ON {_PAGE} AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY 1""",
)
_add(
    "free_space",
    lambda s, d: fitting.free_space(table(s, d, "fragments")),
    f"""WITH {BOXES}, p AS (SELECT *, min(x0) OVER w AS px0, min(y0) OVER w AS py0, max(x1) OVER w AS px1, max(y1) OVER w AS py1 FROM b WINDOW w AS (PARTITION BY manual_id, page)),
    s AS (SELECT l.fragment_id, max(CASE WHEN r.x1 <= l.x0 THEN (r.x1 + l.x0) / 2 END) AS le, min(CASE WHEN r.x0 >= l.x1 THEN (l.x1 + r.x0) / 2 END) AS ri FROM b l JOIN b r ON {_PAGE} AND l.fragment_id <> r.fragment_id AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 0.5 GROUP BY 1),
    v AS (SELECT p.*, greatest(px0, coalesce(le, px0)) AS wl, least(px1, coalesce(ri, px1)) AS wr FROM p LEFT JOIN s USING (fragment_id)),
    u AS (SELECT l.fragment_id, max(CASE WHEN r.y1 <= l.y0 THEN (r.y1 + l.y0) / 2 END) AS t, min(CASE WHEN r.y0 >= l.y1 THEN (l.y1 + r.y0) / 2 END) AS d FROM v l JOIN b r ON {_PAGE} AND l.fragment_id <> r.fragment_id AND least(l.wr, r.x1) - greatest(l.wl, r.x0) > 1 GROUP BY 1)
    SELECT fragment_id, round(least(wl, x0), 4) AS x0, round(least(greatest(py0, coalesce(t, py0)), y0), 4) AS y0, round(greatest(wr, x1), 4) AS x1, round(greatest(least(py1, coalesce(d, py1)), y1), 4) AS y1 FROM v LEFT JOIN u USING (fragment_id)""",
)
_add("page_ordinal", lambda s, d: table(s, d, "fragments").dropDuplicates(["fragment_id"]).select("fragment_id", (F.row_number().over(Window.partitionBy("manual_id", "page").orderBy("reading_order", "fragment_id")) - 1).alias("ordinal")), f"WITH {BOXES} SELECT fragment_id, (row_number() OVER (PARTITION BY manual_id, page ORDER BY reading_order, fragment_id) - 1)::INT AS ordinal FROM b")


def line_pitch(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of the positive distances between the lines of a region, else one and a quarter of the height."""
    b = table(spark, d, "fragments").dropDuplicates(["fragment_id"]).filter("region_id IS NOT NULL").select("fragment_id", "manual_id", "page", "region_id", "bbox.y0", "bbox.y1")
    w = Window.partitionBy("manual_id", "page", "region_id").orderBy("y0", "fragment_id")
    g = b.withColumn("g", F.col("y0") - F.lag("y0").over(w))
    per = g.groupBy("manual_id", "page", "region_id").agg(F.array_sort(F.collect_list(F.when(F.col("g") > 0, F.col("g")))).alias("g"), F.max(F.col("y1") - F.col("y0")).alias("h"))
    middle = F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int"))
    return per.select("manual_id", "page", "region_id", F.round(F.when(F.size("g") > 0, middle).otherwise(F.col("h") * 1.25), 4).alias("pitch"))


_add(
    "line_pitch",
    line_pitch,
    f"""WITH {BOXES}, g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY manual_id, page, region_id ORDER BY y0, fragment_id) AS g FROM b WHERE region_id IS NOT NULL), l AS (SELECT manual_id, page, region_id, list(g ORDER BY g) FILTER (WHERE g > 0) AS g, max(y1 - y0) AS h FROM g GROUP BY ALL)
    SELECT manual_id, page, region_id, round(CASE WHEN len(g) > 0 THEN g[len(g) // 2 + 1] ELSE h * 1.25 END, 4) AS pitch FROM l""",
)
