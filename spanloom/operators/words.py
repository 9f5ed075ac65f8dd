"""Words and lines of pages: the boundary tables of a page reader, regions of formulas, and what of structural pages is prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.tokens import let
from spanloom.operators import rules
from spanloom.operators.geometry import PAGE, banded
from spanloom.operators.rules import _full

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: What a page reader delivers, one row per page: blocks of lines of spans. Images are blocks of type 1.
PAGE_SCHEMA = f"""manual_id string, page int, width double, height double, rotation int, blocks array<struct<type:int,bbox:{_BOX},lines:array<struct<bbox:{_BOX},dir:struct<x:double,y:double>,
spans:array<struct<text:string,bbox:{_BOX},size:double,flags:int,font:string,baseline:double,ascender:double,descender:double>>>>>>"""
TALL = 2.5  # a line's box that is so many times higher than its ink is not believed


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a reader's JSON-lines files."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def spans_of(pages: DataFrame) -> DataFrame:
    """(page keys, block, line, span, upright, text, box, size, style, font) of all spans, in the reader's order."""
    b = pages.select(*PAGE, F.posexplode("blocks").alias("block", "b"))
    lines = b.select(*PAGE, "block", F.posexplode("b.lines").alias("line", "l"))
    upright = (F.abs(F.col("l.dir.x") - 1) <= 0.01) & (F.abs(F.col("l.dir.y")) <= 0.01)
    boxed = lines.select(*PAGE, "block", "line", F.coalesce(upright, F.lit(True)).alias("upright"), line_box(F.col("l")).alias("line_box"), F.col("l.spans").alias("spans"))
    spans = boxed.select(*PAGE, "block", "line", "upright", "line_box", F.posexplode("spans").alias("span", "s"))  # apart: names inside structs are lost beside an explode
    flags = F.coalesce("s.flags", F.lit(0))
    style = F.when(flags.bitwiseAND(16) != 0, 1).otherwise(0) + F.when(flags.bitwiseAND(2) != 0, 2).otherwise(0)
    return spans.select(*PAGE, "block", "line", "span", "upright", "s.text", "s.bbox.*", "line_box", F.nullif(F.abs("s.size"), F.lit(0.0)).alias("size"), style.alias("style"), "s.font")


def line_box(line: Column) -> Column:
    """The box of a line: as reported, or that of its ink where fonts report boxes many times too high."""

    def ink(s: Column) -> Column:
        up = F.when(F.coalesce(s["ascender"], F.lit(0.9)).between(0.4, 1.5), F.coalesce(s["ascender"], F.lit(0.9))).otherwise(0.9)
        down = F.when(F.coalesce(s["descender"], F.lit(-0.2)).between(-0.6, 0.2), F.coalesce(s["descender"], F.lit(-0.2))).otherwise(-0.2)
        size = F.abs(s["size"])
        a, b = s["baseline"] - size * up, s["baseline"] - size * down
        return F.struct(s["bbox"]["x0"].alias("x0"), F.least(a, b).alias("y0"), s["bbox"]["x1"].alias("x1"), F.greatest(a, b).alias("y1"))

    known = F.filter(line["spans"], lambda s: s["bbox"].isNotNull() & s["baseline"].isNotNull() & (F.abs(s["size"]) > 0))
    edge = lambda seen, f, c: f(F.transform(seen, lambda s: s[c])).alias(c)
    around = let(lambda seen: F.struct(edge(seen, F.array_min, "x0"), edge(seen, F.array_min, "y0"), edge(seen, F.array_max, "x1"), edge(seen, F.array_max, "y1")), F.transform(known, ink))

    def choose(own: Column, ink_: Column) -> Column:
        height = ink_["y1"] - ink_["y0"]
        return F.when((height > 0) & (own["y1"] - own["y0"] > height * TALL), ink_).otherwise(own)

    return let(choose, line["bbox"], around)


def anchored_lines(spans: DataFrame) -> DataFrame:
    """Upright spans of lines that hold natural language, with the line's height, block and position as id."""
    line = Window.partitionBy(*PAGE, "block", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("t"))).over(line)), lambda s: s["t"]), "")
    kept = spans.filter("upright").withColumn("line_text", text).filter(rules.translate_cell(F.col("line_text")) & (F.coalesce("text", F.lit("")) != ""))
    key = F.concat_ws("-", F.lit("block"), "block", F.lit("line"), "line", F.lit("span"), "span")
    return kept.select(*PAGE, key.alias("fragment_id"), F.concat(F.lit("text-block-"), "block").alias("parent_id"), "text", F.coalesce("x0", "line_box.x0").alias("x0"), F.col("line_box.y0").alias("y0"), F.coalesce("x1", "line_box.x1").alias("x1"), F.col("line_box.y1").alias("y1"), "size", "style")


def page_kinds(pages: DataFrame) -> DataFrame:
    """(page keys, has_image, scanned): whether a page draws images, and one over more than half of it."""
    image = lambda b: F.coalesce(b["type"], F.lit(0)) == 1
    area = lambda b: F.greatest(F.lit(0.0), b["bbox"]["x1"] - b["bbox"]["x0"]) * F.greatest(F.lit(0.0), b["bbox"]["y1"] - b["bbox"]["y0"])
    page = F.col("width") * F.col("height")
    half = F.exists("blocks", lambda b: image(b) & F.coalesce(area(b) > page * 0.5, F.lit(False)))
    return pages.select(*PAGE, F.coalesce(F.exists("blocks", image), F.lit(False)).alias("has_image"), F.coalesce((page > 0) & half, F.lit(False)).alias("scanned"))


def write_options(pages: Column, size: Column) -> Column:
    """How to write a document: large ones (200 pages, 50 MB) quickly and without object streams."""
    large = (pages >= 200) | (size >= 50 * 1024 * 1024)
    return F.struct((~large).alias("deflate"), F.when(large, 1).otherwise(3).alias("garbage"), F.when(large, 0).otherwise(1).alias("object_streams"))


def outside_page(x0: Column, y0: Column, x1: Column, y1: Column, page: str) -> Column:
    """Whether a box lies wholly off its page."""
    p = lambda c: F.col(f"{page}.{c}")
    return (x1 <= p("x0")) | (x0 >= p("x1")) | (y1 <= p("y0")) | (y0 >= p("y1"))


def words_of(fragments: DataFrame) -> DataFrame:
    """(page keys, block, line, n, text, box): the words of each fragment, its width shared out by characters."""
    f = fragments.dropDuplicates(["fragment_id"]).filter("text IS NOT NULL AND text <> ''")
    block = F.coalesce("cell_id", "paragraph_id", "callout_id", "region_id", F.lit("page"))
    parts = F.split("text", " ")
    start = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, w: s + F.length(w) + 1)
    words = F.transform(parts, lambda w, i: F.struct(i.alias("n"), w.alias("text"), start(i).alias("at")))
    w = f.select(*PAGE, block.alias("block"), F.col("reading_order").alias("line"), F.length("text").alias("chars"), "bbox", F.explode(F.filter(words, lambda w: w["text"] != "")).alias("w"))
    x = lambda c: F.col("bbox.x0") + (F.col("bbox.x1") - F.col("bbox.x0")) * c / F.col("chars")
    return w.select(*PAGE, "block", "line", "w.n", "w.text", x(F.col("w.at")).alias("x0"), F.col("bbox.y0").alias("y0"), x(F.col("w.at") + F.length("w.text")).alias("x1"), F.col("bbox.y1").alias("y1"))


def upright_words(words: DataFrame, lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Words of upright lines that lie within the line's box; ``lines`` has page keys, block, line and box of the upright ones."""
    l = lines.select(*PAGE, "block", "line", *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    within = (F.col("x0") >= F.col("lx0") - tolerance) & (F.col("y0") >= F.col("ly0") - tolerance) & (F.col("x1") <= F.col("lx1") + tolerance) & (F.col("y1") <= F.col("ly1") + tolerance)
    return words.join(l, [*PAGE, "block", "line"]).filter(F.col("lx0").isNull() | within).select(*words.columns)


def stacked_tokens(words: DataFrame) -> DataFrame:
    """Boxes around pairs of short tokens with a figure, one above the other in different lines of a block: fractions set in place.

    They share three fifths of the smaller width, and their middles lie more than
    2 and at most 1.5 heights apart.
    """
    t = words.filter((F.length("text") <= 4) & F.col("text").rlike(r"\p{Nd}") & _full(F.col("text"), P.STACKED_TOKEN))
    # The middles of a pair lie within 1.5 heights, so bands around each box bring them together.
    reach = (F.col("y1") - F.col("y0")) * 1.5
    wide = banded(t.withColumns({"oy0": F.col("y0"), "oy1": F.col("y1")}).withColumns({"y0": F.col("oy0") - reach, "y1": F.col("oy1") + reach}))
    l, r = wide.alias("l"), wide.alias("r")
    before = F.struct("l.line", "l.n") < F.struct("r.line", "r.n")
    on = [*[F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*PAGE, "band", "block")], F.col("l.line") != F.col("r.line"), before]
    overlap = F.least("l.x1", "r.x1") - F.greatest("l.x0", "r.x0")
    smaller = F.least(F.col("l.x1") - F.col("l.x0"), F.col("r.x1") - F.col("r.x0"))
    gap = F.abs((F.col("l.oy0") + F.col("l.oy1")) / 2 - (F.col("r.oy0") + F.col("r.oy1")) / 2)
    height = F.greatest(F.col("l.oy1") - F.col("l.oy0"), F.col("r.oy1") - F.col("r.oy0"))
    pairs = l.join(r, on).filter((smaller > 0) & (overlap >= 0.6 * smaller) & (gap > 2) & (gap <= 1.5 * height))
    return pairs.select(*[F.col(f"l.{c}").alias(c) for c in PAGE], F.least("l.x0", "r.x0").alias("x0"), F.least("l.oy0", "r.oy0").alias("y0"), F.greatest("l.x1", "r.x1").alias("x1"), F.greatest("l.oy1", "r.oy1").alias("y1")).distinct()


def formula_regions(fragments: DataFrame) -> DataFrame:
    """(page keys, kind, box): blocks that are equations, and tokens stacked to fractions."""
    f = fragments.dropDuplicates(["fragment_id"]).filter(rules.is_equation(F.col("text")))
    equations = f.select(*PAGE, F.lit("equation").alias("kind"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return equations.unionByName(stacked_tokens(words_of(fragments)).withColumn("kind", F.lit("stacked")))


def structural_lines(words: DataFrame, kinds: DataFrame) -> DataFrame:
    """(page keys, block, line, text, box, render_x1): the prose of the lines of structural pages.

    Section numbers, leaders and page numbers of contents and indexes, symbols of
    nomenclatures and whole citations are left out. A line's words are few.
    ``kinds`` has page keys and kind.
    """
    line = words.groupBy(*PAGE, "block", "line").agg(F.array_sort(F.collect_list(F.struct("n", "text", "x0", "y0", "x1", "y1"))).alias("w"))
    rows = line.join(kinds.filter("kind IS NOT NULL").select(*PAGE, "kind"), PAGE)
    text = lambda w: F.array_join(F.transform(w, lambda x: x["text"]), " ")
    rows = rows.filter(~((F.col("kind") == "REFERENCES") & rules.holds(text("w"), P.CITATION)))
    n, first = F.size("w"), F.col("w")[0]["text"]
    contents = F.col("kind").isin("TOC", "INDEX")
    skip = ((F.col("kind") == "TOC") & (n > 1) & _full(first, P.SECTION_NUMBER)) | ((F.col("kind") == "NOMENCLATURE") & (n > 1) & ~rules.translate_cell(first))
    rows = rows.withColumn("start", F.when(skip, 1).otherwise(0))
    at = lambda p: F.transform("w", lambda x: _full(x["text"], p))
    rows = rows.withColumns({"leader": at(P.LEADER), "locator": at(P.LOCATOR)})
    leading = F.expr("array_min(filter(transform(leader, (x, i) -> if(x and i >= start, i, null)), x -> x is not null))")
    last = F.expr("array_max(filter(transform(locator, (x, i) -> if(not x, i, null)), x -> x is not null))")
    end = F.when(contents, F.coalesce(leading, F.greatest(F.coalesce(last + 1, F.lit(0)), F.col("start")))).otherwise(n)
    kept = rows.withColumn("end", end).withColumn("s", F.slice("w", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0))))
    kept = kept.withColumn("text", text("s")).filter((F.size("s") > 0) & rules.translate_cell(F.col("text")))
    edge = lambda f, c: f(F.transform("s", lambda x: x[c])).alias(c)
    after = F.array_min(F.transform(F.slice("w", F.col("end") + 1, F.greatest(F.size("w") - F.col("end"), F.lit(0))), lambda x: x["x0"]))
    out = kept.select(*PAGE, "kind", "block", "line", "text", edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"), F.when(contents, after).alias("after"))
    return out.select(*PAGE, "kind", "block", "line", "text", "x0", "y0", "x1", "y1", F.when(F.col("after") > F.col("x1") + 2, F.col("after") - 2).otherwise(F.col("x1")).alias("render_x1"))


def layout_class(fragments: DataFrame) -> DataFrame:
    """(fragment_id, region): the region that covers the middle of each fragment; of several the one painted last, by name."""
    f = fragments.dropDuplicates(["fragment_id"]).select("fragment_id", *PAGE, "region_id", "bbox")
    regions = f.filter("region_id IS NOT NULL").groupBy(*PAGE, F.col("region_id").alias("region")).agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    cx, cy = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    inside = f.drop("region_id").join(regions, PAGE).filter(cx.between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1")))
    return inside.groupBy("fragment_id").agg(F.max("region").alias("region"))
