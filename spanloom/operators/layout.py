"""Checks of rendered pages and orderings over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.scripts import has_syllables
from spanloom.functions.tokens import matches
from spanloom.operators.geometry import PAGE, area, banded, boxes, common, material_spill, outside, touching
from spanloom.operators.units import KIND

MICRO, USED, ENLARGED = 0.55, 0.35, 0.5  # font against the source's, share of the cell, tolerance of the enlarged box
HEADER, FOOTER = 0.15, 0.85  # shares of the page's height


def _iou(l: str, r: str) -> Column:
    both = area(l) + area(r) - common(l, r)
    return F.when(both > 0, common(l, r) / both).otherwise(0.0)


def _pairs(spans: DataFrame, kind: str) -> DataFrame:
    """Pairs of spans of a page that collide, or that draw the same text twice, with the box around both."""
    b = spans.filter("x1 > x0 AND y1 > y0")
    later = F.struct("l.ord", "l.span_id") < F.struct("r.ord", "r.span_id")
    met = touching(b, b, later)
    if kind == "overlap":
        apart = (F.col("l.block") != F.col("r.block")) | (F.col("l.line") != F.col("r.line"))
        met = met.filter(apart & (F.length("l.text") >= 2) & (F.length("r.text") >= 2) & (common("l", "r") >= 9.0) & (common("l", "r") >= 0.35 * F.least(area("l"), area("r"))))
    else:
        met = met.filter((F.col("l.text") != "") & (F.col("l.text") == F.col("r.text")) & (_iou("l", "r") >= 0.8))
    around = [F.least("l.x0", "r.x0").alias("x0"), F.least("l.y0", "r.y0").alias("y0"), F.greatest("l.x1", "r.x1").alias("x1"), F.greatest("l.y1", "r.y1").alias("y1")]
    return met.select(*[F.col(f"l.{c}").alias(c) for c in PAGE], F.col("l.text").alias("first"), F.col("r.text").alias("second"), *around)


def _new(target: DataFrame, source: DataFrame, least: float) -> DataFrame:
    """Pairs of the target without one of the source around nearly the same box."""
    l, r = target.alias("l"), source.alias("r")
    return l.join(r, [*[F.col(f"l.{c}") == F.col(f"r.{c}") for c in PAGE], _iou("l", "r") >= least], "left_anti")


def warnings(spans: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(page keys, kind, x0, y0, x1, y1, detail): what a rebuilt page has that its source has not.

    ``spans`` are those of ``geometry.stacked_spans``, ``cells`` and ``pages`` boxes.
    Kinds: page_out_of_bounds and table_cell_spill (as many offenders as the
    source has are excused, in order), new_text_overlap and
    translated_retained_overlap, duplicate_local_render, suspicious_micro_font.
    Warnings of one kind and place (to a tenth) are one.
    """
    source, target = spans.filter("side = 'source'"), spans.filter("side = 'target'")
    box = lambda s: [F.col(f"{s}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    keys = lambda s: [F.col(f"{s}.{c}").alias(c) for c in PAGE]
    on_page = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in PAGE]

    beyond = spans.alias("s").join(pages.alias("p"), on_page).filter(outside("s", "p")).select(*keys("s"), "s.side", "s.ord", "s.span_id", F.substring("s.text", 1, 80).alias("detail"), *box("s"))
    bounds = _excuse(beyond, [*PAGE]).select(*PAGE, F.lit("page_out_of_bounds").alias("kind"), "x0", "y0", "x1", "y1", "detail")

    texts = source.filter("text <> ''").select(*PAGE, "text").distinct()
    pairs = _new(_pairs(target, "overlap"), _pairs(source, "overlap"), 0.5)
    for side in ("first", "second"):
        pairs = pairs.join(texts.select(*PAGE, F.col("text").alias(side), F.lit(True).alias(f"{side}_kept")), [*PAGE, side], "left")
    kept = F.coalesce("first_kept", F.lit(False)) != F.coalesce("second_kept", F.lit(False))
    overlaps = pairs.select(*PAGE, F.when(kept, "translated_retained_overlap").otherwise("new_text_overlap").alias("kind"), "x0", "y0", "x1", "y1", F.concat(F.substring("first", 1, 40), F.lit(" overlaps "), F.substring("second", 1, 40)).alias("detail"))

    twice = _new(_pairs(target, "twice"), _pairs(source, "twice"), 0.8).select(*PAGE, F.lit("duplicate_local_render").alias("kind"), "x0", "y0", "x1", "y1", F.substring("first", 1, 80).alias("detail"))

    c = cells.alias("c")
    middle = ((F.col("s.x0") + F.col("s.x1")) / 2).between(F.col("c.x0"), F.col("c.x1")) & ((F.col("s.y0") + F.col("s.y1")) / 2).between(F.col("c.y0"), F.col("c.y1"))
    inside = spans.alias("s").join(c, [*[F.col(f"s.{k}") == F.col(f"c.{k}") for k in PAGE], middle])
    spilled = inside.filter(material_spill("s", "c")).select(*keys("s"), F.col("c.cell_id").alias("cell"), "s.side", "s.ord", "s.span_id", F.substring("s.text", 1, 80).alias("detail"), *box("s"))
    spills = _excuse(spilled, [*PAGE, "cell"]).select(*PAGE, F.lit("table_cell_spill").alias("kind"), "x0", "y0", "x1", "y1", "detail")

    size = lambda side: F.median(F.when((F.col("s.side") == side) & (F.col("s.size") > 0), F.col("s.size")))
    of = lambda f, n: f(F.when(F.col("s.side") == "target", F.col(f"s.{n}")))
    per = inside.groupBy(*keys("s"), F.struct("c.x0", "c.y0", "c.x1", "c.y1").alias("c")).agg(size("source").alias("was"), size("target").alias("now"), of(F.min, "x0").alias("x0"), of(F.min, "y0").alias("y0"), of(F.max, "x1").alias("x1"), of(F.max, "y1").alias("y1"))
    small = per.filter((F.col("was") > 0) & (F.col("now") > 0) & (F.col("now") / F.col("was") <= MICRO))
    grown = F.col("was") / F.col("now")
    cell_area = (F.col("c.x1") - F.col("c.x0")) * (F.col("c.y1") - F.col("c.y0"))
    roomy = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= USED * cell_area
    fits = (F.col("x0") >= F.col("c.x0") - ENLARGED) & (F.col("y0") >= F.col("c.y0") - ENLARGED) & (F.col("x0") + (F.col("x1") - F.col("x0")) * grown <= F.col("c.x1") + ENLARGED) & (F.col("y0") + (F.col("y1") - F.col("y0")) * grown <= F.col("c.y1") + ENLARGED)
    micro = small.filter((cell_area > 0) & roomy & fits).select(*PAGE, F.lit("suspicious_micro_font").alias("kind"), "x0", "y0", "x1", "y1", F.format_string("%.2f of %.2f", "now", "was").alias("detail"))

    found = bounds.unionByName(overlaps).unionByName(twice).unionByName(spills).unionByName(micro)
    place = [F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return found.groupBy(*PAGE, "kind", *place).agg(F.min("detail").alias("detail"))


def _excuse(offenders: DataFrame, keys: list[str]) -> DataFrame:
    """The target's offenders beyond as many as the source has, in order."""
    order = Window.partitionBy(*keys, "side").orderBy("ord", "span_id")
    excused = F.count_if(F.col("side") == "source").over(Window.partitionBy(*keys))
    return offenders.withColumns({"k": F.row_number().over(order), "n": excused}).filter("side = 'target' AND k > n")


def metadata_values(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(side, page keys, category, value, box): metadata of header and footer lines, each value of a place once."""
    on = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in PAGE]
    height = F.col("p.y1") - F.col("p.y0")
    zone = (F.col("s.y0") - F.col("p.y0") <= HEADER * height) | (F.col("s.y1") - F.col("p.y0") >= FOOTER * height)
    lines = spans.alias("s").join(pages.alias("p"), on).filter(zone).select("s.*")
    single = lambda v: F.regexp_replace(v, f"[{P.SPACE}]+", " ")
    solid = ("page_number", "date", "time")  # values that are written with and without spaces
    even = lambda n: (lambda v: F.replace(single(v), F.lit(" "), F.lit(""))) if n in solid else (lambda v: F.trim(single(v)))
    each = F.array(*[F.struct(F.lit(n).alias("category"), F.transform(matches(F.col("text"), p), even(n)).alias("v")) for n, p in P.METADATA.items()])
    rows = lines.withColumn("m", F.explode(each)).select("side", *PAGE, "m.category", F.explode("m.v").alias("value"), *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return rows.distinct()


def metadata_warnings(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(page keys, kind, category, detail): metadata that changed between source and target, values broken up, and East Asian text left in headers and footers."""
    found = metadata_values(spans, pages)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("value"))))
    # The values of one category in one page's header and footer are few.
    per = found.groupBy(*PAGE, "category").agg(side("source").alias("was"), side("target").alias("now")).filter("was <> now")
    changed = per.select(*PAGE, F.when(F.col("category") == "page_number", "page_number_mismatch").otherwise("immutable_metadata_mismatch").alias("kind"), "category", F.concat(F.array_join("was", "|"), F.lit(" > "), F.array_join("now", "|")).alias("detail"))
    compact = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    lost = found.filter("side = 'source'").join(found.filter("side = 'target'").select(*PAGE, "category", "value"), [*PAGE, "category", "value"], "left_anti").withColumn("k", compact("value")).filter("length(k) >= 6")
    t = spans.filter("side = 'target'").alias("r")
    near = lost.alias("l").join(t, [*[F.col(f"l.{c}") == F.col(f"r.{c}") for c in PAGE], common("l", "r") >= 0.2 * F.least(area("l"), area("r"))])
    around = near.groupBy(*[F.col(f"l.{c}").alias(c) for c in (*PAGE, "category", "value", "k")]).agg(F.array_join(F.array_sort(F.collect_list(compact("r.text"))), " ").alias("around"))
    broken = ~F.contains("around", F.col("k")) & F.exists(F.sequence(F.lit(1), F.length("k") - 3), lambda i: F.contains("around", F.substring("k", i, F.lit(4))))
    fragments = around.filter(broken).select(*PAGE, F.lit("metadata_fragmentation").alias("kind"), "category", F.col("value").alias("detail"))
    on = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in PAGE]
    height = F.col("p.y1") - F.col("p.y0")
    zone = (F.col("s.y0") - F.col("p.y0") <= HEADER * height) | (F.col("s.y1") - F.col("p.y0") >= FOOTER * height)
    left = spans.filter("side = 'target'").alias("s").join(pages.alias("p"), on).filter(zone & F.col("s.text").rlike(P.RESIDUAL_CJK)).select(*[F.col(f"s.{c}").alias(c) for c in PAGE], F.lit("header_footer_untranslated_prose").alias("kind"), F.lit("").alias("category"), F.substring("s.text", 1, 80).alias("detail"))
    return changed.unionByName(fragments).unionByName(left).distinct()


def geometry_kinds(fragments: DataFrame) -> DataFrame:
    """How neighbours in reading order lie to each other, counted."""
    once = boxes(fragments)
    order = Window.partitionBy(*PAGE).orderBy("reading_order", "y0", "x0", "fragment_id")
    cur = once.select(*PAGE, "reading_order", "fragment_id", *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")], "y0", "x0")
    prev = cur.withColumn("p", F.lag(F.struct("c_x0", "c_y0", "c_x1", "c_y1")).over(order)).filter("p IS NOT NULL")
    named = prev.select("*", *[F.col(f"p.c_{c}").alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    return named.groupBy(F.coalesce(F.expr(KIND), F.lit("none")).alias("kind")).agg(F.count("*").alias("pairs"))


def smallest_parent(fragments: DataFrame) -> DataFrame:
    """The smallest region box of the page that contains each fragment; regions are few per page, so the join is an equi-join on it."""
    once = fragments.dropDuplicates(["fragment_id"]).select("fragment_id", *PAGE, "region_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    regions = once.filter("region_id IS NOT NULL").groupBy(*PAGE, "region_id").agg(F.min("x0").alias("rx0"), F.min("y0").alias("ry0"), F.max("x1").alias("rx1"), F.max("y1").alias("ry1"))
    inside = once.drop("region_id").join(regions, PAGE).filter("x0 >= rx0 AND x1 <= rx1 AND y0 >= ry0 AND y1 <= ry1")
    area = (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))
    return inside.groupBy("fragment_id").agg(F.min(F.struct(area.alias("a"), F.col("region_id").alias("r"))).alias("m")).select("fragment_id", F.col("m.r").alias("parent"), F.round("m.a", 2).alias("area"))


def right_limits(fragments: DataFrame, margin: float = 40.0, edge: float = 3.0) -> DataFrame:
    """How far right each fragment may be set: to the nearest box beside it, or the page's margin; the least of its column counts.

    A column is a run of left edges no more than ``edge`` apart. A fragment
    never gets less than its own width.
    """
    b = boxes(fragments)
    l, r = banded(b).alias("l"), banded(b).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*PAGE, "band")]
    near = l.join(r, [*on, F.col("l.fragment_id") != F.col("r.fragment_id"), F.col("r.x0") >= F.col("l.x1") - edge, F.least("l.y1", "r.y1") > F.greatest("l.y0", "r.y0")])
    beside = near.groupBy(F.col("l.fragment_id").alias("fragment_id")).agg(F.min("r.x0").alias("beside"))
    page = Window.partitionBy(*PAGE)
    along = page.orderBy("x0", "fragment_id")
    own = b.select("fragment_id", *PAGE, "x0", "x1").join(beside, "fragment_id", "left")
    own = own.withColumn("limit", F.least(F.max("x1").over(page) - margin, F.coalesce("beside", F.lit(float("inf")))))
    new = F.when(F.col("x0") - F.lag("x0").over(along) <= edge, 0).otherwise(1)
    columns = own.withColumn("new", new).withColumn("col", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min("limit").over(Window.partitionBy(*PAGE, "col"))
    return columns.select("fragment_id", F.round(F.greatest(least - edge, F.col("x1")), 4).alias("limit"))


def line_offsets(fragments: DataFrame, line_height: float = 1.1, budget: float | None = 20.0) -> DataFrame:
    """Distance of each line of a region from its first one: usual leading, and more for taller lines, shared out if it exceeds the budget."""
    b = fragments.dropDuplicates(["fragment_id"]).filter("region_id IS NOT NULL").select("fragment_id", *PAGE, "region_id", "reading_order", F.coalesce("font_size", F.col("bbox.y1") - F.col("bbox.y0")).alias("size"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    region = Window.partitionBy(*PAGE, "region_id")
    order = region.orderBy("reading_order", "fragment_id")
    base = F.col("size") * line_height
    b = b.withColumns({"base": base, "extra": F.greatest(F.lit(0.0), F.coalesce(F.lead("h").over(order), F.lit(0.0)) - base)})
    total = F.sum("extra").over(region)
    scale = F.when(total > budget, budget / total).otherwise(1.0) if budget is not None else F.lit(1.0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("step", F.col("base") + F.col("extra") * scale)
    return b.select("fragment_id", F.round(F.coalesce(F.sum("step").over(before), F.lit(0.0)), 4).alias("offset"))


def excess_rows(targets: DataFrame, sources: DataFrame, key: str, order: str) -> DataFrame:
    """(key, excess): copies of a text on a page beyond as many as the sources have, in order; the first so many are excused.

    Both have the page keys and ``text``; repeated rows of ``targets`` (by ``key``) count once. Texts that
    the sources lack are none of this operator's business.
    """
    once = targets.filter("text IS NOT NULL").select(key, *PAGE, "text", order).dropDuplicates([key])
    allowed = sources.groupBy(*PAGE, "text").agg(F.count("*").alias("_allowed"))
    w = Window.partitionBy(*PAGE, "text").orderBy(order, key)
    ranked = once.withColumn("_rank", F.row_number().over(w)).join(allowed, [*PAGE, "text"])
    return ranked.filter("_rank > _allowed").select(key, (F.col("_rank") - F.col("_allowed")).alias("excess"))


def greedy_batches(segments: DataFrame, most_items: int = 30, most_chars: int = 12_000) -> DataFrame:
    """(segment_id, batch): batches of each manual in queue order, closed at the item or character limit.

    A Korean source also counts its context if both fit together. The fold is
    sequential by definition, so a manual is one stream of rows: sorted within
    its partition and read batch by batch with constant memory, never gathered.
    Longer items than the limit stand alone as batch -1.
    """
    n, c = F.coalesce(F.length("src"), F.lit(0)), F.coalesce(F.length("context.text"), F.lit(0))
    once = segments.dropDuplicates(["segment_id"]).select("segment_id", "manual_id", "queued_at", (n + F.when((n + c <= most_chars) & has_syllables(F.col("src")), c).otherwise(0)).alias("n"))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        manual, batch, items, chars = object(), 0, 0, 0
        for part in parts:
            out = []
            for key, m, n in zip(part["segment_id"], part["manual_id"], part["n"], strict=True):
                if m != manual:
                    manual, batch, items, chars = m, 0, 0, 0
                if n > most_chars:
                    out.append((key, -1))
                    continue
                if items and (items >= most_items or chars + n > most_chars):
                    batch, items, chars = batch + 1, 0, 0
                items, chars = items + 1, chars + n
                out.append((key, batch))
            yield pd.DataFrame(out, columns=["segment_id", "batch"])

    ordered = once.repartition("manual_id").sortWithinPartitions("manual_id", "queued_at", "segment_id")
    return ordered.mapInPandas(fold, "segment_id string, batch long")
