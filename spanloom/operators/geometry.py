"""Boxes on pages: overlap joins, nearest neighbours, clusters, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["manual_id", "page"]
BAND = 24.0  # height of the bands that make the overlap join an equi-join


def boxes(fragments: DataFrame) -> DataFrame:
    """One row per fragment with its box as columns."""
    return fragments.dropDuplicates(["fragment_id"]).select("fragment_id", *PAGE, "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "style", "font_size", "reading_order")


def stacked_spans(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """(side, ord, span_id, page keys, text, box, size, block, line): fragments as source spans, rebuilt units as target spans."""
    f = fragments.dropDuplicates(["fragment_id"])
    block = F.coalesce("cell_id", "paragraph_id", "callout_id", "region_id", F.lit("page"))
    source = f.select(F.lit("source").alias("side"), F.col("reading_order").alias("ord"), F.col("fragment_id").alias("span_id"), *PAGE, "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", F.col("font_size").alias("size"), block.alias("block"), F.col("reading_order").alias("line"))
    per_line = (F.col("bbox.y1") - F.col("bbox.y0")) / F.greatest(F.lit(1), F.size("source_fragment_ids"))
    target = units.select(F.lit("target").alias("side"), F.lit(0).alias("ord"), F.col("logical_unit_id").alias("span_id"), *PAGE, "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", per_line.alias("size"), F.col("logical_unit_id").alias("block"), F.lit(0).alias("line"))
    both = source.unionByName(target).filter("text IS NOT NULL")
    return both.withColumn("text", F.trim(F.regexp_replace("text", "[ \t\n\r\xa0]+", " ")))


def area(s: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{s}.x1") - F.col(f"{s}.x0")) * F.greatest(F.lit(0.0), F.col(f"{s}.y1") - F.col(f"{s}.y0"))


def common(l: str, r: str) -> Column:
    width = F.least(f"{l}.x1", f"{r}.x1") - F.greatest(f"{l}.x0", f"{r}.x0")
    height = F.least(f"{l}.y1", f"{r}.y1") - F.greatest(f"{l}.y0", f"{r}.y0")
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def banded(boxes_: DataFrame) -> DataFrame:
    """Boxes once per horizontal band they touch, so that a join of boxes that meet is an equi-join."""
    return boxes_.withColumn("band", F.expr(f"explode(sequence(cast(floor(y0 / {BAND}) as int), cast(floor(y1 / {BAND}) as int)))"))


def touching(a: DataFrame, b: DataFrame, extra: Column) -> DataFrame:
    """Pairs (l, r) of boxes of a page that share area, each once: in the first band that both touch."""
    l, r = banded(a).alias("l"), banded(b).alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*PAGE, "band")]
    first = F.floor(F.greatest("l.y0", "r.y0") / BAND).cast("int")
    return l.join(r, [*on, common("l", "r") > 0, extra]).filter(F.col("l.band") == first)


def overlap_pairs(spans: DataFrame, least: float = 0.35, smallest: float = 9.0) -> DataFrame:
    """Pairs of spans of a page, of two characters or more and not of one line, whose common area counts.

    It counts from ``smallest`` square units and ``least`` of the smaller box. ``spans``
    has span_id, text, box, block and line.
    """
    b = spans.filter("x1 > x0 AND y1 > y0 AND length(text) >= 2")
    other = (F.col("l.span_id") < F.col("r.span_id")) & ((F.col("l.block") != F.col("r.block")) | (F.col("l.line") != F.col("r.line")))
    ratio = common("l", "r") / F.least(area("l"), area("r"))
    kept = touching(b, b, other).filter((common("l", "r") >= smallest) & (ratio >= least))
    return kept.select(F.col("l.span_id").alias("a"), F.col("r.span_id").alias("b"), F.round(ratio, 4).alias("ratio"))


def bbox_union(fragments: DataFrame) -> DataFrame:
    """The box around all fragments of a page."""
    return boxes(fragments).groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("fragments"))


def x_clusters(fragments: DataFrame) -> DataFrame:
    """Clusters along x of each table region of a page, with the cell that each gets.

    A cluster ends where a box begins beyond the reach so far by more than
    max(3, 0.6 of the median height). Its cell goes from the middle of the gap
    on its left to that on its right, or to the region's edge.
    """
    b = fragments.dropDuplicates(["fragment_id"]).filter("region_id IS NOT NULL AND structural_role = 'table_cell'").select("fragment_id", *PAGE, "region_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").filter("x1 >= x0")
    region = Window.partitionBy(*PAGE, "region_id")
    order = region.orderBy("x0", "y0", "fragment_id")
    gap = F.greatest(F.lit(3.0), 0.6 * F.median(F.greatest(F.lit(0.1), F.col("y1") - F.col("y0"))).over(region))
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = b.withColumns({"gap": gap, "reach": reach, "left_edge": F.min("x0").over(region), "right_edge": F.max("x1").over(region)})
    grouped = marked.withColumn("new", F.when(F.col("reach").isNull() | (F.col("x0") > F.col("reach") + F.col("gap")), 1).otherwise(0))
    grouped = grouped.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = grouped.groupBy(*PAGE, "region_id", "cluster").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("fragments"), F.first("left_edge").alias("le"), F.first("right_edge").alias("re"))
    along = region.orderBy("cluster")
    left = F.coalesce((F.lag("x1").over(along) + F.col("x0")) / 2, "le")
    right = F.coalesce((F.col("x1") + F.lead("x0").over(along)) / 2, "re")
    return per.select(*PAGE, "region_id", "cluster", "x0", "x1", "fragments", F.round(left, 4).alias("cell_x0"), F.round(right, 4).alias("cell_x1"))


def height_below(fragments: DataFrame, shared: float = 0.1) -> DataFrame:
    """Height that each fragment may fill: down to the nearest box under it that shares its column, else to the page's lowest edge.

    A box shares the column if more than ``shared`` of the fragment's width lies
    above it; one that begins more than half a unit above the fragment's lower
    edge lies beside it. The fragment's own height is the least. A theta join
    within the page: one exchange by page serves both sides and the minimum.
    """
    b = boxes(fragments).select(*PAGE, "fragment_id", F.array("x0", "y0", "x1", "y1").alias("q")).repartition(*PAGE)
    floor = Window.partitionBy(*PAGE)
    b = b.withColumn("floor", F.max(F.col("q")[3]).over(floor))
    l, r = b.alias("l"), b.alias("r")
    x0, y0, x1, y1 = range(4)
    at = lambda s, i: F.col(f"{s}.q")[i]
    width = at("l", x1) - at("l", x0)
    overlap = F.least(at("l", x1), at("r", x1)) - F.greatest(at("l", x0), at("r", x0))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in PAGE]
    under = l.join(r, [*on, F.col("l.fragment_id") != F.col("r.fragment_id"), (width <= 0) | (overlap > shared * width), at("r", y0) >= at("l", y1) - 0.5], "left")
    near = under.groupBy(*[F.col(f"l.{c}") for c in (*PAGE, "fragment_id")]).agg(F.min(at("l", y0)).alias("y0"), F.min(at("l", y1)).alias("y1"), F.coalesce(F.min(at("r", y0)), F.first("l.floor")).alias("below"))
    return near.select("fragment_id", F.round(F.greatest(F.col("below") - F.col("y0"), F.col("y1") - F.col("y0")), 4).alias("height"))


def cell_partition(fragments: DataFrame) -> DataFrame:
    """Slices of each region that its fragments get without overlap: bands by height, then parts of a band by width.

    A fragment joins the band of the one before if their middles are within half
    of the taller one's height; bands are cut halfway between their mean middles.
    """
    b = fragments.dropDuplicates(["fragment_id"]).filter("region_id IS NOT NULL").select("fragment_id", *PAGE, "region_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    region = Window.partitionBy(*PAGE, "region_id")
    b = b.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "cx": (F.col("x0") + F.col("x1")) / 2, "h": F.col("y1") - F.col("y0"), "rx0": F.min("x0").over(region), "ry0": F.min("y0").over(region), "rx1": F.max("x1").over(region), "ry1": F.max("y1").over(region)})
    down = region.orderBy("cy", "cx", "fragment_id")
    joins = F.abs(F.col("cy") - F.lag("cy").over(down)) <= 0.5 * F.greatest("h", F.lag("h").over(down))
    b = b.withColumn("new", F.when(joins, 0).otherwise(1))
    b = b.withColumn("band", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    middles = b.groupBy(*PAGE, "region_id", "band").agg(F.avg("cy").alias("m"))
    along = region.orderBy("band")
    cuts = middles.select(*PAGE, "region_id", "band", ((F.lag("m").over(along) + F.col("m")) / 2).alias("top"), ((F.col("m") + F.lead("m").over(along)) / 2).alias("bottom"))
    across = Window.partitionBy(*PAGE, "region_id", "band").orderBy("cx", "fragment_id")
    b = b.withColumns({"left": (F.lag("cx").over(across) + F.col("cx")) / 2, "right": (F.col("cx") + F.lead("cx").over(across)) / 2})
    cut = b.join(cuts, [*PAGE, "region_id", "band"])
    r = lambda c, edge: F.round(F.coalesce(c, edge), 4)
    return cut.select("fragment_id", r("left", "rx0").alias("x0"), r("top", "ry0").alias("y0"), r("right", "rx1").alias("x1"), r("bottom", "ry1").alias("y1"))


def cells_of(fragments: DataFrame) -> DataFrame:
    """(page keys, region_id, cell_id, box) of the table cells: the boxes around the fragments of one cell."""
    f = fragments.dropDuplicates(["fragment_id"]).filter("cell_id IS NOT NULL")
    return f.groupBy(*PAGE, "region_id", "cell_id").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def words_in_cells(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """(page keys, cell_id, units): rebuilt units whose middle lies in a cell, by a range join within the page."""
    cells = cells_of(fragments).alias("c")
    u = units.select(*PAGE, ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias("cx"), ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("cy"))
    inside = cells.join(u, PAGE).filter("cx BETWEEN c.x0 AND c.x1 AND cy BETWEEN c.y0 AND c.y1")
    return inside.groupBy(*PAGE, "region_id", "cell_id").agg(F.count("*").alias("units"))


def best_overlap(fragments: DataFrame, least: float = 0.5) -> DataFrame:
    """(page keys, region_id, parent_id, overlap, cells): the table that covers most of a region, if half of it at least, and the cells whose middle lies in the region.

    Regions stand for detections and parents for tables; of equal overlaps the
    first by name wins.
    """
    f = fragments.dropDuplicates(["fragment_id"]).select(*PAGE, "region_id", "parent_id", "cell_id", "bbox")
    box = [F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")]
    models = f.filter("region_id IS NOT NULL").groupBy(*PAGE, "region_id").agg(*box).alias("l")
    tables = f.filter("parent_id IS NOT NULL").groupBy(*PAGE, "parent_id").agg(*box).alias("r")
    ratio = common("l", "r") / area("l")
    both = models.join(tables, PAGE).filter(area("l") > 0).select(*PAGE, "region_id", F.col("l.x0"), F.col("l.y0"), F.col("l.x1"), F.col("l.y1"), "parent_id", ratio.alias("overlap"))
    best = both.groupBy(*PAGE, "region_id", "x0", "y0", "x1", "y1").agg(F.max("overlap").alias("overlap"), F.min_by("parent_id", F.struct(-F.col("overlap"), F.col("parent_id"))).alias("parent_id")).filter(F.col("overlap") >= least)
    cells = cells_of(fragments).select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    inside = best.join(cells, PAGE, "left").withColumn("in", F.expr("cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1"))
    return inside.groupBy(*PAGE, "region_id", "parent_id", F.round("overlap", 4).alias("overlap")).agg(F.count_if("in").alias("cells"))


def padded_cell(box: Column, page_height: Column) -> Column:
    """A cell's box seen from the page's lower edge, two units narrower on either side and one lower and upper; null if nothing is left."""
    made = F.struct((box["x0"] + 2.0).alias("x0"), (page_height - box["y1"] + 1.0).alias("y0"), (box["x1"] - 2.0).alias("x1"), (page_height - box["y0"] - 1.0).alias("y1"))
    return F.when((made["x1"] > made["x0"]) & (made["y1"] > made["y0"]), made)


def width_budget(x: Column, x0: Column, x1: Column, lines: Column) -> Column:
    """Width of a paragraph's lines, its first one from where it begins."""
    return F.when((lines <= 0) | (x1 <= x0), 0.0).otherwise(F.greatest(F.lit(0.0), x1 - F.greatest(x, x0)) + F.greatest(F.lit(0), lines - 1) * (x1 - x0))


def ends_paragraph(line_end: Column, x0: Column, x1: Column, ratio: float = 0.75) -> Column:
    """Whether a line that stops here, short of its column, is the last of its paragraph; false without a column."""
    return F.coalesce((x1 > x0) & (line_end < x0 + (x1 - x0) * ratio), F.lit(False))


def outside(s: str, page: str, tolerance: float = 1.0) -> Column:
    """Whether a box reaches beyond another by more than the tolerance."""
    c = lambda n: F.col(f"{s}.{n}")
    q = lambda n: F.col(f"{page}.{n}")
    return (c("x0") < q("x0") - tolerance) | (c("y0") < q("y0") - tolerance) | (c("x1") > q("x1") + tolerance) | (c("y1") > q("y1") + tolerance)


def material_spill(s: str, cell: str, share: float = 0.2) -> Column:
    """Whether a span of two characters or more leaves its cell by a fifth of its width or height."""
    c = lambda n: F.col(f"{s}.{n}")
    q = lambda n: F.col(f"{cell}.{n}")
    across = F.greatest(q("x0") - c("x0"), c("x1") - q("x1"), F.lit(0.0)) / F.greatest(F.lit(1.0), c("x1") - c("x0"))
    down = F.greatest(q("y0") - c("y0"), c("y1") - q("y1"), F.lit(0.0)) / F.greatest(F.lit(1.0), c("y1") - c("y0"))
    return (F.length(c("text")) >= 2) & ((across >= share) | (down >= share))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0"))
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    return w * h / (area(a) + area(b) - w * h)


def neighbour_iou(fragments: DataFrame) -> DataFrame:
    """IoU of each fragment with the next in reading order."""
    once = fragments.dropDuplicates(["fragment_id"])
    order = Window.partitionBy(*PAGE).orderBy("reading_order", "fragment_id")
    pairs = once.select("fragment_id", F.col("bbox").alias("a"), F.lead("bbox").over(order).alias("b")).filter("b IS NOT NULL")
    return pairs.select("fragment_id", F.round(iou("a", "b"), 4).alias("iou"))
