"""Logical units: fragments in reading order joined into paragraphs (gaps and islands).

Each fragment is judged against the one right before it; a rejection starts a
new unit. Unknown ids never equal or differ from anything, except that a cell
id known on one side only is a boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.patterns import SPACE

#: The ordered ladder over columns p_* (previous) and c_* (current); the same text runs in other SQL engines.
DECISION = """CASE
 WHEN p_id IS NULL THEN 'first'
 WHEN p_page <> c_page THEN 'rejected_page_boundary'
 WHEN (p_cell IS NULL) <> (c_cell IS NULL) OR coalesce(p_cell <> c_cell, false) THEN 'rejected_cross_cell'
 WHEN coalesce(p_column <> c_column, false) THEN 'rejected_cross_column'
 WHEN p_role <> c_role THEN 'rejected_structural_role'
 WHEN coalesce(p_size > 0 AND c_size > 0 AND greatest(p_size, c_size) >= 1.3 * least(p_size, c_size), false) AND least(p_y1, c_y1) - greatest(p_y0, c_y0) <= 0 THEN 'rejected_structural_role'
 WHEN coalesce(p_callout <> c_callout, false) OR coalesce(p_region <> c_region, false) OR coalesce(p_paragraph <> c_paragraph, false) THEN 'rejected_structural_role'
 WHEN NOT (coalesce(p_cell = c_cell, false) OR coalesce(p_paragraph = c_paragraph, false) OR coalesce(p_callout = c_callout, false) OR coalesce(p_region = c_region, false) OR coalesce(p_parent = c_parent, false)) THEN 'rejected_structural_role'
 WHEN {kind} IS NULL OR barred THEN 'rejected_geometry'
 WHEN {kind} = 'wrapped' AND NOT (coalesce(p_cell = c_cell, false) OR coalesce(p_paragraph = c_paragraph, false) OR coalesce(p_callout = c_callout, false)) AND (p_chars < 8 OR p_x1 - p_x0 < 6 * greatest(1.0, p_y1 - p_y0)) THEN 'rejected_linguistic_boundary'
 WHEN {kind} = 'wrapped' AND (p_ends OR c_starts) THEN 'rejected_linguistic_boundary'
 WHEN {kind} = 'same_line' THEN CASE WHEN p_style <> c_style THEN 'inline_emphasis' ELSE 'same_line_continuation' END
 WHEN coalesce(p_cell = c_cell, false) THEN 'same_cell_continuation'
 WHEN coalesce(p_paragraph = c_paragraph, false) THEN 'same_paragraph'
 WHEN coalesce(p_callout = c_callout, false) THEN 'callout_continuation'
 ELSE 'wrapped_line' END"""
#: How two boxes lie to each other: on one line, wrapped below, or neither (null).
_HEIGHT = "greatest(1.0, p_y1 - p_y0, c_y1 - c_y0)"
KIND = f"""CASE
 WHEN least(p_y1, c_y1) - greatest(p_y0, c_y0) >= 0.5 * least(greatest(1.0, p_y1 - p_y0), greatest(1.0, c_y1 - c_y0)) THEN
  CASE WHEN c_x0 - p_x1 BETWEEN -0.35 * {_HEIGHT} AND 2.0 * {_HEIGHT} THEN 'same_line' END
 WHEN c_y0 - p_y1 BETWEEN -0.35 * {_HEIGHT} AND 1.35 * {_HEIGHT}
  AND (greatest(0.0, least(p_x1, c_x1) - greatest(p_x0, c_x0)) >= 0.2 * greatest(1.0, least(p_x1 - p_x0, c_x1 - c_x0)) OR abs(c_x0 - p_x0) <= 4.5 * {_HEIGHT})
  AND c_x0 <= p_x1 + 1.5 * {_HEIGHT} THEN 'wrapped' END"""
DECISION = DECISION.replace("{kind}", f"({KIND})")
# How sentences end and items begin. Tags do not count as characters.
ENDS = "[.!?。！？][\\])}'\"”’]*$"
STARTS = f"^[{SPACE}]*(?:=>|⇒|→|[-–—•■□▪▸▹►▶●○◆◇]|[0-9]+(?:[.][0-9]+)*[.)]?|[가-힣][)])"
TAGS = "<[^>]+>"
#: Reasons under which lines are joined as parts of one line, the others joining wrapped lines.
ONE_LINE = ("same_line_continuation", "inline_emphasis")
_FIELDS = {"id": "fragment_id", "page": "page", "cell": "cell_id", "column": "column_id", "role": "structural_role", "callout": "callout_id", "region": "region_id", "paragraph": "paragraph_id", "parent": "parent_id", "style": "style", "size": "font_size"}


def _barred(pairs: DataFrame, barriers: DataFrame | None) -> DataFrame:
    """``pairs`` with ``barred``: whether a drawn line (page keys and box, wider than 4) lies between the two boxes.

    It does if its middle lies between the lower edge of the one and the upper
    edge of the other, and it covers three tenths of their width or of its own.
    The lines of a page are joined as one array each; they are few.
    """
    if barriers is None:
        return pairs.withColumn("barred", F.lit(False))
    per = barriers.filter("x1 - x0 >= 4").groupBy("manual_id", F.col("page").alias("c_page")).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("lines"))
    between = """exists(coalesce(lines, array()), b -> (b.y0 + b.y1) / 2 BETWEEN least(p_y1, c_y0) - 0.5 AND greatest(p_y1, c_y0) + 0.5
     AND greatest(0.0, least(greatest(p_x1, c_x1), b.x1) - greatest(least(p_x0, c_x0), b.x0)) >= 0.3 * least(greatest(p_x1, c_x1) - least(p_x0, c_x0), b.x1 - b.x0))"""
    return pairs.join(per, ["manual_id", "c_page"], "left").withColumn("barred", F.expr(between)).drop("lines")


def decisions(fragments: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """(manual_id, page, fragment_id, ord, text, decision, unit, box, gap, height, style) in reading order; the window is per page of a manual.

    A page boundary always divides, so windows per page give the same units as
    one per manual and keep a large manual from being one task.
    """
    once = fragments.dropDuplicates(["fragment_id"])
    cur = once.select(
        "manual_id", F.col("reading_order").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(v).alias(f"c_{k}") for k, v in _FIELDS.items()],
        *[F.col(f"bbox.{x}").alias(f"c_{x}") for x in ("x0", "y0", "x1", "y1")],
    )
    bare = F.trim(F.regexp_replace("text", TAGS, ""))
    cur = cur.withColumns({"c_chars": F.length(bare), "c_ends": F.trim("text").rlike(ENDS), "c_starts": F.col("text").rlike(STARTS)})
    order = Window.partitionBy("manual_id", "c_page").orderBy("ord", "c_y0", "c_x0", "c_id")
    names = [*_FIELDS, "x0", "y0", "x1", "y1", "chars", "ends"]
    prev = cur.withColumn("p", F.lag(F.struct(*[F.col(f"c_{n}").alias(n) for n in names])).over(order))
    named = _barred(prev.select("*", *[F.col(f"p.{n}").alias(f"p_{n}") for n in names]), barriers)
    judged = named.withColumn("decision", F.expr(DECISION))
    starts = F.when((F.col("decision") == "first") | F.col("decision").startswith("rejected"), 1).otherwise(0)
    unit = F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0))
    box = F.struct(*[F.col(f"c_{x}").alias(x) for x in ("x0", "y0", "x1", "y1")]).alias("box")
    gap = (F.col("c_x0") - F.col("p_x1") > 0.15 * F.greatest(F.lit(1.0), F.col("p_y1") - F.col("p_y0"))).alias("gap")
    return judged.select("manual_id", F.col("c_page").alias("page"), F.col("c_id").alias("fragment_id"), "ord", "text", "decision", unit.alias("unit"), box, gap, F.col("c_style").alias("style"))


def styled(text: Column, style: Column) -> Column:
    """The text between the tags of its style; style 0 and unknown ones have none."""
    tag = style.cast("string")
    return F.when(style.isin(1, 2, 3), F.concat(F.lit("<s"), tag, F.lit(">"), text, F.lit("</s"), tag, F.lit(">"))).otherwise(text)


def join_lines(parts: Column) -> Column:
    """One text from parts (text, decision, gap) in order.

    Parts of one line keep the space they have, or get one if the gap is wide;
    wrapped lines get one space, or none after a hyphen.
    """
    head = lambda t: F.regexp_replace(t, f"^[{SPACE}]+", "")
    tail = lambda t: F.regexp_replace(t, f"[{SPACE}]+$", "")

    def step(s: Column, x: Column) -> Column:
        t = x["text"]
        spaced = s.rlike(f"[{SPACE}]$") | t.rlike(f"^[{SPACE}]")
        line = F.when(spaced | ~F.coalesce(x["gap"], F.lit(False)), F.concat(s, t)).otherwise(F.concat(s, F.lit(" "), t))
        wrapped = F.when(s.endswith("-"), F.concat(s, head(t))).otherwise(F.concat(tail(s), F.lit(" "), head(t)))
        return F.when(s == "", t).when(t == "", s).when(x["decision"].isin(*ONE_LINE), line).otherwise(wrapped)

    return F.aggregate(parts, F.lit(""), step)


def logical_units(fragments: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """One row per unit: id, page, fragments, merge reasons, text with its style tags, and the box around it.

    The parts of one unit are gathered: a paragraph's lines, which a page bounds.
    """
    part = F.struct("ord", "fragment_id", styled(F.col("text"), F.col("style")).alias("text"), "decision", "gap", "box")
    d = decisions(fragments, barriers).groupBy("manual_id", "page", "unit").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first, last = F.col("parts")[0]["fragment_id"], F.element_at("parts", -1)["fragment_id"]
    reasons = F.filter(F.transform("parts", lambda p: p["decision"]), lambda x: (x != "first") & ~x.startswith("rejected"))
    edge = lambda f, c: f(F.transform("parts", lambda p: p["box"][c])).alias(c)
    return d.select(
        "manual_id", "page", F.concat(F.lit("p"), (F.col("page") + 1).cast("string"), F.lit(":"), first, F.lit(".."), last).alias("unit_id"), F.size("parts").alias("fragments"),
        F.array_join(reasons, ",").alias("reasons"), join_lines(F.col("parts")).alias("text"), edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"),
    )


def reconstruction_metrics(fragments: DataFrame) -> DataFrame:
    """Fragments by decision."""
    return decisions(fragments).groupBy("decision").count().withColumnRenamed("count", "fragments")


def conservation(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """Per manual: candidate fragments, those in a unit, in none, in several, and fragments of units that are no candidates."""
    have = fragments.select("manual_id", "fragment_id").distinct().withColumn("c", F.lit(1))
    used = units.select("manual_id", F.explode("source_fragment_ids").alias("fragment_id")).groupBy("manual_id", "fragment_id").agg(F.count("*").alias("times"))
    both = have.join(used, ["manual_id", "fragment_id"], "full_outer")
    return both.groupBy("manual_id").agg(
        F.count("c").alias("candidates"), F.count("times").alias("assigned"), F.count_if(F.col("times").isNull()).alias("unassigned"),
        F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("c").isNull()).alias("unknown"),
    )
