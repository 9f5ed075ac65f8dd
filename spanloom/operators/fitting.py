"""Fitting text into boxes: orientation, wrapping, the largest fitting size, leading and ink; column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.tokens import let
from spanloom.operators.geometry import PAGE

TURNS = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]  # baselines of the quarter turns
STEPS, SMALLEST = 12, 0.5  # halvings of the search, least share of the source's size
DESCENT, ASCENT = 0.22, 0.78  # ink below and above the baseline, of the size


def orientation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Quarter turns (0 to 3) of a text matrix by its baseline; null if it lies between them or has no extent."""
    length = F.hypot(a, b)
    off = lambda x, y: F.pow(a / length - x, F.lit(2)) + F.pow(b / length - y, F.lit(2))
    best = F.array_min(F.array(*[F.struct(off(x, y).alias("off"), F.lit(n).alias("turn")) for n, (x, y) in enumerate(TURNS)]))
    return F.when((length > 1e-6) & (F.hypot(c, d) > 1e-6), let(lambda m: F.when(m["off"] <= 0.04, m["turn"]), best))


def upright_matrix(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The matrix without scale, and without the reflection that goes with a negative size."""
    x, y = F.greatest(F.hypot(a, b), F.lit(1e-6)), F.greatest(F.hypot(c, d), F.lit(1e-6))
    return F.when(a * d - b * c < 0, F.array(a / x, b / x, -b / x, a / x)).otherwise(F.array(a / x, b / x, c / y, d / y))


def wrapped_lines(words: Column, width: Column, first: Column, per_char: Column) -> Column:
    """Lines that words take in a width (the first line in its own), breaking at spaces only; null if a word is too long.

    A tenth of a character may hang over.
    """
    slack = 0.1 * per_char
    start = F.struct(F.lit(1).alias("lines"), F.lit(0.0).alias("used"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        own = F.length(w) * per_char
        room = F.when(s["lines"] == 1, first).otherwise(width)
        stays = s["used"] + F.when(s["used"] > 0, per_char).otherwise(0.0) + own <= room + slack
        kept = F.struct(s["lines"].alias("lines"), (s["used"] + F.when(s["used"] > 0, per_char).otherwise(0.0) + own).alias("used"), s["ok"].alias("ok"))
        moved = F.struct((s["lines"] + F.when((s["used"] > 0) | (s["lines"] == 1), 1).otherwise(0)).alias("lines"), own.alias("used"), (s["ok"] & (own <= width + slack)).alias("ok"))
        return F.when(stays, kept).otherwise(moved)

    return let(lambda s: F.when(s["ok"], s["lines"]), F.aggregate(words, start, step))


def largest_size(text: Column, width: Column, height: Column, size: Column, line_height: float = 1.1, char_width: float = 0.5) -> Column:
    """The largest size between half of the source's and all of it at which the wrapped text fits its box, by bisection; null if none does."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n]+"), lambda w: w != "")

    def search(words: Column, width: Column, height: Column, size: Column) -> Column:
        lines = lambda s: wrapped_lines(words, width, width, s * char_width)
        fits = lambda s: F.coalesce(lines(s) * s * line_height <= height + 0.01, F.lit(False))
        start = F.struct((size * SMALLEST).alias("low"), size.alias("high"))

        def halve(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            return F.when(fits(middle), F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["low"]
        return F.when(fits(size), size).when(fits(size * SMALLEST), found)

    return F.when((width > 0) & (height > 0) & (size > 0), let(search, words, width, height, size))


def ink_extent(ink: Column, offsets: Column) -> Column:
    """Height that the ink of all lines spans; ``ink`` is an array of struct(low, high) per line about its baseline."""
    low, high = _edges(ink, offsets)
    return F.coalesce(high - low, F.lit(0.0))


def _edges(ink: Column, offsets: Column) -> tuple[Column, Column]:
    both = F.zip_with(ink, offsets, lambda i, o: F.struct((i["low"] - o).alias("low"), (i["high"] - o).alias("high")))
    return F.array_min(F.transform(both, lambda e: e["low"])), F.array_max(F.transform(both, lambda e: e["high"]))


def shift_into(baseline: Column, ink: Column, offsets: Column, lower: Column, upper: Column) -> Column:
    """How far to move a paragraph so that its ink lies within its cell; 0 if it does, or if it cannot."""
    low, high = _edges(ink, offsets)

    def move(low: Column, high: Column) -> Column:
        return F.when((upper <= lower) | low.isNull() | (high - low > upper - lower + 0.01), 0.0).when(low < lower, lower - low).when(high > upper, upper - high).otherwise(0.0)

    return let(move, baseline + low, baseline + high)


def font_fit(fragments: DataFrame, units: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(occurrence_id, size, fitted): the size at which each translation fits the box of its rebuilt unit."""
    sizes = fragments.dropDuplicates(["fragment_id"]).select("fragment_id", "font_size")
    per = units.select("logical_unit_id", "bbox", F.explode("source_fragment_ids").alias("fragment_id")).join(sizes, "fragment_id").groupBy("logical_unit_id").agg(F.max("font_size").alias("size"), F.first("bbox").alias("b"))
    o = occurrences.filter("target_text IS NOT NULL").select("occurrence_id", "logical_unit_id", "target_text").dropDuplicates(["occurrence_id"])
    fitted = largest_size(F.col("target_text"), F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0"), F.col("size"))
    return o.join(per, "logical_unit_id").select("occurrence_id", "size", F.round(fitted, 4).alias("fitted"))


def free_space(fragments: DataFrame) -> DataFrame:
    """(fragment_id, box): the clear space around each fragment, within the box of its page.

    To the left and right it ends halfway to the nearest fragment of the same
    line, above and below halfway to the nearest one that the widened space
    meets. The fragment's own box is the least.
    """
    b = fragments.dropDuplicates(["fragment_id"]).select("fragment_id", *PAGE, "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    page = Window.partitionBy(*PAGE)
    b = b.withColumns({"px0": F.min("x0").over(page), "py0": F.min("y0").over(page), "px1": F.max("x1").over(page), "py1": F.max("y1").over(page)})
    other = b.select(*PAGE, F.col("fragment_id").alias("o_id"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    near = b.join(other, PAGE).filter("fragment_id <> o_id")
    line = F.least("y1", "oy1") - F.greatest("y0", "oy0") > 0.5
    side = near.filter(line).groupBy("fragment_id").agg(F.max(F.when(F.col("ox1") <= F.col("x0"), (F.col("ox1") + F.col("x0")) / 2)).alias("l"), F.min(F.when(F.col("ox0") >= F.col("x1"), (F.col("x1") + F.col("ox0")) / 2)).alias("r"))
    wide = b.join(side, "fragment_id", "left").withColumns({"l": F.greatest("px0", F.coalesce("l", "px0")), "r": F.least("px1", F.coalesce("r", "px1"))})
    meets = F.least("r", "ox1") - F.greatest("l", "ox0") > 1
    up = wide.join(other, PAGE).filter(F.col("fragment_id") != F.col("o_id")).filter(meets).groupBy("fragment_id").agg(F.max(F.when(F.col("oy1") <= F.col("y0"), (F.col("oy1") + F.col("y0")) / 2)).alias("t"), F.min(F.when(F.col("oy0") >= F.col("y1"), (F.col("y1") + F.col("oy0")) / 2)).alias("d"))
    out = wide.join(up, "fragment_id", "left")
    r = lambda c: F.round(c, 4)
    return out.select("fragment_id", r(F.least("l", "x0")).alias("x0"), r(F.least(F.greatest("py0", F.coalesce("t", "py0")), F.col("y0"))).alias("y0"), r(F.greatest("r", "x1")).alias("x1"), r(F.greatest(F.least("py1", F.coalesce("d", "py1")), F.col("y1"))).alias("y1"))
