"""Text blocks of a page: stacked fractions, runs of one line, paragraphs of one column.

Each step walks a page's blocks with what earlier ones have used up, which no
window can express, so it runs once per page over pandas; a page is small. The
origin is the page's lower left corner: ``y`` grows upwards.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.operators.geometry import PAGE

# Shares of the font or width at which blocks belong together.
LINE, GAP, RAISED_SIZE, RAISED_SHIFT = 0.55, 1.5, 0.8, 0.12
BAR_REACH, BAR_OVERLAP, BAR_WIDTH, BAR_TEXT = 1.8, 0.5, 0.9, 20
SAME_LEFT, SAME_FONT, END_RATIO, FULL_LINES, PROSE_EMS, NEAR, FAR = 12.0, 0.12, 0.75, 0.5, 8.0, 0.6, 2.0
_BAR = re.compile("^[-_–—―─═]+$")
_RAISE, _LOWER = str.maketrans(P.FIGURES, P.RAISED), str.maketrans(P.FIGURES, P.LOWERED)
COLUMNS = ["text", "x", "y", "size", "width", "ascent", "descent", "rotation"]
SCHEMA = "manual_id string, page int, text string, x double, y double, size double, width double, ascent double, descent double, rotation int"


def page_blocks(fragments: DataFrame) -> DataFrame:
    """Fragments as blocks; a null text is left out."""
    f = fragments.dropDuplicates(["fragment_id"]).filter("text IS NOT NULL")
    size = F.coalesce("font_size", F.col("bbox.y1") - F.col("bbox.y0"))
    return f.select(*PAGE, "text", F.col("bbox.x0").alias("x"), (-F.col("bbox.y1")).alias("y"), size.alias("size"), (F.col("bbox.x1") - F.col("bbox.x0")).alias("width"), (size * 0.8).alias("ascent"), (size * 0.2).alias("descent"), F.lit(0).alias("rotation"))


def _ordered(b: pd.DataFrame) -> pd.DataFrame:
    return b.sort_values(["y", "x", "text"], ascending=[False, True, True], kind="stable", ignore_index=True)


def collapse_fractions(blocks: pd.DataFrame) -> pd.DataFrame:
    """Numerator, bar and denominator become one block "a/b"; without a drawn bar nothing is merged."""
    turned, flat = blocks[blocks.rotation != 0], _ordered(blocks[blocks.rotation == 0])
    if flat.empty:
        return blocks
    text = flat.text.str.strip()
    bars = np.array([bool(_BAR.match(t)) for t in text])
    if not bars.any():
        return _ordered(blocks)
    x, y, right, width = flat.x.to_numpy(), flat.y.to_numpy(), (flat.x + flat.width).to_numpy(), flat.width.to_numpy()
    short = (text.str.len() <= BAR_TEXT).to_numpy() & ~bars
    free = np.ones(len(flat), dtype=bool)
    made = []
    for i in np.flatnonzero(bars):
        smaller = np.minimum(width, width[i])
        covered = np.where(smaller > 0, (np.minimum(right, right[i]) - np.maximum(x, x[i])) / np.where(smaller > 0, smaller, 1), 0)
        fits = free & short & (covered > BAR_OVERLAP) & (width[i] >= BAR_WIDTH * width)
        reach = flat["size"][i] * BAR_REACH
        above, below = np.flatnonzero(fits & (y > y[i]) & (y - y[i] <= reach)), np.flatnonzero(fits & (y < y[i]) & (y[i] - y <= reach))
        if not (free[i] and len(above) and len(below)):
            continue
        a, b = above[0], below[0]
        free[[i, a, b]] = False
        wrapped = [f"({t})" if re.search(r"[ +\-]", t) and not t.startswith("(") else t for t in (text[a], text[b])]
        three, middle = [i, a, b], (y[a] + y[b]) / 2
        left = x[three].min()
        made.append(("/".join(wrapped), left, middle, max(flat["size"][a], flat["size"][b]), right[three].max() - left, y[a] + flat.ascent[a] - middle, middle - y[b] + flat.descent[b], 0))
    return _ordered(pd.concat([turned, flat[free], pd.DataFrame(made, columns=COLUMNS)] if made else [turned, flat], ignore_index=True)[COLUMNS])


def _merged(run: list[tuple]) -> tuple:
    """One block of a run, its pieces in order: small pieces off the baseline become raised or lowered figures."""
    _, _, y, size, *_ = max(run, key=lambda p: p[3])
    text = ""
    for n, (piece, _, py, psize, *_) in enumerate(run):
        shift = (py - y) / size if size else 0.0
        off = psize <= size * RAISED_SIZE and abs(shift) > RAISED_SHIFT
        part = piece.strip().translate(_RAISE if shift > 0 else _LOWER) if off else piece
        text += part if n == 0 or off or text.endswith(("sqrt", "√")) else " " + part
    left = min(p[1] for p in run)
    return (" ".join(text.split()), left, y, size, max(p[1] + p[4] for p in run) - left, max(p[5] for p in run), max(p[6] for p in run), 0)


def line_runs(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks in their order joined to lines by their baselines, and cut into runs where the gap is wide; turned blocks stay whole."""
    rows = [tuple(r) for r in blocks[COLUMNS].itertuples(index=False)]
    lines: list[list[tuple]] = []
    tallest: tuple = ()
    for b in (r for r in rows if r[7] == 0):
        if lines and abs(b[2] - tallest[2]) <= LINE * max(b[3], tallest[3]):
            lines[-1].append(b)
            tallest = b if b[3] > tallest[3] else tallest
        else:
            lines.append([b])
            tallest = b
    out = []
    for line in lines:
        run: list[tuple] = []
        for b in sorted(line, key=lambda p: p[1]):
            if run and b[1] - (run[-1][1] + run[-1][4]) > GAP * max(b[3], run[-1][3]):
                out.append(_merged(run))
                run = []
            run.append(b)
        out.append(_merged(run))
    return pd.DataFrame(out + [r for r in rows if r[7] != 0], columns=COLUMNS)


def paragraphs(lines: pd.DataFrame) -> pd.DataFrame:
    """(text, x, y, size, lines, measure, pitch) of the paragraphs: lines of one column, as long as each but the last fills it.

    A column is the lines that begin at nearly the same place in nearly the same
    size; it holds prose if it is wide enough and half of its lines fill three
    quarters of its measure. The pitch is the upper median of the line distances.
    """
    flat = _ordered(lines)
    texts = [t.strip() for t in flat.text]
    x, y, size, width = (flat[c].to_numpy(dtype=float) for c in ("x", "y", "size", "width"))
    n = len(flat)
    taller = np.maximum(size[:, None], size[None, :])
    same = (np.abs(x[:, None] - x[None, :]) <= SAME_LEFT) & (np.abs(size[:, None] - size[None, :]) <= SAME_FONT * taller)
    measure = np.where(same, width[None, :], 0).max(axis=1) if n else np.zeros(0)
    full = (same & (width[None, :] >= END_RATIO * measure[:, None])).sum(axis=1) >= FULL_LINES * same.sum(axis=1) if n else np.zeros(0, dtype=bool)
    reaches = (flat.rotation.to_numpy() == 0) & full & (measure >= PROSE_EMS * size) & (width >= END_RATIO * measure)
    free = np.ones(n, dtype=bool)
    out = []
    for start in range(n):
        if not free[start]:
            continue
        free[start], chain = False, [start]
        while True:
            last = chain[-1]
            below = np.flatnonzero(free & (y < y[last]) & (np.abs(x - x[last]) <= SAME_LEFT))
            if not len(below):
                break
            step = below[y[below].argmax()]
            gap = y[last] - y[step]
            if not (same[last, step] and reaches[last] and NEAR * taller[last, step] < gap <= FAR * taller[last, step]):
                break
            free[step] = False
            chain.append(step)
        text = ""
        for piece in (texts[i] for i in chain):
            text += piece if not text or text.endswith("-") or not piece else " " + piece
        gaps = sorted(g for g in -np.diff(y[chain]) if g > 0)
        out.append((text, x[chain].min(), y[start], size[start], len(chain), measure[start], gaps[len(gaps) // 2] if gaps else size[start] * 1.25))
    return pd.DataFrame(out, columns=["text", "x", "y", "size", "lines", "measure", "pitch"])


def page_paragraphs(fragments: DataFrame) -> DataFrame:
    """Paragraphs of every page: fractions collapsed, runs joined, columns followed downwards."""

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        blocks = _ordered(page[COLUMNS])
        found = paragraphs(line_runs(collapse_fractions(blocks)))
        return found.assign(manual_id=page.manual_id.iloc[0], page=page.page.iloc[0])[["manual_id", "page", *found.columns]]

    return page_blocks(fragments).groupBy(*PAGE).applyInPandas(walk, "manual_id string, page int, text string, x double, y double, size double, lines int, measure double, pitch double")
