"""Repetition inside a single text (problem 5).

Line-first cleaning. Every line is judged by rules before the text is:

* punctuation: marks repeated in a row; all but the first are surplus;
* boilerplate: a line, or a sentence of it, that has stood in the text before;
* navigation: a word or phrase repeated in a row within the line.

What fails is taken out of the line. A text is rejected when it loses
``LOST_SHARE`` of its characters or more. White space counts on neither side.

Copies that differ only in case, punctuation, white space, the form of
characters or a running number are copies.

Defined results: null and blank texts have share 0; texts shorter than
``LEAST_CHARS`` have their share but are never rejected. Whole texts are
judged, of any length.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.normal import per_distinct

LEAST_CHARS = 20
LOST_SHARE = 0.4
LEAST_COPY = 4  # characters of letters and digits that make a line or sentence comparable
SHORT_PHRASE = 80  # tokens of a phrase whose period is found by pairs of tokens; longer ones are found by blocks
BLOCK = 40  # tokens; a phrase longer than SHORT_PHRASE holds a whole block, wherever it begins

_END = re.compile(r"[.!?…]+[\"”’'»）)」』“]*(?=\s|$|[^\x00-\x7f])|[。！？]+[”’」』）]*")
_NUMBER = re.compile(r"^\W*(?:\d{1,4}|[a-z])\s*[.)）、:：]\s*|^\W*\(\d{1,4}\)\s*|\s*[(（#]\s*\d{1,4}\s*[)）]\W*$|\s*#\d{1,4}\W*$")
_KEEP = re.compile(r"[^\w]+|_+")
_MARKS = re.compile(r"([^\w\s])(?:\s*\1){3,}")
_TOKEN = re.compile(r"[^\W฀-鿿가-힣_]+|[가-힣]+|[฀-鿿]|[^\w\s]")
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060-\u206f\ufeff]")


def key_of(unit: str) -> str:
    """A line or sentence (already folded) as its copies have it, too."""
    return _KEEP.sub("", _NUMBER.sub("", unit))


def folded(text: str) -> str:
    """Case and character forms evened out; line breaks stay."""
    if not text.isascii() and (not unicodedata.is_normalized("NFKC", text) or _INVISIBLE.search(text)):
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text.casefold()


def _solid(text: str) -> int:
    return sum(map(len, text.split()))


def _in_a_row(text: str) -> int:
    """Characters that belong to the second or a later copy of a word or phrase repeated in a row."""
    words = _TOKEN.findall(text)
    n = len(words)
    last: dict[tuple[str, str], int] = {}
    lags: dict[int, int] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        j = last.get(pair)
        if j is not None and i - j <= SHORT_PHRASE:
            lags[i - j] = lags.get(i - j, 0) + 1
        last[pair] = i
        if pair[0] == pair[1]:
            lags[1] = 2
    # A phrase of p tokens repeats at least about half of its pairs p tokens later (the others may recur sooner).
    periods = [p for p, k in lags.items() if k >= max(1, (p - 1) // 2)]
    if not periods and n < 2 * SHORT_PHRASE + 2:
        return 0
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(t, len(ids)) for t in words], dtype=np.int32)
    copied = np.zeros(n, dtype=bool)
    _mark_copies(words, seq, periods, copied)
    if n >= 2 * SHORT_PHRASE + 2:
        _mark_copies(words, seq, _long_periods(seq, periods), copied)
    return sum(map(len, itertools.compress(words, copied))) if copied.any() else 0


def _long_periods(seq: np.ndarray, short: list[int]) -> set[int]:
    """Every distance above SHORT_PHRASE at which a block of tokens, cut at multiples of its length, stands again.

    A phrase of that length repeated in a row holds such a block, and its copy
    stands one period later, so no period is missed however often parts of the
    phrase recur inside it. Two places of one run of a short period say nothing
    that the run does not.
    """
    n = len(seq)
    raw = seq.tobytes()
    wide = BLOCK * seq.itemsize
    blocks: dict[bytes, list[int]] = {}
    for s in range(0, n - BLOCK + 1, BLOCK):
        blocks.setdefault(raw[s * seq.itemsize : s * seq.itemsize + wide], []).append(s)
    run, runs = np.zeros(n, dtype=np.int32), 0
    for p in short:
        same = seq[p:] == seq[:-p]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= BLOCK:
                runs += 1
                run[a : b + p] = runs
    found: set[int] = set()
    for i in range(SHORT_PHRASE + 1, n - BLOCK + 1):
        for s in blocks.get(raw[i * seq.itemsize : i * seq.itemsize + wide], ()):
            if i - s <= SHORT_PHRASE:
                break
            if i - s <= n // 2 and not (run[s] and run[s] == run[s + BLOCK - 1] == run[i] == run[i + BLOCK - 1]):
                found.add(i - s)
    return found


def _mark_copies(words: list[str], seq: np.ndarray, periods: Iterable[int], copied: np.ndarray) -> None:
    """Mark the tokens that repeat in a row what stands one of the periods before."""
    for p in sorted(periods):
        same = seq[p:] == seq[:-p]
        if np.count_nonzero(same) < p:
            continue
        # Runs of at least p equal tokens: from the run's start + p on, everything repeats what stands p before.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= p:
                copied[a + p : b + p] = True
                # A phrase that also stands earlier in the text is a copy the first time, too.
                phrase = [w for w in words[a : a + p] if w.isalnum()]
                if b - a >= 2 * p and len(phrase) > 1 and "\x00".join(phrase) in "\x00".join(w for w in words[:a] if w.isalnum()):
                    copied[a : a + p] = True


def repeated_chars(raw: str) -> tuple[int, int]:
    """(characters in second or later copies, all characters), without white space."""
    text = folded(raw)
    total = _solid(text)
    lost = 0
    if _MARKS.search(text):  # punctuation rule

        def thin(m: re.Match) -> str:
            nonlocal lost
            lost += _solid(m[0]) - 1
            return m[1]

        text = _MARKS.sub(thin, text)
    seen: set[str] = set()
    kept: list[str] = []
    lines = text.split("\n")
    final = len(lines) - 1
    for at, line in enumerate(lines):
        if not line or line.isspace():
            continue
        whole = key_of(line)
        if len(whole) >= LEAST_COPY:  # boilerplate rule for the line
            if whole in seen:
                lost += _solid(line)
                continue
        ends = [m.end() for m in _END.finditer(line)]
        if not ends or ends[-1] < len(line):
            ends.append(len(line))
        start = 0
        for end in ends:
            unit = line[start:end]
            start = end
            if unit.isspace():
                continue
            key = whole if len(ends) == 1 else key_of(unit)
            if len(key) >= LEAST_COPY:  # boilerplate rule for the sentence; the last one may be cut off
                if key in seen or at == final and end == len(line) and len(key) > 12 and any(k.startswith(key) for k in seen):
                    lost += _solid(unit)
                    continue
                seen.add(key)
            kept.append(unit)
        seen.add(whole)
    if kept:  # navigation rule, also across the lines that are left
        lost += _in_a_row("\n".join(kept))
    return min(lost, total), total


def measure(text: str) -> tuple[float, bool]:
    lost, total = repeated_chars(text)
    share = lost / total if total else 0.0
    return share, len(text) >= LEAST_CHARS and share >= LOST_SHARE


def measure_column(text: Column) -> Column:
    """struct(share, rejected) of a text column."""

    @F.pandas_udf("share double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = per_distinct(texts, measure)
            yield pd.DataFrame([r or (0.0, False) for r in rows], columns=["share", "rejected"])

    return judge(text)


def repetition(records: DataFrame) -> DataFrame:
    """(tbl, record_id, share, rejected), one row per record; ``records`` has tbl, record_id, text.

    Repeated ids are reduced before the Python step, combined map-side.
    """
    rows = records.dropDuplicates(["tbl", "record_id"]).withColumn("m", measure_column(F.col("text")))
    return rows.select("tbl", "record_id", F.col("m.share").alias("share"), F.col("m.rejected").alias("rejected"))
