"""One consistent form for text that looks alike (problem 1).

``canonical`` is the form under which look-alike texts compare as equal:
default-ignorable characters removed, every kind of space mapped to U+0020 and
runs of it collapsed, compatibility composition (NFKC), look-alike letters of
other scripts mapped to Latin, full case folding.

It is deliberately coarser than print: it also unites case variants, raised
and circled figures. ``look`` is the finer form that keeps those apart; equal
looks imply equal canonical forms, so ``canonical`` finds the candidates and
``look`` decides.

Defined results: null stays null; empty text and text of ignorable characters
only become the empty string. Whole texts are processed, of any length.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

# Default-ignorable code points of the Unicode Character Database, as ranges.
IGNORABLE_RANGES = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Letters of other scripts printed like Latin ones, and the Latin letters in the same order.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХԌԚԜ": "ABESIJKMHOPCTYXGQW",
    "авеѕіјкорсухһԁԛԝӏ": "aвesijкopcyxhdqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ": "ABEZHIKMNOPTYXCj",
    "ονϲα": "ovca",
}
# Hyphens printed like U+002D.
HYPHENS = "‐‑﹣－"
#: Kinds of compatibility decomposition that only change width, or nothing in print.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}

# Any character that may not print as itself; those left out here are the same in every form (wide marks are not).
_ODD = re.compile(r"[^ -~가-힣一-鿿ぁ-ゖァ-ヺー、。「」à-öø-ÿÀ-ÖØ-Þ“”„•°²ăđĩũơưạ-ỹĂĐĨŨƠƯ]")


@functools.lru_cache(maxsize=1)
def _maps() -> tuple[dict[int, str | None], dict[int, str | None]]:
    """Translation tables (before composition): for look, and the letters only."""
    letters: dict[int, str | None] = {}
    for odd, plain in LOOK_ALIKES.items():
        letters.update({ord(a): b for a, b in zip(odd, plain, strict=True)})
    look: dict[int, str | None] = {}
    for c in range(0x30000):  # beyond, only ignorable and private characters
        ch = chr(c)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind in SAME_LOOK:
            plain = "".join(chr(int(x, 16)) for x in rest.split())
            # Decompositions such as that of U+00B4 stand for "space plus accent", which print does not show as a space.
            if plain == " " or not plain.startswith(" "):
                look[c] = unicodedata.normalize("NFD", plain) if kind == "<compat>" else plain
        elif unicodedata.category(ch) == "Zs" or ch == "\t":
            look[c] = " "
        elif unicodedata.category(ch) == "Cc" and ch not in "\n\r":
            look[c] = None
    look.update(letters)
    look.update({ord(c): "-" for c in HYPHENS})
    ignorable = {c: None for a, b in IGNORABLE_RANGES for c in range(a, b + 1)}
    letters.update({ord(c): "-" for c in HYPHENS})
    return look | ignorable, letters | ignorable


def look(text: str) -> str:
    """The text as print shows it."""
    if not _ODD.search(text):
        return text.replace("\t", " ")
    table = _maps()[0]
    # Twice: a wide form can turn into a look-alike letter or a no-break space.
    return unicodedata.normalize("NFC", text.translate(table).translate(table))


def canonical(text: str) -> str:
    """The form under which look-alike texts are equal."""
    s = look(text)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).translate(_maps()[1]).casefold()
        s = unicodedata.normalize("NFKC", s)
    else:
        s = s.casefold()
    return " ".join(s.split())


def per_distinct(texts: pd.Series, f: Callable[[str], object]) -> list:
    """Apply ``f`` once per distinct non-null value of a batch."""
    known: dict[str, object] = {}
    out = []
    for x in texts:
        if x is None or x is pd.NA or x != x:
            out.append(None)
            continue
        y = known.get(x)
        if y is None:
            y = known[x] = f(x)
        out.append(y)
    return out


def canonical_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series(per_distinct(texts, canonical), dtype=object)

    return form(text)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).digest()


def print_column(text: Column) -> Column:
    """Digest of canonical form and look of a text column: equal for texts that print alike."""

    @F.pandas_udf("binary")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(per_distinct(texts, lambda x: _digest(canonical(x) + "\x00" + look(x))), dtype=object)

    return prints(text)


def look_alike_pairs(records: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs (first_id, second_id) of records within one ``scope`` that print alike but differ in characters.

    ``records`` has id, text and the scope columns. Rows with a null text or a
    null scope value pair with nothing. Repeated ids add nothing.

    Plan: texts are shuffled once, reduced to the distinct ones of a scope
    (combined before the shuffle, so a hot text is one row); from there on
    digests of 128 bits stand for texts. Spellings are windowed by their print
    (canonical form and look); those of prints with several spellings, a small
    table that is written once, are paired with each other first and then with
    the records, so that copies of one text are never paired among themselves.
    No group is gathered in one value.
    """
    rows = records.select("id", "text", *scope).dropna().withColumn("t", F.unhex(F.md5("text")))
    spelled = rows.groupBy("t", *scope).agg(F.first("text").alias("text")).select("t", *scope, print_column(F.col("text")).alias("look"))
    same = Window.partitionBy(*scope, "look")
    variants = spelled.withColumns({"lo": F.min("t").over(same), "hi": F.max("t").over(same)}).filter("lo <> hi").select("t", *scope, "look")
    variants = cut_lineage(variants)
    spellings = variants.withColumnRenamed("t", "t1").join(variants.withColumnRenamed("t", "t2"), ["look", *scope]).filter("t1 <> t2").select("t1", "t2", *scope)
    ids = rows.select("id", "t", *scope)
    first = ids.withColumnsRenamed({"id": "first_id", "t": "t1"})
    second = ids.withColumnsRenamed({"id": "second_id", "t": "t2"})
    pairs = first.join(spellings, ["t1", *scope]).join(second, ["t2", *scope]).filter("first_id < second_id")
    return pairs.select("first_id", "second_id").distinct()
