"""Typed token extraction as column expressions.

Twenty-one categories, each a function from text to ``array<string>`` in text
order. The patterns use look-around, which the JVM has; nothing leaves it. Tokens
stay strings: "0.5" and "0.50" differ. A null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.patterns import jvm


def let(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of the values, each evaluated once: as arguments of a lambda they are no longer expressions to repeat."""
    bound = F.array(F.named_struct(*[x for i, v in enumerate(values) for x in (F.lit(f"v{i}"), v)]))
    return F.get(F.transform(bound, lambda x: f(*[x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern (or of one of its groups), in text order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(jvm(pattern)), F.lit(group))


def holds(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere; false for null."""
    return F.coalesce(text.rlike(jvm(pattern)), F.lit(False))


def without(text: Column, pattern: str, instead: str = "") -> Column:
    return F.regexp_replace(text, jvm(pattern), instead)


def _trimmed(found: Column, marks: str) -> Column:
    """Tokens without the given marks at their end."""
    return F.transform(found, lambda t: F.regexp_replace(t, f"[{marks}]+$", ""))


def _even_units(text: Column) -> Column:
    """Quantities as "value unit", with one spelling of micro and of newton metres."""
    folded = F.coalesce(text, F.lit(""))
    for odd, plain in ((r"N\.m", "N·m"), ("μs", "µs")):
        folded = F.regexp_replace(folded, jvm(P.QUANTITY.replace(P.UNITS, odd)), f"$1 {plain}")
    return F.regexp_replace(folded, jvm(P.QUANTITY), "$1 $2")


def is_code_line(line: Column) -> Column:
    """Whether a line is a statement of code, perhaps numbered or conditional, and nothing else."""
    bare = F.regexp_replace(F.regexp_replace(line, jvm(r"^\s*\d+\s*[:)]\s*"), ""), jvm(r"^\s+|\s+$"), "")
    return bare.rlike(jvm(rf"^(?:{P.STATEMENT})\z")) | bare.rlike(jvm(rf"^{P.CONDITIONAL}(?:{P.STATEMENT})\z"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), P.LINE_END, -1)


def _opcodes(text: Column) -> Column:
    inside = lambda line: F.flatten(F.transform(matches(line, P.STATEMENT), lambda m: matches(m, P.OPCODE)))
    return F.flatten(F.transform(_lines(text), lambda line: F.when(is_code_line(line), matches(line, P.OPCODE)).otherwise(inside(line))))


def _syntax(text: Column) -> Column:
    quoted = F.flatten(F.transform(matches(text, P.INLINE_CODE, 1), lambda m: matches(m, P.SYNTAX)))
    return F.concat(quoted, F.flatten(F.transform(F.filter(_lines(text), is_code_line), lambda line: matches(line, P.SYNTAX))))


def _plain(pattern: str) -> Callable[[Column], Column]:
    return lambda text: matches(text, pattern)


#: Category -> extractor, in the order in which differences are reported.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "placeholders": _plain(P.PLACEHOLDER),
    "tags": _plain(P.TAG),
    "urls": lambda text: _trimmed(matches(text, P.URL), ".,;:!?)"),
    "windows_paths": lambda text: _trimmed(matches(text, P.WINDOWS_PATH), ".,!?)”’"),
    "posix_paths": _plain(P.POSIX_PATH),
    # A full stop at the end of a sentence is not part of a file name.
    "file_names": lambda text: matches(without(F.coalesce(text, F.lit("")), r"(?<=[A-Za-z0-9])([.!?])(?=\s|$)"), P.FILE_NAME),
    "document_labels": _plain(P.DOCUMENT_LABEL),
    "ipv4": _plain(P.IPV4),
    "endpoints": _plain(P.ENDPOINT),
    "identifiers": _plain(P.IDENTIFIER),
    "standards": _plain(P.STANDARD),
    "versions": _plain(P.VERSION),
    "document_ids": _plain(P.DOCUMENT_ID),
    "numbers": lambda text: matches(_even_units(text), P.NUMBER),
    "ranges": _plain(P.RANGE),
    "units": lambda text: matches(_even_units(text), P.UNIT),
    "quantities": lambda text: matches(_even_units(text), P.QUANTITY),
    "single_letter_quantities": _plain(P.SINGLE_LETTER_QUANTITY),
    "polarity": _plain(P.POLARITY),
    "opcodes": _opcodes,
    "syntax": _syntax,
}


def tokens(name: str, text: Column) -> Column:
    """Tokens of one category, in text order; an empty array for null."""
    return EXTRACTORS[name](text)


def korean_ranges(text: Column) -> Column:
    """Ranges as Korean text writes them, with one kind of dash."""
    return F.transform(matches(text, P.KOREAN_RANGE), lambda t: F.regexp_replace(t, jvm(r"\s*(?:–|-|~|～)\s*"), "–"))


def count_of(bag: Column, token: Column) -> Column:
    return F.size(F.filter(bag, lambda x: x == token))


def bag_minus(a: Column, b: Column) -> Column:
    """Multiset difference, sorted, with multiplicity; array_except would drop it."""
    surplus = lambda a, b: F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count_of(a, x) - count_of(b, x))))
    return let(lambda a, b: F.array_sort(F.flatten(surplus(a, b))), a, b)


def without_tags(text: Column) -> Column:
    return without(text, P.TAG)


def balanced_tags(text: Column) -> Column:
    """Whether the tags of a text nest: a stack folded over them; self-closing ones are skipped; null text is balanced."""
    parts = F.arrays_zip(matches(text, P.TAG, 1).alias("close"), F.transform(matches(text, P.TAG, 2), F.lower).alias("name"), matches(text, P.TAG, 3).alias("alone"))
    empty = F.array().cast("array<string>")

    def step(stack: Column, tag: Column) -> Column:
        fits = (F.size(stack) > 0) & (F.element_at(F.concat(F.array(F.lit("")), stack), -1) == tag["name"])
        closed = F.when(fits, F.slice(stack, 1, F.size(stack) - 1)).otherwise(F.concat(stack, F.array(F.lit("!"))))
        return F.when(tag["alone"] == "/", stack).when(tag["close"] == "/", closed).otherwise(F.concat(stack, F.array(tag["name"])))

    return F.size(F.aggregate(parts, empty, step)) == 0
