"""Spans of a text as arrays of (start, end, literal, kind): where patterns match, selected without overlap, masked and restored.

The JVM's regular-expression functions return matches without their places.
The places follow from the stretches between the matches: a match begins after
all stretches and matches before it. Starts count code points from 0; ends are
exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.patterns import jvm
from spanloom.functions.scripts import has_syllables
from spanloom.functions.tokens import let, matches

SPAN = "array<struct<start:int,end:int,literal:string,kind:string>>"
# Names kept as they are (a caller may pass others), why a span may be kept, and its kind when hidden.
KEPT_NAMES = ("Inovance Technology",)
REASONS = {"name": "reviewed_proper_name", "path": "literal_path", "label": "immutable_metadata", "ui": "explicit_ui_rule", "term": "explicit_technical_term"}
KINDS = {"name": "verified proper name", "path": "Windows path", "label": "document-control label", "ui": "Korean UI label"}
APPROVED = ["technical_invariant", "reviewed_proper_name", "explicit_technical_term", "literal_path", "immutable_metadata", "explicit_ui_rule", "explicit_preserve_list"]


def no_spans() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of a pattern, or of one of its groups without white space at its end, in text order."""
    text = F.coalesce(text, F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        begin = at + (F.instr(x["whole"], x["part"]) - 1 if group else F.lit(0))
        literal = F.regexp_replace(x["part"], f"[{P.SPACE}]+$", "") if group else x["part"]
        span = F.struct(begin.alias("start"), (begin + F.length(literal)).alias("end"), literal.alias("literal"), F.lit(kind).alias("kind"))
        return F.struct((at + F.length(x["whole"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def fold(text: Column, whole: Column) -> Column:
        gaps = F.split(text, jvm(pattern), -1)
        parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), (matches(text, pattern, group) if group else whole).alias("part"))
        return F.when(F.size(whole) > 0, F.aggregate(parts, F.struct(F.lit(0).alias("at"), no_spans().alias("out")), step)["out"]).otherwise(no_spans())

    return let(lambda t: let(lambda w: fold(t, w), matches(t, pattern)), text)


def select(spans: Column) -> Column:
    """Leftmost, then longest, then by kind: spans that do not overlap, by one fold over them in that order."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("c"), s["literal"].alias("d")))
    start = F.struct(F.lit(-1).alias("cursor"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["a"].alias("start"), (-x["b"]).alias("end"), x["d"].alias("literal"), x["c"].alias("kind"))
        taken = F.struct((-x["b"]).alias("cursor"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when((x["a"] < acc["cursor"]) | (x["d"] == ""), acc).otherwise(taken)

    return F.aggregate(F.array_sort(keyed), start, step)["out"]


def names(text: Column, kept: Sequence[str] = KEPT_NAMES, kind: str = "name") -> Column:
    """Spans of kept names that are no parts of longer words."""
    wanted = [n for n in dict.fromkeys(kept) if n]
    each = [find(text, rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])".replace(r"\ ", " "), kind) for n in wanted]
    there = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in wanted], F.lit(False))
    return F.when(there, select(F.concat(*each))).otherwise(no_spans()) if each else no_spans()


def ui_labels(text: Column, kind: str = "ui", terms: Sequence[str] = ()) -> Column:
    """English labels that Korean syntax marks as parts of a user interface; terms of a glossary are none."""
    found = F.concat(*[find(text, p, kind, 1) for p in P.UI_LABELS])
    if terms:
        found = F.filter(found, lambda s: ~s["literal"].isin(list(terms)))
    return F.when(has_syllables(text), select(found)).otherwise(no_spans())


def _kept_spans(text: Column, kept: Sequence[str], glossary: dict[str, str], label: dict[str, str]) -> list[Column]:
    # What every span of a kind holds is looked for first, as most texts have none.
    if_there = lambda mark, found: F.when(F.contains(text, F.lit(mark)), found).otherwise(no_spans())
    paths, labels = if_there("\\", find(text, P.WINDOWS_PATH, label["path"])), if_there("Page", find(text, P.DOCUMENT_LABEL, label["label"]))
    return [names(text, [n for n in kept if n not in glossary], label["name"]), paths, labels, ui_labels(text, label["ui"], list(glossary))]


def approved(text: Column, kept: Sequence[str] = KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Spans of a source that may stay as they are, with the reason as their kind."""
    glossary = glossary or {}
    same = [find(text, re.escape(t).replace(r"\ ", " "), REASONS["term"]) for t, target in glossary.items() if t and t == target]
    return select(F.concat(*_kept_spans(text, kept, glossary, REASONS), *same))


def remove_first(text: Column, spans: Column) -> Column:
    """The text without the first occurrence of each span's literal, one after another."""

    def step(t: Column, s: Column) -> Column:
        at = F.instr(t, s["literal"])
        return F.when((at > 0) & s["kind"].isin(APPROVED), F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(s["literal"]), F.length(t)))).otherwise(t)

    return F.aggregate(spans, text, step)


def _next_id(text: Column) -> Column:
    used = F.array_max(F.transform(matches(text, P.MASK_TAG, 1), lambda i: i.cast("long")))
    return F.coalesce(used + 1, F.lit(0).cast("long"))


def mask_spans(text: Column, spans: Column) -> Column:
    """struct(masked, masks): every span as an empty tag pair with the next free number, and what each number stands for."""
    return let(lambda t, s: let(lambda masks: _masked(t, masks), _numbered(t, s)), text, spans)


def _numbered(text: Column, spans: Column) -> Column:
    first = _next_id(text)
    return F.transform(spans, lambda s, i: F.struct((first + i).alias("id"), s["literal"].alias("literal"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _masked(text: Column, masks: Column) -> Column:
    start = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        tag = F.concat(F.lit("<b"), m["id"].cast("string"), F.lit("></b"), m["id"].cast("string"), F.lit(">"))
        return F.struct(m["end"].alias("cursor"), F.concat(acc["out"], F.substring(text, acc["cursor"] + 1, m["start"] - acc["cursor"]), tag).alias("out"))

    masked = let(lambda done: F.concat(done["out"], F.substring(text, done["cursor"] + 1, F.length(text))), F.aggregate(masks, start, step))
    return F.struct(masked.alias("masked"), F.transform(masks, lambda m: F.struct(m["id"].alias("id"), m["literal"].alias("literal"), m["kind"].alias("kind"))).alias("masks"))


def mask_literals(text: Column, kept: Sequence[str] = KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Names, paths, labels and user-interface labels hidden from a provider."""
    return mask_spans(text, select(F.concat(*_kept_spans(text, kept, glossary or {}, KINDS))))


def mask_names(text: Column, kept: Sequence[str] = KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    return mask_spans(text, names(text, [n for n in kept if n not in (glossary or {})], KINDS["name"]))


def restore(translated: Column, masks: Column) -> Column:
    """struct(text, error): the literals put back, or why not.

    The tags of the masks must all stand in the translation, once each, in
    order and in pairs; the error is the class of a name's or another literal's.
    """
    return let(_restored, translated, masks)


def _restored(translated: Column, masks: Column) -> Column:
    ids = F.transform(masks, lambda m: m["id"].cast("string"))
    tag = lambda i: F.concat(F.lit("<b"), i, F.lit(">"), F.lit("</b"), i, F.lit(">"))
    expected = F.flatten(F.transform(ids, lambda i: F.array(F.concat(F.lit("<b"), i, F.lit(">")), F.concat(F.lit("</b"), i, F.lit(">")))))
    own = F.filter(matches(translated, P.MASK_TAG), lambda t: F.array_contains(ids, F.regexp_extract(t, "[0-9]+", 0)))
    paired = F.forall(ids, lambda i: F.instr(translated, tag(i)) > 0)
    put = F.aggregate(masks, translated, lambda t, m: F.replace(t, tag(m["id"].cast("string")), m["literal"]))
    names_only = F.forall(masks, lambda m: m["kind"] == KINDS["name"])
    error = F.when(names_only, "VerifiedProperNameError").otherwise("FormulaPlaceholderError")
    fine = (F.size(masks) == 0) | ((own == expected) & paired)
    return F.struct(F.when(fine, put).alias("text"), F.when(~fine, error).alias("error"))


def only_names(text: Column, kept: Sequence[str] = KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Whether a text is nothing but kept names, punctuation and space."""
    rest = lambda t, found: F.regexp_replace(F.aggregate(found, t, lambda x, s: F.replace(x, s["literal"], F.lit(""))), jvm(P.STYLE_TAG), "")
    only = let(lambda t, found: F.when(F.size(found) > 0, rest(t, found).rlike(rf"^[{P.SPACE}\p{{P}}]*$")).otherwise(False), text, names(text, [n for n in kept if n not in (glossary or {})]))
    return F.coalesce(only, F.lit(False))
