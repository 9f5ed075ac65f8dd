"""Which way a text is translated: fourteen features and nine ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import spans as S
from spanloom.functions.patterns import jvm
from spanloom.functions.scripts import SYLLABLES
from spanloom.functions.tokens import holds, let, matches, without

#: Merge reasons that only undo wrapping. Fixed values.
TRIVIAL = ["wrapped_line", "same_line_continuation", "inline_emphasis", "same_cell_continuation", "same_paragraph"]
DENSE = 120  # characters of a table text that counts as dense
LONG = 600
FEATURES = [
    "contains_mixed_script", "contains_protected_technical_spans", "protected_span_count", "was_fragment_reconstructed", "reconstruction_complexity", "is_callout", "is_dense_table_text",
    "contains_ui_literal", "has_negation", "has_modality", "has_condition", "has_order_marker", "object_value_pair_count", "source_length",
]


def complexity(reasons: Column) -> Column:
    """'trivial_wrap' if all merge reasons only undo wrapping, 'structural_merge' if there are others, 'unavailable' without any."""
    known = F.coalesce(F.size(reasons), F.lit(0)) > 0
    return F.when(known, F.when(F.forall(reasons, lambda r: r.isin(TRIVIAL)), "trivial_wrap").otherwise("structural_merge")).otherwise("unavailable")


def pair_count(text: Column) -> Column:
    """Objects (registers, axes, ports) that have a value before the next object: the stretches after each object are searched."""
    stretches = let(lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), F.split(text, jvm(P.ROUTING_OBJECT), -1))
    ends = F.transform(matches(text, P.ROUTING_OBJECT), lambda o: F.substring(o, -1, 1))
    # A value must not begin right after a letter, so each stretch is searched with the last character of its object before it.
    beside = F.zip_with(ends, stretches, lambda e, s: F.concat(F.when(e.rlike("[A-Za-z]"), e).otherwise(F.lit(" ")), s))
    return F.size(F.filter(beside, lambda s: holds(s, P.ROUTING_VALUE)))


def features(text: Column, reconstructed: Column, complexity_: Column, callout: Column, dense: Column, kept: Sequence[str] = S.KEPT_NAMES, glossary: dict[str, str] | None = None) -> dict[str, Column]:
    visible = F.trim(F.regexp_replace(without(F.coalesce(text, F.lit("")), P.STYLE_TAG), f"[{P.SPACE}]+", " "))
    spans = F.size(S.approved(F.coalesce(text, F.lit("")), kept, glossary))
    cjk = visible.rlike(SYLLABLES) | holds(visible, P.ROUTING_HAN)
    values = [
        cjk & holds(visible, P.LATIN_WORD), spans > 0, spans, reconstructed, complexity_, callout, dense, holds(visible, P.UI_WORD), holds(visible, P.NEGATION), holds(visible, P.MODALITY),
        holds(visible, P.CONDITION), holds(visible, P.ORDER), pair_count(visible), F.length(visible),
    ]
    return dict(zip(FEATURES, values, strict=True))


def reason(preserve: Column) -> Column:
    """The first rule that holds, over the columns of ``features``."""
    c = F.col
    mixed, spans, pairs = c("contains_mixed_script"), c("protected_span_count"), c("object_value_pair_count")
    meaning = c("has_negation") | c("has_modality") | c("has_condition") | c("has_order_marker")
    structural = c("reconstruction_complexity") == "structural_merge"
    return (
        F.when(preserve, "fully_preserve_eligible")
        .when(mixed & ((spans > 0) | c("contains_ui_literal") | structural), "mixed_language_context")
        .when(structural, "structural_merge")
        .when(pairs >= 2, "dense_object_value_associations")
        .when(c("is_callout") & (mixed | (spans >= 2) | meaning | (pairs >= 2)), "context_sensitive_callout")
        .when(meaning & (mixed | c("was_fragment_reconstructed") | (spans >= 2) | (pairs >= 2)), "semantic_dependency_plus_complexity")
        .when((c("source_length") >= LONG) & (mixed | (spans >= 2)), "long_mixed_technical_unit")
        .otherwise("simple_low_risk")
    )


def engine(reason_: Column) -> Column:
    return F.when(reason_ == "fully_preserve_eligible", "preserve").when(reason_ == "simple_low_risk", "google").otherwise("handoff")
