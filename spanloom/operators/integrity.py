"""What a translation must keep: tokens, associations, meaning cues, kept spans, and signs of corruption.

Everything is column expressions over (source, target), so a pair is judged
within one task and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import spans as S
from spanloom.functions.patterns import jvm
from spanloom.functions.scripts import HAN, HANGUL, any_of, has_syllables, new_scripts
from spanloom.functions.tokens import EXTRACTORS, _even_units, bag_minus, balanced_tags, holds, korean_ranges, let, matches, tokens, without, without_tags

DIFFERENCE = "array<struct<category:string,missing:array<string>,added:array<string>>>"
#: Category of the extractors as differences name it.
CATEGORIES = {
    "placeholders": "placeholders", "tags": "structural tags", "urls": "URLs", "windows_paths": "Windows paths", "posix_paths": "POSIX paths", "file_names": "file names",
    "document_labels": "document-control labels", "ipv4": "IPv4 addresses", "endpoints": "network endpoints", "identifiers": "technical identifiers", "standards": "standard IDs",
    "versions": "versions", "document_ids": "document IDs", "numbers": "numbers", "ranges": "engineering ranges", "units": "engineering units", "quantities": "engineering quantities",
    "single_letter_quantities": "single-unit quantities", "polarity": "ON/OFF polarity", "opcodes": "executable code tokens", "syntax": "technical syntax",
}


def difference(category: Column | str, missing: Column, added: Column) -> Column:
    name = F.lit(category) if isinstance(category, str) else category
    return F.struct(name.alias("category"), missing.cast("array<string>").alias("missing"), added.cast("array<string>").alias("added"))


def no_strings() -> Column:
    return F.array().cast("array<string>")


# Associations of objects and values ---------------------------------------------------------------------------


def object_values(text: Column) -> Column:
    """array<struct(object, value)>: values set right after or right before an identifier, axis or parameter."""
    return let(_object_values, _even_units(without_tags(text)))


def _object_values(t: Column) -> Column:
    axis = lambda g: F.transform(S.find(t, P.NAMED_OBJECT, "", 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), named(s["literal"]).alias("name")))

    def named(literal: Column) -> Column:
        part = lambda g: F.regexp_extract(literal, jvm(P.NAMED_OBJECT), g)
        which = F.concat(part(1), part(2))
        return F.when(which != "", F.concat(F.lit("axis:"), F.upper(which))).otherwise(F.concat(F.lit("parameter:"), part(3)))

    plain = F.transform(S.find(t, P.IDENTIFIER, ""), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["literal"].alias("name")))

    def valued(o: Column) -> Column:  # the value after it, else the one before it
        after = F.regexp_extract(F.substring(t, o["end"] + 1, F.length(t)), jvm("(?i)^(?:" + P.VALUE_AFTER[4:] + ")"), 1)
        from_ = F.greatest(o["start"] - P.BEFORE_WINDOW, F.lit(0))
        before = F.regexp_extract(F.substring(t, from_ + 1, o["start"] - from_), jvm(P.VALUE_BEFORE), 1)
        return F.struct(o["name"].alias("object"), F.when(after != "", after).otherwise(before).alias("value"))

    return F.filter(F.transform(F.concat(plain, axis(0)), valued), lambda v: v["value"] != "")


def association_differences(source: Column, target: Column) -> Column:
    """Differences of the objects that have values on both sides, in the order of their names."""
    return let(_association_differences, object_values(source), object_values(target))


def _association_differences(s: Column, t: Column) -> Column:
    name = lambda values: F.transform(values, lambda v: v["object"])
    of = lambda values, o: F.transform(F.filter(values, lambda v: v["object"] == o), lambda v: v["value"])
    both = F.array_sort(F.array_intersect(name(s), name(t)))
    each = F.transform(both, lambda o: difference(F.concat(F.lit("value association "), o), F.array_sort(of(s, o)), F.array_sort(of(t, o))))
    return F.filter(each, lambda d: d["missing"] != d["added"])


# Tokens -------------------------------------------------------------------------------------------------------


def token_differences(source: Column, target: Column) -> Column:
    """Differences of the bags of tokens, by category in fixed order."""
    parts = []
    for name in EXTRACTORS:
        s, t = tokens(name, source), tokens(name, target)
        if name == "ranges":
            korean = has_syllables(source)
            s, t = F.when(korean, korean_ranges(source)).otherwise(s), F.when(korean, korean_ranges(target)).otherwise(t)
        d = lambda s, t, name=name: F.when(F.array_sort(s) != F.array_sort(t), difference(CATEGORIES[name], bag_minus(s, t), bag_minus(t, s)))
        parts.append(let(d, s, t))
    return F.array_compact(F.array(*parts))


def tag_differences(source: Column, target: Column) -> Column:
    side = lambda label, text: F.when(~balanced_tags(text), difference(f"{label} tag structure", F.array(F.lit("unbalanced")), no_strings()))
    return F.array_compact(F.array(side("source", source), side("translation", target)))


def invariant_differences(source: Column, target: Column) -> Column:
    """All differences of deterministic content: associations, then tokens, then the structure of tags."""
    both = lambda s, t: F.concat(association_differences(s, t), token_differences(s, t), tag_differences(s, t))
    return let(both, F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")))


# Cues of meaning ----------------------------------------------------------------------------------------------


def _korean_answered(name: str, pattern: str, target: Column) -> Column:
    """Whether a cue stands in the target; an affirmative one does not count right after a negation."""
    if name not in P.AFFIRMATIVE_CUES:
        return holds(target, pattern)

    def positive(s: Column) -> Column:
        from_ = F.greatest(s["start"] - P.NEGATED_WINDOW, F.lit(0))
        return ~F.substring(target, from_ + 1, s["start"] - from_).rlike(jvm(P.NEGATED_BEFORE))

    return F.exists(S.find(target, pattern, ""), positive)


def _sides(text: Column, pattern: str) -> Column:
    """struct(n, left, right) around the only match of a pattern; n is the number of matches."""
    parts = F.split(text, jvm(pattern), -1)
    return F.struct((F.size(parts) - 1).alias("n"), parts[0].alias("left"), F.try_element_at(parts, F.lit(2)).alias("right"))


def korean_order(text: Column) -> Column:
    """'before' or 'after' if the text has one such word, between two actions; else null."""
    return let(lambda t: let(lambda s: _korean_order(t, s), _sides(t, P.KOREAN_ORDER_WORD)), without_tags(text))


def _korean_order(t: Column, s: Column) -> Column:
    anchored = lambda x: holds(x, P.KOREAN_ACTION) | holds(x, P.IDENTIFIER) | holds(x, P.POLARITY)
    word = F.get(matches(t, P.KOREAN_ORDER_WORD), F.lit(0))
    return F.when((s["n"] == 1) & anchored(s["left"]) & anchored(s["right"]), F.when(word.isin("전", "이전"), "before").otherwise("after"))


def vietnamese_order(text: Column) -> Column:
    found = F.transform(matches(text, P.ORDER_WORD), F.lower)
    return F.when(F.size(found) == 1, F.when(F.get(found, F.lit(0)).startswith("trước"), "before").otherwise("after"))


def anchored_order(text: Column) -> Column:
    """[first, second]: the one anchor on either side of the only order word, in the order of time; else null."""
    return let(lambda t: let(lambda s: _anchored_order(t, s), _sides(t, P.ORDER_WORD)), without_tags(text))


def _anchored_order(t: Column, s: Column) -> Column:
    word = F.lower(F.get(matches(t, P.ORDER_WORD), F.lit(0)))
    leading = s["left"].rlike(f"^[{P.SPACE}]*$")
    comma = F.instr(s["right"], ",")
    left = F.when(leading, F.when(comma > 0, F.substring(s["right"], comma + 1, F.length(s["right"])))).otherwise(s["left"])
    right = F.when(leading, F.substring(s["right"], F.lit(1), comma - 1)).otherwise(s["right"])
    anchors = lambda x: F.array_distinct(F.concat(matches(x, P.IDENTIFIER), matches(x, P.POLARITY)))
    before = word.startswith("before") | word.startswith("trước")
    ordered = lambda a, b: F.when((F.size(a) == 1) & (F.size(b) == 1) & (a != b), F.when(before, F.concat(a, b)).otherwise(F.concat(b, a)))
    return F.when((s["n"] == 1) & left.isNotNull(), let(ordered, anchors(left), anchors(right)))


def meaning_differences(source: Column, target: Column, language: Column) -> Column:
    """Cues of prohibition, duty, advice, permission and order that a Vietnamese target lost or turned round."""
    found = let(_meaning_differences, without_tags(F.coalesce(source, F.lit(""))), without_tags(F.coalesce(target, F.lit(""))))
    return F.when(language == "vi", found).otherwise(F.array().cast(DIFFERENCE))


def _meaning_differences(s: Column, t: Column) -> Column:
    korean = has_syllables(s)
    parts = []
    for name, asked, answer in P.CUES:
        parts.append(F.when(~korean & holds(s, asked) & ~holds(t, answer), difference(f"semantic {name}", F.array(F.lit(name)), no_strings())))
    for name, asked, answer in P.KOREAN_CUES:
        parts.append(F.when(korean & holds(s, asked) & ~_korean_answered(name, answer, t), difference(f"semantic Korean {name}", F.array(F.lit(name)), no_strings())))
    turned = lambda order: F.when(order.isNotNull() & ~vietnamese_order(t).eqNullSafe(order), difference("semantic Korean order", F.array(order), no_strings()))
    parts.append(F.when(korean, let(turned, korean_order(s))))
    blamed = korean & holds(s, P.RESPONSE_NEEDED) & ~holds(s, P.RESPONSIBLE_SOURCE) & holds(t, P.RESPONSIBLE_TARGET)
    parts.append(F.when(blamed, difference("semantic Korean unsupported responsibility", no_strings(), F.array(F.lit("responsibility")))))
    parts.append(let(lambda a, b: F.when(a.isNotNull() & b.isNotNull() & (a != b), difference("semantic order", a, b)), anchored_order(s), anchored_order(t)))
    return F.array_compact(F.array(*parts))


def _literally(term: str) -> str:
    return rf"(?<!\w){term}(?!\w)"


def _literal_count(text: Column, term: Column) -> Column:
    """How often a term stands in a text as a word; the term is data, so it is quoted."""
    quoted = F.concat(F.lit(rf"(?<![{P.WORD}])\Q"), term, F.lit(rf"\E(?![{P.WORD}])"))
    return F.regexp_count(text, quoted)


def english_missing(source: Column, target: Column, glossary: Sequence[str] = ()) -> Column:
    """English terms, labels and acronyms of Korean text that the target lacks, with multiplicity."""
    kept = [matches(source, _literally(t)) for t in P.KEPT_TERMS if t not in glossary]
    kept += [F.when(holds(source, context), matches(source, _literally(t))).otherwise(no_strings()) for t, context in P.KEPT_IN_CONTEXT if t not in glossary]
    labels = F.transform(S.ui_labels(source, terms=glossary), lambda s: s["literal"])
    required = F.concat(*kept, labels, matches(source, P.ACRONYM))
    lacking = lambda all_, t: F.greatest(F.lit(0), F.size(F.filter(all_, lambda x: x == t)) - _literal_count(target, t))
    missing = lambda all_: F.flatten(F.transform(F.array_distinct(all_), lambda t: F.array_repeat(t, lacking(all_, t))))
    return F.when(has_syllables(source), let(missing, required)).otherwise(no_strings())


def name_counts_differ(source: Column, target: Column, kept: Sequence[str] = S.KEPT_NAMES) -> Column:
    """Whether a kept name stands in the target more or less often than in the source."""
    names = lambda x: F.array_sort(F.transform(S.names(x, kept), lambda s: s["literal"]))
    return names(source) != names(target)


# Corruption ---------------------------------------------------------------------------------------------------


def visible(text: Column) -> Column:
    return without(without(text, P.STYLE_TAG), P.FORMULA_TAG)


def evened(text: Column) -> Column:
    """Compatibility form, full case folding, single spaces: what the JVM has no function for."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC").str.casefold().str.split().str.join(" ")

    return folded(visible(text))


def is_prose(text: Column) -> Column:
    v = visible(text)
    return (F.regexp_count(v, F.lit("[A-Za-zÀ-ỹ]{2,}")) >= 2) | (F.regexp_count(v, F.lit(r"\p{L}")) >= 4)


def token_runs(text: Column) -> Column:
    """array<struct(token, n)>: runs of one short token four times or more."""
    run = lambda m: F.struct(F.lower(F.regexp_extract(m, jvm(r"^(\w+)"), 1)).alias("token"), F.size(F.split(m, "[ \t]+", -1)).alias("n"))
    return F.transform(matches(text, P.SHORT_TOKEN_RUN), run)


def char_runs(text: Column) -> Column:
    return F.transform(matches(text, P.REPEATED_CHAR_RUN), lambda m: F.struct(F.substring(m, 1, 1).alias("token"), F.length(m).alias("n")))


def longer_runs(source: Column, target: Column) -> Column:
    """Whether a run of the target is longer than each of the same token in the source."""
    most = lambda own, token: F.coalesce(F.array_max(F.transform(F.filter(own, lambda r: r["token"] == token), lambda r: r["n"])), F.lit(0))
    return let(lambda own, got: F.exists(got, lambda r: r["n"] > most(own, r["token"])), source, target)


def source_kind(source: Column, language: Column) -> Column:
    """'ko' or 'zh' by the named language, or by the script if none is named."""
    lang = F.lower(F.coalesce(language, F.lit("")))
    guess = F.when(any_of(source, HANGUL), "ko").when(any_of(source, HAN), "zh")
    return F.when(lang.startswith("ko"), "ko").when(lang.startswith("zh"), "zh").when(lang.isin("", "auto"), guess)


def integrity_codes(source: Column, target: Column, source_language: Column, target_language: Column, required: Column, kept: Sequence[str] = S.KEPT_NAMES, glossary: dict[str, str] | None = None, unchanged: bool = True) -> Column:
    """Failure codes of a translation in fixed order; only Vietnamese targets are judged.

    Kept spans of the source are taken out of both sides first, each once.
    ``required`` says whether an unchanged text is a failure; without
    ``unchanged`` that is not looked at.
    """
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    # Evened forms come from a Python step, which cannot stand inside a lambda; a constant False spares it.
    same = evened(s) == evened(t) if unchanged else F.lit(False)
    bound = lambda s, t, spans, kind, same: let(lambda own, got: _codes(s, t, own, got, kind, required & same), S.remove_first(s, spans), S.remove_first(t, spans))
    found = let(bound, s, t, S.approved(s, kept, glossary), source_kind(s, source_language), same)
    return F.when(F.lower(F.coalesce(target_language, F.lit(""))) == "vi", found).otherwise(no_strings())


def _codes(s: Column, t: Column, own: Column, got: Column, kind: Column, same: Column) -> Column:
    codes = [
        ("hangul_leak", (kind == "ko") & any_of(got, HANGUL)),
        ("han_leak", (kind == "zh") & any_of(got, HAN)),
        ("unchanged_prose", same & is_prose(own)),
        ("repeated_token_corruption", longer_runs(token_runs(own), token_runs(got))),
        ("repeated_char_corruption", longer_runs(char_runs(own), char_runs(got))),
        ("length_explosion", (F.length(visible(s)) > 20) & (F.length(visible(t)) > 3 * F.length(visible(s)))),
        ("unexpected_script", F.size(new_scripts(own, got)) > 0),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes]))


# Validation in order ------------------------------------------------------------------------------------------


def formula_tags(text: Column) -> Column:
    return matches(text, r"</?b\d+>")


def style_pairs(text: Column) -> Column:
    """Sorted identifiers of the closed style pairs, or null if the tags are crossed or left open."""
    parts = F.arrays_zip(matches(text, r"(?i)<(/?)s([123])>", 1).alias("close"), matches(text, r"(?i)<(/?)s([123])>", 2).alias("id"))
    start = F.struct(no_strings().alias("stack"), no_strings().alias("done"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        fits = F.element_at(F.concat(F.array(F.lit("")), a["stack"]), -1) == x["id"]
        opened = F.struct(F.concat(a["stack"], F.array(x["id"])).alias("stack"), a["done"].alias("done"), a["ok"].alias("ok"))
        closed = F.struct(F.slice(a["stack"], F.lit(1), F.greatest(F.size(a["stack"]) - 1, F.lit(0))).alias("stack"), F.concat(a["done"], F.array(x["id"])).alias("done"), (a["ok"] & fits).alias("ok"))
        return F.when(x["close"] == "", opened).otherwise(closed)

    return let(lambda end: F.when(end["ok"] & (F.size(end["stack"]) == 0), F.array_sort(end["done"])), F.aggregate(parts, start, step))


def sentence_tokens(text: Column) -> Column:
    """array<array<string>>: lower-case words of each sentence; a sentence ends after a full stop, question or exclamation mark."""
    plain = without(F.coalesce(text, F.lit("")), r"(?i)</?[bs]\d+>")
    sentences = F.filter(F.split(plain, jvm(r"(?<=[.!?])\s*")), lambda s: ~s.rlike(f"^[{P.SPACE}]*$"))
    return F.transform(sentences, lambda s: F.transform(matches(s, P.SENTENCE_TOKEN), F.lower))


def sentence_runs(sentences: Column) -> Column:
    """array<struct(first, n)>: sentences of four words or more that stand several times in a row."""
    return let(_sentence_runs, sentences)


def _sentence_runs(sentences: Column) -> Column:
    n = F.size(sentences)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | ~F.try_element_at(sentences, i).eqNullSafe(F.try_element_at(sentences, F.greatest(i - 1, F.lit(1))))))
    end = lambda of, i: F.coalesce(F.array_min(F.filter(of, lambda j: j > i)), n + 1)
    run = lambda of, i: F.struct((i - 1).alias("first"), (end(of, i) - i).alias("n"), F.size(F.try_element_at(sentences, i)).alias("words"))
    runs = let(lambda of: F.transform(of, lambda i: run(of, i)), starts)
    long = F.filter(runs, lambda r: (r["n"] > 1) & (r["words"] >= 4))
    return F.transform(long, lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n")))


def trailing_child(sentences: Column) -> Column:
    """Whether the last sentence (4 to 12 words) stands within the one before it, which is at least two words longer."""
    child, parent = F.try_element_at(sentences, F.lit(-1)), F.try_element_at(sentences, F.lit(-2))
    mark = lambda s: F.concat(F.lit("\x1f"), F.array_join(s, "\x1f"), F.lit("\x1f"))
    within = F.contains(mark(parent), mark(child))
    return F.coalesce((F.size(sentences) >= 2) & F.size(child).between(4, 12) & (F.size(parent) >= F.size(child) + 2) & within, F.lit(False))


def repeats_fragment(source: Column, target: Column) -> Column:
    """Whether a target repeats a sentence, or ends in a part of the one before, where its source does not."""
    extra = lambda s, t: F.size(F.array_except(sentence_runs(t), sentence_runs(s))) > 0
    return let(lambda s, t: extra(s, t) | (trailing_child(t) & ~trailing_child(s)), sentence_tokens(source), sentence_tokens(target))


def contains_term(text: Column, term: str) -> Column:
    """Whether a term stands in a text whatever its case: as a word if it is ASCII letters and figures, else anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if term.isascii() and term.replace("_", "a").isalnum():
        return low.rlike(jvm(rf"(?<!\w){term.lower()}(?!\w)"))
    return F.contains(low, F.lit(term.lower()))


def terms_missing(source: Column, target: Column, glossary: dict[str, str]) -> Column:
    """Agreed targets, sorted, whose terms stand in the source but which the target lacks."""
    each = [F.when(contains_term(source, a) & ~contains_term(target, b), F.lit(b)) for a, b in glossary.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*each)))) if each else no_strings()


def first_failure(source: Column, target: Column, language: Column, kept: Sequence[str] = S.KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Class of the first check that a supplied translation fails, in the fixed order; null if it passes."""
    glossary = glossary or {}
    return let(lambda s, t, lang: _first_failure(s, t, lang, kept, glossary), F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")), language)


def _first_failure(s: Column, t: Column, language: Column, kept: Sequence[str], glossary: dict[str, str]) -> Column:
    styles = let(lambda a, b: a.isNull() | b.isNull() | (a != b), style_pairs(s), style_pairs(t))
    formula = (formula_tags(s) != formula_tags(t)) | styles
    codes = integrity_codes(s, t, F.lit(None).cast("string"), language, F.lit(False), kept, glossary, unchanged=False)
    technical = lambda d: F.size(d) > 0
    return (
        F.when(repeats_fragment(s, t), "DuplicateTargetFragmentError")
        .when(formula, "FormulaPlaceholderError")
        .when(name_counts_differ(s, t, [n for n in kept if n not in glossary]), "VerifiedProperNameError")
        .when(technical(invariant_differences(s, t)), "TechnicalInvariantError")
        .when(F.size(codes) > 0, "TranslationIntegrityError")
        .when(technical(meaning_differences(s, t, language)) | (F.size(english_missing(s, t, list(glossary))) > 0), "TechnicalInvariantError")
        .when(F.size(terms_missing(s, t, glossary)) > 0, "TerminologyConsistencyError")
    )
