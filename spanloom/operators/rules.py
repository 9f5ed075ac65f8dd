"""Text classification by ordered rules, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import spans as S
from spanloom.functions.patterns import jvm
from spanloom.functions.scripts import has_syllables
from spanloom.functions.tokens import holds, is_code_line, let, matches, without, without_tags


def _full(text: Column, pattern: str) -> Column:
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return text.rlike(jvm(f"{flags}^(?:{pattern.removeprefix('(?i)')})\\z"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{P.SPACE}]+|[{P.SPACE}]+$", "")


def _plain(text: Column) -> Column:
    return _strip(without(F.coalesce(text, F.lit("")), P.STYLE_TAG))


def needs_translation(text: Column, kept: Sequence[str] = S.KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Whether words are left beside kept names, formula markers, standalone terms, lines of code, and codes; false for null."""
    return let(lambda t, v: _needs_translation(t, v, kept, glossary), text, _strip(without(_plain(text), P.FORMULA_ONLY)))


#: A letter that no code or unit has, or a word in small letters too long for one: text that holds it is not codes alone.
_WORDED = r"[\p{L}&&[^A-Za-zµμΩſK]]|(?<![A-Za-z0-9_])(?!(?i:servo)(?![A-Za-z]))[A-Za-z]*[a-z]{2}[A-Za-z]*(?<=[A-Za-z]{4})(?![A-Za-z0-9_])"


def _needs_translation(text: Column, visible: Column, kept: Sequence[str], glossary: dict[str, str] | None) -> Column:
    lines = F.filter(F.split(visible, P.LINE_END, -1), lambda line: _strip(line) != "")
    code = visible.rlike("MOV|DTO_M|DFROM_M|SET|RST|TON|NWAIT") & (F.size(lines) > 0) & F.forall(lines, is_code_line)
    rest = without(without(visible, P.TECHNICAL_ONLY), P.BETWEEN_CODES)
    no = (visible == "") | _full(visible, P.STANDALONE_TERM) | S.only_names(text, kept, glossary) | code
    return F.when(no, False).when(visible.rlike(_WORDED), True).otherwise(rest.rlike(r"\p{L}"))


def preserve_reason(text: Column, explicit: Column, kept: Sequence[str] = S.KEPT_NAMES, glossary: dict[str, str] | None = None) -> Column:
    """Why a text may stay as it is, or null if it may not."""
    visible = _plain(text)
    same = F.lit(False)
    for term, target in (glossary or {}).items():
        if term and term == target:
            same = same | F.contains(visible, F.lit(term))
    return (
        F.when(explicit, "immutable_metadata").when(S.only_names(text, kept, glossary), "reviewed_proper_name").when(visible == "", F.lit(None).cast("string"))
        .when(_full(visible, P.FORMULA_ONLY), "technical_invariant").when(needs_translation(text, kept, glossary), F.lit(None).cast("string"))
        .when(same, "explicit_technical_term").otherwise("technical_invariant")
    )


def is_metadata(text: Column) -> Column:
    """Whether a text is a metadata value and nothing else."""
    out = F.lit(False)
    for name, p in P.METADATA.items():
        out = out | _full(text, p if name != "confidential" else r"(?i)\bCONFIDENTIAL\b(?:\s+\d{4})?")
    return out


def is_natural_token(token: Column) -> Column:
    """One token of a table cell: Hangul and longer Han are natural, codes and abbreviations are not, words in small letters are."""
    t = F.regexp_replace(token, "^[()\\[\\]{}:;,\"'“”]+|[()\\[\\]{}:;,\"'“”]+$", "")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    coded = t.rlike(r"[\p{Nd}]|[a-z][A-Z]|[%._/·]") | (F.regexp_count(letters, F.lit(r"\p{Lu}")) >= 2)
    return (
        F.when(letters.rlike("[가-힣]") | letters.rlike("[㐀-鿿]{2,}"), True).when(F.lower(t).isin("dry", "wet"), True).when(F.lower(t).isin("max", "min"), False)
        .when(t.rlike("[Ͱ-Ͽ]") | (F.length(letters) <= 2), False).when(letters.rlike(r"\p{Lu}") & ~letters.rlike(r"\p{Ll}"), False).when(coded, False)
        .otherwise(letters.rlike(r"\p{Ll}"))
    )


def translate_cell(text: Column) -> Column:
    """Whether a table cell holds natural language; false for null."""
    value = F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), f"[{P.SPACE}]+", " ")
    return F.when((value == "") | _full(value, P.STANDALONE_TERM) | is_metadata(value), False).otherwise(F.exists(F.split(value, " "), is_natural_token))


def context_sensitive(text: Column) -> Column:
    """Korean whose reading depends on what stands around it: an ambiguous term, or English words beside codes and states."""
    visible = without_tags(F.coalesce(text, F.lit("")))
    rest = without(without(visible, P.IDENTIFIER), P.POLARITY)
    return has_syllables(visible) & (holds(visible, P.AMBIGUOUS_KOREAN) | holds(rest, P.ASCII_WORD))


def safe_to_share(text: Column, tags: str = "segment") -> Column:
    """Texts long or closed enough to share one translation; a cache key also has its placeholders stripped."""
    visible = _strip(without(F.coalesce(text, F.lit("")), P.CACHE_TAG)) if tags == "cache" else _strip(without(_plain(text), P.FORMULA_ONLY))
    words = F.size(matches(visible, P.SHARED_WORD))
    return (F.length(visible) >= 24) | (words >= 4) | ((F.length(visible) >= 12) & holds(visible, P.CLOSED))


def translate_rotated(text: Column) -> Column:
    """Rotated text that is no document-control number."""
    visible = _plain(text)
    return ~(visible.rlike(r"\p{Nd}") & holds(visible, P.ROTATED_LABEL))


def run_is_prose(text: Column) -> Column:
    """A run long enough, and with small letters enough, to be prose though set small."""
    visible = _strip(F.coalesce(text, F.lit("")))
    return (F.length(visible) >= 12) & visible.rlike("[a-z]{3,}")


def is_bullet(text: Column, font: Column) -> Column:
    return text.isin(*P.BULLETS) | (text.isin(*P.PRIVATE_BULLETS) & holds(font, P.SYMBOL_FONT))


def is_formula_font(font: Column) -> Column:
    return holds(font, "^" + P.FORMULA_FONT)


def is_equation(text: Column) -> Column:
    """A block with operators and without prose, functions apart."""
    compact = F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), f"[{P.SPACE}]+", " ")
    words = without(compact, P.MATH_FUNCTION)
    return compact.rlike(jvm(P.MATH_OPERATOR)) & ~holds(words, P.PROSE_WORD) & ~holds(words, P.CJK_PROSE)


def is_math(text: Column) -> Column:
    """Pure formulas: one symbol, symbols and single letters only, or a short expression with an operator and two words at most."""
    t = _strip(F.coalesce(text, F.lit("")))
    symbol = (F.length(t) <= P.SYMBOL_LENGTH) & ~t.rlike(f"[{P.SPACE}]") & holds(t, P.MATH_MARKER)
    words = without(t, P.MATH_WORD, " ")
    long = F.size(F.filter(matches(words, r"\p{L}+"), lambda r: F.length(r) > 2))
    only = (long == 0) & F.regexp_replace(words, r"\p{L}", "").rlike(jvm(P.MATH_ONLY))
    return (t != "") & (symbol | only | (holds(t, P.MATH_SIGN) & (F.length(t) <= P.FORMULA_LENGTH) & (long <= 2)))


def strip_markers(text: Column) -> Column:
    """The text without protective markers, however they are spaced."""
    for p in P.STRAY_TAGS:
        text = without(text, p)
    return text


def option_label(text: Column) -> Column:
    """struct(label, rest): "A." and the like at the start of an option."""
    label = F.regexp_extract(text, jvm(P.OPTION_LABEL), 0)
    return F.struct(F.nullif(label, F.lit("")).alias("label"), F.substring(text, F.length(label) + 1, F.length(text)).alias("rest"))


def raised(text: Column) -> Column:
    return F.translate(_strip(text), P.FIGURES, P.RAISED)


def lowered(text: Column) -> Column:
    return F.translate(_strip(text), P.FIGURES, P.LOWERED)


def preferred_header(text: Column) -> Column:
    """The agreed Vietnamese word of three rotated table headers, with the text's own space and style tags; else null."""
    known = F.create_map(*[F.lit(x) for pair in P.ROTATED_HEADERS.items() for x in pair])
    word = F.try_element_at(known, _plain(text))
    head = F.regexp_extract(text, jvm(r"^(\s*(?:(?i)<s[123]>)?)"), 1)
    tail = F.regexp_extract(text, jvm(r"((?:(?i)</s[123]>)?\s*)\z"), 1)
    return F.when(word.isNotNull(), F.concat(head, word, tail))


def residual_class(text: Column, kept: Sequence[str] = S.KEPT_NAMES, official: Sequence[str] = (), raster: Column | None = None) -> Column:
    """Why East Asian characters may be left in a text: raster image, kept name, official token, path, or none."""
    t = F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), f"[{P.SPACE}]+", " ")
    paths = S.find(t, P.WINDOWS_PATH, "path")
    places = F.transform(S.find(t, P.RESIDUAL_CJK, ""), lambda s: s["start"])
    inside = (F.size(places) > 0) & F.forall(places, lambda c: F.exists(paths, lambda p: (p["start"] <= c) & (c < p["end"])))
    return (
        F.when(F.coalesce(raster, F.lit(False)) if raster is not None else F.lit(False), "RASTER_IMAGE_TEXT_OUT_OF_SCOPE").when(t.isin(list(kept)), "ALLOWED_PROPER_NAME")
        .when(t.isin(list(official) or [None]), "ALLOWED_OFFICIAL_TOKEN").when(inside, "ALLOWED_TECHNICAL_LITERAL").otherwise("UNTRANSLATED_PROSE")
    )


def error_class(text: Column) -> Column:
    """Code of the first rule one of whose markers the lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for code, marks in P.ERRORS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m.lower()))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("E-UNKNOWN")


def digest_class(reason: Column) -> Column:
    """What a reader is told about a failure: too long to fit by its wording, else by the class of the error."""
    out = None
    for name, marks in P.DIGEST:
        hit = reason.isin(marks)
        if name == "fit":
            hit = F.contains(reason, F.lit(marks[0])) | F.contains(reason, F.lit(marks[1]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("engine")


def retry_class(error: Column) -> Column:
    return F.when(error == "SegmentTooLongError", "pre_provider").when(error.isin(P.CONTENT_ERRORS), "content").otherwise("transport")


def version_parts(v: Column) -> Column:
    """Numeric parts of a dotted version; a leading v and a suffix are ignored, and zeros at the end do not count."""
    dotted = F.regexp_replace(F.regexp_extract(v, r"^[vV]?([0-9]+(?:\.[0-9]+)*)", 1), r"(\.0+)+$", "")
    return F.transform(F.split(dotted, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
