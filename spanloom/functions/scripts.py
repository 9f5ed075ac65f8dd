"""Writing systems of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.tokens import without_tags

#: Script -> character class, the same text for Java and RE2.
SCRIPTS: dict[str, str] = {
    "hangul": "[ᄀ-ᇿ가-힣]",
    "han": "[㐀-䶿一-鿿]",
    "kana": "[ぁ-ヿ]",
    "thai": "[ก-๛]",
    "latin": "[A-Za-zÀ-ɏḀ-ỿ]",
    "cyrillic": "[Ѐ-ӿ]",
    "greek": "[Α-ω]",
}
# Blocks of Hangul and of Han ideographs, and of scripts unrelated to either or to Latin.
HANGUL = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}]"
SYLLABLES = r"[\x{AC00}-\x{D7A3}]"
UNRELATED: dict[str, str] = {
    "Cyrillic": r"[\x{0400}-\x{052F}]",
    "Arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]",
    "Devanagari": r"[\x{0900}-\x{097F}]",
    "Greek": r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]",
    "Hebrew": r"[\x{0590}-\x{05FF}]",
    "Bengali": r"[\x{0980}-\x{09FF}]",
    "Tamil": r"[\x{0B80}-\x{0BFF}]",
    "Telugu": r"[\x{0C00}-\x{0C7F}]",
    "Kannada": r"[\x{0C80}-\x{0CFF}]",
    "Malayalam": r"[\x{0D00}-\x{0D7F}]",
    "Thai": r"[\x{0E00}-\x{0E7F}]",
    "Armenian": r"[\x{0530}-\x{058F}]",
    "Georgian": r"[\x{10A0}-\x{10FF}]",
}


def has(script: str, text: Column) -> Column:
    return F.coalesce(text.rlike(SCRIPTS[script]), F.lit(False))


def profile(text: Column) -> Column:
    """Names of the scripts of a text, comma-separated, in the fixed order."""
    return F.array_join(F.array_compact(F.array(*[F.when(has(s, text), F.lit(s)) for s in SCRIPTS])), ",")


def any_of(text: Column, characters: str) -> Column:
    """Whether a text holds a character of the class; false for null."""
    return F.coalesce(text.rlike(characters), F.lit(False))


def has_syllables(text: Column) -> Column:
    """The narrow Hangul test: a composed syllable outside tags."""
    return any_of(without_tags(text), SYLLABLES)


def new_scripts(source: Column, target: Column) -> Column:
    """Names of the unrelated scripts that a target has and its source lacks."""
    return F.array_compact(F.array(*[F.when(any_of(target, c) & ~any_of(source, c), F.lit(n)) for n, c in UNRELATED.items()]))
