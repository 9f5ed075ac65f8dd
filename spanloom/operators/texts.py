"""Judgements of whole tables of texts: tag nesting, formula markers, token spans, kinds of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import spans as S
from spanloom.operators.geometry import PAGE, boxes

#: A tag with its attributes, and the name of one.
TAG = r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s[^<>]*)?/?>"
TAG_NAME = "^</?([A-Za-z][A-Za-z0-9:_-]*)"
#: A formula marker in any spelling, and what its masked form looks like.
MARKER = r"(?i)\{\s*v[0-9\s]*[0-9][0-9\s]*\}"
MASKED = "</?b[0-9]+>"


def tag_nesting(texts: DataFrame) -> DataFrame:
    """(tbl, field, record_id, tags, balanced) of every text with a tag: a stack folded over the tags; self-closing ones are skipped."""
    tags = F.regexp_extract_all("text", F.lit(TAG), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, TAG_NAME, 1))

    def step(stack: Column, t: Column) -> Column:
        top_fits = (F.size(stack) > 0) & (F.element_at(stack, -1) == name(t))
        opened = F.when(~t.startswith("</"), F.concat(stack, F.array(name(t)))).when(top_fits, F.slice(stack, 1, F.size(stack) - 1))
        return F.when(t.endswith("/>"), stack).otherwise(opened.otherwise(F.concat(stack, F.array(F.lit("!")))))

    found = texts.withColumn("t", tags).filter("size(t) > 0")
    balanced = F.size(F.aggregate("t", F.array().cast("array<string>"), step)) == 0
    return found.select("tbl", "field", "record_id", F.size("t").alias("tags"), balanced.alias("balanced")).dropDuplicates(["tbl", "field", "record_id"])


def formula_markers(texts: DataFrame) -> DataFrame:
    """(tbl, field, record_id, masked, same) of every text with a formula marker or the masked form of one.

    ``masked`` has the tag pairs the markers become; ``same`` says whether the
    way back gives the text again: it does not if a marker is spelled otherwise
    than it is restored, or if the text holds masked forms of its own.
    """
    rows = texts.filter(F.col("text").rlike(MARKER) | F.col("text").rlike(MASKED)).withColumn("m", F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)))
    number = F.transform("m", lambda x: F.regexp_replace(F.regexp_replace(x, "[^0-9]", ""), "^0+([0-9])", "$1"))
    back = F.transform("k", lambda k: F.concat(F.lit("{v"), k, F.lit("}")))
    pairs = F.transform("k", lambda k: F.concat(F.lit("<b"), k, F.lit("></b"), k, F.lit(">")))
    judged = rows.withColumn("k", number).select("tbl", "field", "record_id", F.array_join(pairs, "").alias("masked"), ((F.col("m") == back) & ~F.col("text").rlike(MASKED)).alias("same"))
    return judged.dropDuplicates(["tbl", "field", "record_id"])


#: Categories whose tokens stand in the text as they are, so that they have a place.
PLACED = {
    "placeholders": P.PLACEHOLDER, "tags": P.TAG, "urls": P.URL, "windows_paths": P.WINDOWS_PATH, "posix_paths": P.POSIX_PATH, "file_names": P.FILE_NAME, "document_labels": P.DOCUMENT_LABEL,
    "ipv4": P.IPV4, "endpoints": P.ENDPOINT, "identifiers": P.IDENTIFIER, "standards": P.STANDARD, "versions": P.VERSION, "document_ids": P.DOCUMENT_ID, "numbers": P.NUMBER, "ranges": P.RANGE,
    "units": P.UNIT, "quantities": P.QUANTITY, "single_letter_quantities": P.SINGLE_LETTER_QUANTITY, "polarity": P.POLARITY,
}


def token_spans(texts: DataFrame) -> DataFrame:
    """(tbl, record_id, start_at, end_at, category): spans of the tokens of all placed categories, leftmost-longest, of every text."""
    once = texts.filter("text IS NOT NULL").dropDuplicates(["tbl", "record_id"])
    found = S.select(F.concat(*[S.find(F.col("text"), p, n) for n, p in PLACED.items()]))
    return once.select("tbl", "record_id", F.explode(found).alias("s")).select("tbl", "record_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.kind").alias("category"))


# Kinds of pages. White space, line ends and digits are those of Unicode, spelled out for Java and RE2 alike.
_S = P.SPACE
BLANK, SOLID, DIGIT = f"[{_S}]", f"[^{_S}]", r"\p{Nd}"
LINE_END = P.LINE_END
EDGES = f"^{BLANK}+|{BLANK}+$"
_RULE = "[\x08�─-╿]"
#: Flag of a line -> pattern, and up to which line of the page it counts (0: any).
FLAGS: dict[str, tuple[str, int]] = {
    "leader": (rf"[.]{{5,}}|(?:[.]{BLANK}){{4,}}|{_RULE}{{3,}}", 0),
    "ruled": (rf"{_RULE}+{BLANK}*{DIGIT}{{1,4}}$", 0),
    "spaced": (rf"{SOLID}{BLANK}{{5,}}{DIGIT}{{1,4}}$", 0),
    "alone": (rf"^{DIGIT}{{1,4}}$", 0),
    "wide": (rf"[  ]+{BLANK}*(?:{DIGIT}{{1,4}}|[ivxlcdmIVXLCDM]+)$", 0),
    "ending": (rf"{SOLID}{BLANK}+{DIGIT}{{1,4}}$", 0),
    "comma": (rf",{BLANK}*{DIGIT}{{1,4}}", 0),
    "contents": (rf"(?i)^(?:table{BLANK}+of{BLANK}+)?contents?$", 5),
    "indexed": ("(?i)^index$", 1),
    "symbols": (rf"(?i)^(?:nomenclature|list{BLANK}+of{BLANK}+symbols|symbols?{BLANK}+and{BLANK}+abbreviations?|glossary|notation)s?$", 5),
    "sources": (rf"(?i)^\xad?(?:references?|bibliography|suggested{BLANK}+reading|further{BLANK}+reading|works?{BLANK}+cited)$", 10),
    "numbered": (rf"^{DIGIT}{{1,3}}[.]{BLANK}", 0),
    "authored": (rf"^[A-Z][a-z]+,?{BLANK}.*[(]{DIGIT}{{4}}[)]", 0),
    "bracketed": (rf"^\[{DIGIT}{{1,3}}\]", 0),
    "dated": (rf"[(]{DIGIT}{{4}}[)]", 0),
    "linked": (r"(?i)ISBN|ISSN|doi[.]org|https?://", 0),
    "digits": (rf"^{DIGIT}+$", 0),
}
#: What is counted per page: the first four flags exclude each other in this order, the others stand for themselves.
COUNTS = {"ruled": "ruled AND NOT leader", "spaced": "spaced AND NOT leader AND NOT ruled", "alone": "alone AND NOT leader AND NOT ruled AND NOT spaced", "pairs": "length(l) <= 15 AND length(after) > 5 AND NOT digits"}
COUNTS |= {n: n for n in FLAGS if n not in COUNTS and n != "digits"}
#: Score of a table of contents, and the kind, over the counts of a page with n lines; the same text runs in other SQL engines.
SCORE = "3 * leader + 2 * ruled + CASE WHEN contents > 0 THEN 5 ELSE 0 END + CASE WHEN spaced >= 5 THEN spaced ELSE 0 END + CASE WHEN wide >= 5 THEN wide ELSE 0 END"
KIND = f"""CASE
 WHEN ({SCORE}) + CASE WHEN alone >= 8 AND ({SCORE}) > 0 THEN alone ELSE 0 END + CASE WHEN n >= 15 AND alone >= 10 AND alone > 0.3 * n THEN alone ELSE 0 END + CASE WHEN n >= 15 AND ending > 0.8 * n THEN ending ELSE 0 END >= 8 THEN 'TOC'
 WHEN (n >= 20 AND comma > 0.4 * n) OR indexed > 0 THEN 'INDEX'
 WHEN symbols > 0 AND n >= 10 AND pairs > 0.3 * n THEN 'NOMENCLATURE'
 WHEN sources > 0 AND numbered + authored + bracketed + dated + linked >= 5 THEN 'REFERENCES'
 WHEN n >= 10 AND numbered + authored + bracketed >= 5 AND dated + linked >= 3 THEN 'REFERENCES' END"""


def page_kinds(fragments: DataFrame) -> DataFrame:
    """(manual_id, page, lines, kind) of every page, rebuilt from its fragments in reading order; kind is null for running text.

    The text of a page is never gathered: its lines are flagged one by one,
    each knowing its place and the line after it, and the flags are counted.
    """
    raw = boxes(fragments).select(*PAGE, "reading_order", "y0", "x0", "fragment_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END, -1)).alias("i", "raw"))
    lines = raw.withColumn("l", F.nullif(F.regexp_replace("raw", EDGES, ""), F.lit(""))).withColumn("blank", F.col("l").isNull())
    order = Window.partitionBy(*PAGE, "blank").orderBy("reading_order", "y0", "x0", "fragment_id", "i")
    placed = lines.select(*PAGE, "l", F.row_number().over(order).alias("k"), F.lead("l").over(order).alias("after"))
    flags = {n: F.col("l").rlike(p) & (F.col("k") <= most if most else F.lit(True)) for n, (p, most) in FLAGS.items()}
    counts = [F.count_if(F.expr(c)).alias(n) for n, c in COUNTS.items()]
    per = placed.withColumns(flags).groupBy(*PAGE).agg(F.count("l").alias("n"), *counts)
    return per.select(*PAGE, F.col("n").alias("lines"), F.expr(KIND).alias("kind"))
