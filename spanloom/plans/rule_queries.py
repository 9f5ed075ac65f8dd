"""Queries of classifiers, routing and validators over the tables' texts and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import scripts, spans
from spanloom.functions.patterns import jvm
from spanloom.functions.tokens import balanced_tags, holds
from spanloom.operators import flow, integrity, routing, rules
from spanloom.plans.common import ALL_TEXTS, GLOSSARY, NAMES, PAIRS, Query, all_texts, lit, pairs
from spanloom.sources.tables import table, union_records

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_S = f"[{P.SPACE}]"
_W = P.WORD


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments").filter("text IS NOT NULL").select("fragment_id", "text", "structural_role").dropDuplicates(["fragment_id"])


_FRAGMENTS = "SELECT DISTINCT fragment_id, text, structural_role FROM fragments WHERE text IS NOT NULL"
_strip = lambda c: f"regexp_replace({c}, {lit(f'^{_S}+|{_S}+$')}, '', 'g')"
_any = lambda c, p: f"regexp_matches({c}, {lit(p)})"

# Scripts ------------------------------------------------------------------------------------------------------


@_query
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt units by the scripts they hold."""
    return table(spark, d, "logical_units").groupBy(scripts.profile(F.col("text")).alias("scripts")).agg(F.count("*").alias("units"))


_PROFILE = "concat_ws(',', " + ", ".join(f"CASE WHEN {_any('text', c)} THEN '{s}' END" for s, c in scripts.SCRIPTS.items()) + ")"
SQL["script_profile"] = f"SELECT {_PROFILE} AS scripts, count(*) AS units FROM logical_units GROUP BY 1"


@_query
def hangul_and_han(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each table and field with Hangul by the narrow test (a syllable outside tags), by the wide one, and with Han."""
    t = all_texts(spark, d).filter("text IS NOT NULL").distinct()
    return t.groupBy("tbl", "field").agg(F.count_if(scripts.has_syllables(F.col("text"))).alias("narrow"), F.count_if(scripts.any_of(F.col("text"), scripts.HANGUL)).alias("wide"), F.count_if(scripts.any_of(F.col("text"), scripts.HAN)).alias("han"))


_UNTAGGED = f"regexp_replace(text, {lit(f'</?[A-Za-z][A-Za-z0-9:_-]*(?:{_S}[^<>]*?)?/?>')}, '', 'g')"
SQL["hangul_and_han"] = f"SELECT tbl, field, count(*) FILTER (WHERE regexp_matches({_UNTAGGED}, '[가-힣]')) AS narrow, count(*) FILTER (WHERE {_any('text', scripts.HANGUL)}) AS wide, count(*) FILTER (WHERE {_any('text', scripts.HAN)}) AS han FROM (SELECT DISTINCT * FROM ({ALL_TEXTS})) WHERE text IS NOT NULL GROUP BY tbl, field"


@_query
def new_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Unrelated scripts that a translation has and its source lacks."""
    rows = pairs(spark, d).select("occurrence_id", scripts.new_scripts(F.col("source_text"), F.col("target_text")).alias("s"))
    return rows.filter("size(s) > 0").select("occurrence_id", F.array_join("s", ",").alias("scripts"))


SQL["new_scripts"] = f"SELECT * FROM (SELECT occurrence_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_any('target_text', c)} AND NOT {_any('source_text', c)} THEN '{n}' END" for n, c in scripts.UNRELATED.items()) + f") AS scripts FROM ({PAIRS})) WHERE scripts <> ''"

# Classifiers --------------------------------------------------------------------------------------------------


@_query
def translatable_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whether each fragment, rebuilt unit and segment needs a translation. No SQL (look-around within one expression); tested against brute force."""
    rows = union_records([(table(spark, d, t), t, k, c) for t, k, c in (("fragments", "fragment_id", "text"), ("logical_units", "logical_unit_id", "text"), ("segments", "segment_id", "src"))])
    return rows.filter("text IS NOT NULL").select("tbl", "record_id", rules.needs_translation(F.col("text"), NAMES).alias("needed")).distinct()


@_query
def preserve_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why the source of each occurrence may stay as it is, if it may."""
    o = table(spark, d, "occurrences").select("occurrence_id", "source_text", "preserve_reason").dropDuplicates(["occurrence_id"])
    explicit = F.coalesce(F.col("preserve_reason") == "explicit_preserve_list", F.lit(False))
    return o.select("occurrence_id", rules.preserve_reason(F.col("source_text"), explicit, NAMES).alias("reason")).filter("reason IS NOT NULL")


@_query
def table_cell_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whether each fragment, were it a table cell, holds natural language."""
    return _fragments(spark, d).select("fragment_id", rules.translate_cell(F.col("text")).alias("natural"))


_META = " OR ".join(f"regexp_full_match(v, {lit(p)})" for p in (
    r"[A-Z]{2,}(?:-[A-Z0-9]+){2,}", rf"(?i)Rev\.{_S}*:?{_S}*\p{{Nd}}+(?:\.\p{{Nd}}+)+", rf"\p{{Nd}}{{1,4}}{_S}*/{_S}*\p{{Nd}}{{1,4}}", rf"(?:19|20)\p{{Nd}}{{2}}[.-]{_S}*\p{{Nd}}{{1,2}}[.-]{_S}*\p{{Nd}}{{1,2}}",
    r"(?:[01]\p{Nd}|2[0-3]):[0-5]\p{Nd}:[0-5]\p{Nd}", r"[A-Z]{2,}[A-Z0-9]*\p{Nd}{2,}", rf"(?i)CONFIDENTIAL(?:{_S}+\p{{Nd}}{{4}})?",
))
_EDGE = "[()\\[\\]{}:;,\"'“”]"
SQL["table_cell_filter"] = rf"""WITH f AS (SELECT fragment_id, regexp_replace({_strip('text')}, '{_S}+', ' ', 'g') AS v FROM ({_FRAGMENTS})), t AS (SELECT fragment_id, regexp_replace(unnest(string_split(v, ' ')), {lit(f'^{_EDGE}+|{_EDGE}+$')}, '', 'g') AS t FROM f),
    l AS (SELECT fragment_id, t, regexp_replace(t, '[^\p{{L}}]', '', 'g') AS l FROM t), n AS (SELECT fragment_id, CASE WHEN regexp_matches(l, '[가-힣]') OR regexp_matches(l, '[㐀-鿿]{{2,}}') THEN true WHEN lower(t) IN ('dry', 'wet') THEN true WHEN lower(t) IN ('max', 'min') THEN false
    WHEN regexp_matches(t, '[Ͱ-Ͽ]') OR length(l) <= 2 THEN false WHEN regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '\p{{Ll}}') THEN false WHEN regexp_matches(t, '\p{{Nd}}|[a-z][A-Z]|[%._/·]') OR len(regexp_extract_all(l, '\p{{Lu}}')) >= 2 THEN false ELSE regexp_matches(l, '\p{{Ll}}') END AS n FROM l),
    g AS (SELECT fragment_id, bool_or(n) AS n FROM n GROUP BY fragment_id)
    SELECT fragment_id, CASE WHEN v = '' OR regexp_full_match(v, {lit(P.STANDALONE_TERM.replace(chr(92) + 's', _S))}) OR {_META} THEN false ELSE n END AS natural FROM f JOIN g USING (fragment_id)"""


@_query
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Of each fragment: translate it if rotated, prose though set small, natural-language prose, safe to share a translation, safe as a cache key."""
    t = F.col("text")
    return _fragments(spark, d).select("fragment_id", rules.translate_rotated(t).alias("rotated"), rules.run_is_prose(t).alias("prose_run"), integrity.is_prose(t).alias("prose"), rules.safe_to_share(t).alias("shared"), rules.safe_to_share(t, "cache").alias("cached"))


_PLAIN = _strip("regexp_replace(text, '(?i)</?s[123]>', '', 'g')")
_SEGMENT = _strip(rf"regexp_replace({_PLAIN}, '\{{v\p{{Nd}}+\}}', '', 'g')")
_CACHED = _strip(rf"regexp_replace(text, '(?i)\{{v\p{{Nd}}+\}}|</?[bs]\p{{Nd}}+>', '', 'g')")
_VISIBLE = rf"regexp_replace(regexp_replace(text, '(?i)</?s[123]>', '', 'g'), '(?i)</?b\p{{Nd}}+>|\{{{_S}*v[\p{{Nd}}{P.SPACE}]+\}}', '', 'g')"
_safe = lambda v: f"length({v}) >= 24 OR len(regexp_extract_all({v}, '{P.SHARED_WORD}')) >= 4 OR (length({v}) >= 12 AND regexp_matches({v}, '[.!?:。！？]{_S}*$'))"
SQL["text_predicates"] = rf"""WITH f AS (SELECT fragment_id, {_PLAIN} AS p, {_SEGMENT} AS s, {_CACHED} AS c, {_VISIBLE} AS v, {_strip('text')} AS t FROM ({_FRAGMENTS}))
    SELECT fragment_id, NOT (regexp_matches(p, '\p{{Nd}}') AND regexp_matches(p, '(?i)(^|[^{_W}])(ref|no|rev|code|version)($|[^{_W}])')) AS rotated, length(t) >= 12 AND regexp_matches(t, '[a-z]{{3,}}') AS prose_run,
    len(regexp_extract_all(v, '[A-Za-zÀ-ỹ]{{2,}}')) >= 2 OR len(regexp_extract_all(v, '\p{{L}}')) >= 4 AS prose, {_safe('s')} AS shared, {_safe('c')} AS cached FROM f"""


@_query
def context_sensitive(spark: SparkSession, d: str) -> DataFrame:
    """Korean segments whose reading depends on what stands around them. No SQL (identifiers need look-ahead)."""
    s = table(spark, d, "segments").filter("src IS NOT NULL").select("segment_id", "src").dropDuplicates(["segment_id"])
    return s.select("segment_id", rules.context_sensitive(F.col("src")).alias("sensitive")).filter("sensitive")


@_query
def math_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pure formulas, and blocks of operators without prose, among the fragments. No SQL (look-around)."""
    return _fragments(spark, d).select("fragment_id", rules.is_math(F.col("text")).alias("math"), rules.is_equation(F.col("text")).alias("equation")).filter("math OR equation")


@_query
def option_labels(spark: SparkSession, d: str) -> DataFrame:
    """Option labels at the start of rebuilt units, and the length of the rest without protective markers."""
    u = table(spark, d, "logical_units").filter("text IS NOT NULL").withColumn("o", rules.option_label(F.col("text"))).filter("o.label IS NOT NULL")
    return u.select("logical_unit_id", F.trim("o.label").alias("label"), F.length(rules.strip_markers(F.col("o.rest"))).alias("chars"))


_LABEL = f"^([(]?[A-Da-d1-9][.)]){_S}*"
_STRAY = "regexp_extract(text, {0}, 0)"
_REST = f"substr(text, length(regexp_extract(text, {lit(_LABEL)}, 0)) + 1)"
for _p in (rf"(?i)<{_S}*/?{_S}*b{_S}*\p{{Nd}}+{_S}*>", rf"(?i)<{_S}*/?{_S}*s{_S}*[123]{_S}*>", rf"(?i)\{{{_S}*v{_S}*\p{{Nd}}+{_S}*\}}"):
    _REST = f"regexp_replace({_REST}, {lit(_p)}, '', 'g')"
SQL["option_labels"] = f"SELECT logical_unit_id, trim(regexp_extract(text, {lit(_LABEL)}, 0)) AS label, length({_REST})::INT AS chars FROM logical_units WHERE regexp_matches(text, {lit(_LABEL)})"


@_query
def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    """Confidentiality markers that a document holds, in the declared order; the last word stands for texts of these tables."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(m.lower())), F.lit(m)) for m in _MARKERS]))
    return docs.select("doc_id", F.array_join(found, ",").alias("markers")).filter("markers <> ''")


_MARKERS = [*P.MARKERS, "No. 4"]
SQL["marker_scan"] = "SELECT doc_id, m AS markers FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), {lit(m.lower())}) THEN {lit(m)} END" for m in _MARKERS) + ") AS m FROM documents) WHERE m <> ''"


@_query
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the class of the failure their text would be."""
    return table(spark, d, "documents").groupBy(rules.error_class(F.col("text")).alias("class")).agg(F.count("*").alias("documents"))


SQL["error_classify"] = "SELECT CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {lit(m.lower())})' for m in marks)} THEN '{n}'" for n, marks in P.ERRORS) + " ELSE 'E-UNKNOWN' END AS class, count(*) AS documents FROM (SELECT lower(coalesce(text, '')) AS t FROM documents) GROUP BY 1"

#: Recorded codes as classes of errors.
_CLASSES = {"technical_invariant": "TechnicalInvariantError", "provider_timeout": "Timeout", "quality_failure": "UnresolvedSegmentError", "length_explosion": "translation cannot fit", "unexpected_script": "TranslationIntegrityError"}


@_query
def failure_digest(spark: SparkSession, d: str) -> DataFrame:
    """Recorded failures and unresolved reasons folded into what a reader is told."""
    o = table(spark, d, "occurrences").dropDuplicates(["occurrence_id"])
    codes = F.concat(F.coalesce("validation_failures", F.array().cast("array<string>")), F.array_compact(F.array("unresolved_reason")))
    known = F.create_map(*[F.lit(x) for pair in _CLASSES.items() for x in pair])
    rows = o.select(F.explode(codes).alias("c")).select(F.coalesce(F.try_element_at(known, F.col("c")), F.col("c")).alias("r"))
    return rows.groupBy(rules.digest_class(F.col("r")).alias("category")).agg(F.count("*").alias("failures"))


SQL["failure_digest"] = """WITH o AS (SELECT DISTINCT ON (occurrence_id) * FROM occurrences), c AS (SELECT unnest(validation_failures) AS c FROM o UNION ALL SELECT unresolved_reason FROM o WHERE unresolved_reason IS NOT NULL),
    r AS (SELECT CASE c """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CLASSES.items()) + """ ELSE c END AS r FROM c)
    SELECT CASE WHEN contains(r, 'font size') OR contains(r, 'cannot fit') THEN 'fit' WHEN r = 'FormulaPlaceholderError' THEN 'formula' WHEN r = 'SegmentTooLongError' THEN 'too_long' WHEN r = 'TechnicalInvariantError' THEN 'invariant'
    WHEN r = 'UnresolvedSegmentError' THEN 'unresolved' ELSE 'engine' END AS category, count(*) AS failures FROM r GROUP BY 1"""

# Routing ------------------------------------------------------------------------------------------------------


@_query
def routing_features(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen features of every rebuilt unit. No SQL (protected spans need look-around)."""
    u = table(spark, d, "logical_units").filter("text IS NOT NULL")
    lines = F.coalesce(F.size("source_fragment_ids"), F.lit(0))
    reasons = F.filter("merge_reasons", lambda r: r != "single_fragment")
    callout = F.coalesce(F.exists("merge_reasons", lambda r: r == "callout_continuation"), F.lit(False))
    dense = F.coalesce(F.exists("merge_reasons", lambda r: r == "same_cell_continuation"), F.lit(False)) & (F.length("text") >= routing.DENSE)
    f = routing.features(F.col("text"), lines > 1, routing.complexity(reasons), callout, dense, NAMES)
    return u.select("logical_unit_id", *[v.alias(k) for k, v in f.items()], (~rules.needs_translation(F.col("text"), NAMES)).alias("preserve"))


@_query
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    """Way and reason of every rebuilt unit: the first of nine rules that holds."""
    r = routing_features(spark, d).withColumn("reason", routing.reason(F.col("preserve")))
    return r.select("logical_unit_id", routing.engine(F.col("reason")).alias("route"), "reason")


@_query
def routing_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Share of each way among the units, and of the hand-off among what is not kept."""
    per = route_decision(spark, d).groupBy("route").agg(F.count("*").alias("units"))
    total = per.agg(F.sum("units").alias("all"), F.sum(F.when(F.col("route") != "preserve", F.col("units"))).alias("sent"))
    ratio = lambda c: F.coalesce(F.round(F.try_divide(F.col("units"), F.col(c)), 4), F.lit(0.0))
    return per.crossJoin(F.broadcast(total)).select("route", "units", ratio("all").alias("ratio"), F.when(F.col("route") == "handoff", ratio("sent")).otherwise(0.0).alias("escalation_ratio"))  # one row


# Validators ---------------------------------------------------------------------------------------------------


@_query
def invariant_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every category in which the deterministic content of a pair differs. No SQL (associations and identifiers need look-around)."""
    rows = pairs(spark, d).select("occurrence_id", F.explode(integrity.invariant_differences(F.col("source_text"), F.col("target_text"))).alias("d"))
    return rows.select("occurrence_id", "d.category", F.array_join("d.missing", "|").alias("missing"), F.array_join("d.added", "|").alias("added"))


@_query
def meaning_diff(spark: SparkSession, d: str) -> DataFrame:
    """Cues of meaning that Vietnamese targets lost or turned round, Korean ones and order included."""
    rows = pairs(spark, d).filter("lang_out = 'vi'").select("occurrence_id", F.explode(integrity.meaning_differences(F.col("source_text"), F.col("target_text"), F.col("lang_out"))).alias("d"))
    return rows.select("occurrence_id", "d.category", F.array_join("d.missing", "|").alias("missing"), F.array_join("d.added", "|").alias("added"))


@_query
def semantic_cues(spark: SparkSession, d: str) -> DataFrame:
    """The cues of prohibition, duty, advice and permission that sources other than Korean have and Vietnamese targets lack."""
    s, t = F.col("source_text"), F.col("target_text")
    rows = pairs(spark, d).filter("lang_out = 'vi'").filter(~scripts.has_syllables(s))
    lost = F.array_compact(F.array(*[F.when(holds(s, a) & ~holds(t, b), F.lit(n)) for n, a, b in P.CUES]))
    return rows.select("occurrence_id", F.array_join(lost, ",").alias("cues")).filter("cues <> ''")


_word = lambda words: f"(?i)(?:^|[^{_W}])(?:{words})(?:$|[^{_W}])"
_has = lambda c, words, more="": _any(c, _word(words)) + (f" OR {_any(c, more)}" if more else "")
_ANSWERS = {"prohibition": "không|cấm|đừng", "mandatory": "phải|bắt buộc|nhất thiết", "recommended": "nên|khuyến nghị|khuyến cáo", "permission": "được phép|cho phép|có thể"}
_ASKED = {
    "prohibition": _has("source_text", "do not|must not|shall not|never|is not permitted|is not allowed", f"하지{_S}*마|금지|禁止|不得|严禁|嚴禁|请勿|請勿|切勿"),
    "mandatory": f"regexp_matches(regexp_replace(source_text, {lit(f'(?i)(?:must|shall){_S}+not($|[^{_W}])')}, ' ', 'g'), {lit(_word('must|shall'))}) OR " + _any("source_text", f"반드시|하여야{_S}*한다|해야{_S}*한다|必须|必須"),
    "recommended": _has("source_text", "should|recommended", "권장|建议|建議"), "permission": _has("source_text", "is permitted|is allowed"),
}
SQL["semantic_cues"] = "SELECT * FROM (SELECT occurrence_id, concat_ws(',', " + ", ".join(f"CASE WHEN ({_ASKED[n]}) AND NOT {_any('target_text', _word(_ANSWERS[n]))} THEN '{n}' END" for n in _ANSWERS) + f") AS cues FROM ({PAIRS}) WHERE lang_out = 'vi' AND NOT regexp_matches({_UNTAGGED.replace('(text', '(source_text')}, '[가-힣]')) WHERE cues <> ''"


@_query
def english_missing(spark: SparkSession, d: str) -> DataFrame:
    """English terms, labels and acronyms of Korean sources that the target lacks."""
    rows = pairs(spark, d).select("occurrence_id", integrity.english_missing(F.col("source_text"), F.col("target_text")).alias("m"))
    return rows.filter("size(m) > 0").select("occurrence_id", F.array_join("m", "|").alias("missing"))


@_query
def name_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in which a kept name stands more or less often in the target than in the source."""
    return pairs(spark, d).filter(integrity.name_counts_differ(F.col("source_text"), F.col("target_text"), NAMES)).select("occurrence_id")


_NAME_COUNT = lambda c: f"len(regexp_extract_all(regexp_replace({c}, '([^A-Za-z0-9_])', '\\1' || chr(1), 'g'), {lit('(?:^|[^A-Za-z0-9_])' + NAMES[0].replace('.', chr(92) + '.' + chr(1)).replace(' ', ' ' + chr(1)) + '(?:$|[^A-Za-z0-9_])')}))"
SQL["name_counts"] = f"SELECT occurrence_id FROM ({PAIRS}) WHERE {_NAME_COUNT('source_text')} <> {_NAME_COUNT('target_text')}"


@_query
def integrity_codes(spark: SparkSession, d: str) -> DataFrame:
    """Failure codes of translations into Vietnamese in fixed order, kept spans taken out. No SQL (compatibility forms, back-references, look-around)."""
    rows = pairs(spark, d).filter("lang_out = 'vi'")
    codes = integrity.integrity_codes(F.col("source_text"), F.col("target_text"), F.col("lang_in"), F.col("lang_out"), F.lit(True), NAMES)
    return rows.select("occurrence_id", F.array_join(codes, ",").alias("codes")).filter("codes <> ''")


@_query
def validation_reason(spark: SparkSession, d: str) -> DataFrame:
    """Translations into Vietnamese by the first check that they fail."""
    rows = pairs(spark, d).filter("lang_out = 'vi'")
    reason = F.coalesce(integrity.first_failure(F.col("source_text"), F.col("target_text"), F.col("lang_out"), NAMES), F.lit("accepted"))
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("occurrences"))


@_query
def handoff_assess(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences into Vietnamese as a hand-off would take them: accepted, missing, or the first check that fails."""
    o = table(spark, d, "occurrences").filter("lang_out = 'vi' AND source_text IS NOT NULL").select("occurrence_id", "source_text", "target_text").dropDuplicates(["occurrence_id"])
    return flow.assess(o.select(F.col("occurrence_id").alias("segment_id"), F.col("source_text").alias("src")), o.select(F.col("occurrence_id").alias("segment_id"), F.col("source_text").alias("src"), F.col("target_text").alias("dst")), NAMES)


@_query
def dup_fragment(spark: SparkSession, d: str) -> DataFrame:
    """Translations that repeat a sentence, or end in a part of the one before, where the source does not. No SQL."""
    return pairs(spark, d).filter(integrity.repeats_fragment(F.col("source_text"), F.col("target_text"))).select("occurrence_id")


@_query
def sentence_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one sentence of four words or more in a target: how many, and the longest."""
    rows = pairs(spark, d).select("occurrence_id", integrity.sentence_runs(integrity.sentence_tokens(F.col("target_text"))).alias("r")).filter("size(r) > 0")
    return rows.select("occurrence_id", F.size("r").alias("runs"), F.array_max(F.transform("r", lambda x: x["n"])).alias("longest"))


SQL["sentence_runs"] = rf"""WITH s AS (SELECT occurrence_id, list_filter(string_split(regexp_replace(regexp_replace(target_text, '(?i)</?[bs]\p{{Nd}}+>', '', 'g'), '([.!?]){_S}*', '\1' || chr(2), 'g'), chr(2)), lambda x: NOT regexp_full_match(x, '{_S}*')) AS s FROM ({PAIRS})),
    u AS (SELECT occurrence_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM s), w AS (SELECT occurrence_id, i, list_transform(regexp_extract_all(s, '[\p{{L}}\p{{N}}]+(?:[-/][\p{{L}}\p{{N}}]+)*'), lambda x: lower(x)) AS w FROM u),
    g AS (SELECT *, sum(CASE WHEN w IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY occurrence_id ORDER BY i) AS k FROM (SELECT *, lag(w) OVER (PARTITION BY occurrence_id ORDER BY i) AS p FROM w)),
    r AS (SELECT occurrence_id, k, count(*) AS n, max(len(w)) AS words FROM g GROUP BY occurrence_id, k) SELECT occurrence_id, count(*)::INT AS runs, max(n)::INT AS longest FROM r WHERE n > 1 AND words >= 4 GROUP BY occurrence_id"""


@_query
def terminology_missing(spark: SparkSession, d: str) -> DataFrame:
    """Agreed words that translations into Vietnamese lack though the source has the term; the glossary is a parameter."""
    rows = pairs(spark, d).filter("lang_out = 'vi'").select("occurrence_id", integrity.terms_missing(F.col("source_text"), F.col("target_text"), GLOSSARY).alias("m"))
    return rows.filter("size(m) > 0").select("occurrence_id", F.array_join("m", "|").alias("missing"))


_contains = lambda c, t: f"regexp_matches(lower({c}), {lit(f'(^|[^{_W}]){t.lower()}($|[^{_W}])')})" if t.isascii() and t.isalnum() else f"contains(lower({c}), {lit(t.lower())})"
SQL["terminology_missing"] = "SELECT * FROM (SELECT occurrence_id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_contains('source_text', a)} AND NOT {_contains('target_text', b)} THEN {lit(b)} END" for a, b in GLOSSARY.items()) + f"], lambda x: x IS NOT NULL))), '|') AS missing FROM ({PAIRS}) WHERE lang_out = 'vi') WHERE missing <> ''"


@_query
def approved_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of every rebuilt unit that may stay as they are, with place and reason; and whether what is left is prose."""
    u = table(spark, d, "logical_units").filter("text IS NOT NULL").select("logical_unit_id", "text", spans.approved(F.col("text"), NAMES).alias("s")).filter("size(s) > 0")
    return u.select("logical_unit_id", integrity.is_prose(spans.remove_first(F.col("text"), F.col("s"))).alias("prose"), F.explode("s").alias("s")).select("logical_unit_id", "prose", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.literal").alias("literal"), F.col("s.kind").alias("reason"))


@_query
def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Segments with names, paths or labels: how many are hidden, and whether hiding and putting back gives the text again."""
    s = table(spark, d, "segments").filter("src IS NOT NULL").select("segment_id", "src").dropDuplicates(["segment_id"])
    m = s.withColumn("m", spans.mask_literals(F.col("src"), NAMES)).filter("size(m.masks) > 0").withColumn("r", spans.restore(F.col("m.masked"), F.col("m.masks")))
    return m.select("segment_id", F.size("m.masks").alias("hidden"), (F.col("r.text") == F.col("src")).alias("same"), (F.length("m.masked") - F.length("src")).alias("longer"))


@_query
def style_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Style tags of every text that has some: the pairs, or that they are crossed or open; and whether all its tags nest."""
    rows = all_texts(spark, d).filter(F.col("text").rlike(jvm(P.STYLE_TAG))).distinct()
    return rows.select("tbl", "field", "record_id", F.coalesce(F.array_join(integrity.style_pairs(F.col("text")), ","), F.lit("malformed")).alias("pairs"), balanced_tags(F.col("text")).alias("balanced"))


@_query
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with control characters or an abbreviated number: their length without the former, and the digest with "No." for the latter."""
    odd = F.col("text").rlike(r"\p{Cc}|\p{Cf}") | holds(F.col("text"), P.NUMBER_ABBREVIATION)
    rows = table(spark, d, "documents").filter(odd)
    return rows.select("doc_id", F.length(F.regexp_replace("text", r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}]", "")).alias("chars"), F.md5(F.regexp_replace("text", jvm(P.NUMBER_ABBREVIATION), "No.")).alias("digest"))


SQL["plain_texts"] = rf"""SELECT doc_id, length(regexp_replace(text, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]', '', 'g'))::INT AS chars, md5(regexp_replace(text, '(^|[^A-Za-z])no\.({_S}*\p{{Nd}})', '\1No.\2', 'g')) AS digest FROM documents
    WHERE regexp_matches(text, '\p{{Cc}}|\p{{Cf}}') OR regexp_matches(text, '(^|[^A-Za-z])no\.{_S}*\p{{Nd}}')"""


@_query
def cjk_residual(spark: SparkSession, d: str) -> DataFrame:
    """Vietnamese targets with East Asian characters, by why they may have them."""
    rows = pairs(spark, d).filter("lang_out = 'vi'").filter(F.col("target_text").rlike(P.RESIDUAL_CJK))
    return rows.groupBy(rules.residual_class(F.col("target_text"), NAMES).alias("class")).agg(F.count("*").alias("occurrences"))


SQL["cjk_residual"] = f"SELECT 'UNTRANSLATED_PROSE' AS class, count(*) AS occurrences FROM ({PAIRS}) WHERE lang_out = 'vi' AND regexp_matches(target_text, {lit(P.RESIDUAL_CJK)}) HAVING count(*) > 0"


@_query
def length_explosion(spark: SparkSession, d: str) -> DataFrame:
    """Translations more than three times as long as a source of more than 20 characters, tags apart."""
    s, t = F.length(integrity.visible(F.col("source_text"))), F.length(integrity.visible(F.col("target_text")))
    return pairs(spark, d).select("occurrence_id", s.alias("s"), t.alias("t")).filter("s > 20 AND t > 3 * s").select("occurrence_id", F.round(F.col("t") / F.col("s"), 3).alias("ratio"))


_LEN = lambda c: f"length({_VISIBLE.replace('(text', '(' + c)})"
SQL["length_explosion"] = f"SELECT occurrence_id, round({_LEN('target_text')} / {_LEN('source_text')}, 3) AS ratio FROM ({PAIRS}) WHERE {_LEN('source_text')} > 20 AND {_LEN('target_text')} > 3 * {_LEN('source_text')}"
