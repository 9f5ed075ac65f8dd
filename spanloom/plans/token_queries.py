"""Queries of typed tokens, and SQL for them that knows no look-around.

The SQL is written on its own. Where a pattern must not touch certain
characters on either side, every other character is first followed by a mark
(chr(1)): a match then takes one neighbour on each side, and the next match still
finds one. Marks inside a token are part of its pattern and taken out afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.tokens import EXTRACTORS, bag_minus, tokens
from spanloom.plans.common import ALL_TEXTS, CASES, CASES_SQL, PAIRS, Query, all_texts, lit, pairs
from spanloom.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_M = "\x01"
_S = f"[{P.SPACE}]"
_W = P.WORD


def _mark(text: str, inner: str) -> str:
    return f"regexp_replace({text}, '([^{inner}\\p{{Nd}}])', '\\1' || chr(1), 'g')"


def _group(text: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {n})"


def _unmarked(tokens_: str) -> str:
    return f"list_transform({tokens_}, lambda x: replace(x, chr(1), ''))"


_ALNUM, _NUMERIC = "A-Za-z0-9", "A-Za-z0-9_."
_GAP = f"(?:{_S}{_M})*"
_SIGNED = f"(?:[-+]{_M})?\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?"
#: Units as they look between marks after every character but letters, figures, "_" and ".".
_UNITS = "|".join(u.replace("·", f"·{_M}").replace("/", f"/{_M}").replace("µ", f"µ{_M}").replace("μ", f"μ{_M}").replace("°", f"°{_M}").replace("%", f"%{_M}") for u in P.UNITS.split("|"))


def _evened(text: str) -> str:
    """Quantities as "value unit", in marked form."""
    out = _mark(text, _NUMERIC)
    for odd, plain in ((r"N\.m", f"N·{_M}m"), (f"μ{_M}s", f"µ{_M}s"), (None, None)):
        p = f"(^|[^{_NUMERIC}])({_SIGNED}){_GAP}({odd or _UNITS})($|[^{_ALNUM}])"
        out = f"regexp_replace({out}, {lit(p)}, {lit(chr(92) + '1' + chr(92) + '2 ' + _M + (plain or chr(92) + '3') + chr(92) + '4')}, 'g')"
    return out


def _plain_evened(text: str) -> str:
    return f"replace({_evened(text)}, chr(1), '')"


_FILE = f"(?i).+\\.(?:{P.EXTENSIONS})"
_IP = f"{P.OCTET}(?:\\.{P.OCTET}){{3}}".replace(r"\d", r"\p{Nd}")
#: Category -> SQL expression over ``text`` (not null) that gives the list of its tokens.
EXPRESSIONS: dict[str, str] = {
    "placeholders": _group("text", rf"\{{\{{[^{{}}\r\n]+\}}\}}|\{{[A-Za-z_][{_W}.-]*\}}|\$\{{[A-Za-z_][{_W}.-]*\}}|\$[A-Za-z_][{_W}.-]*|%(?:\p{{Nd}}+|[sdif])", 0),
    "tags": _group("text", f"</?[A-Za-z][A-Za-z0-9:_-]*(?:{_S}[^<>]*?)?/?>", 0),
    "urls": f"list_transform({_group('text', f'(?i)https?://[^{P.SPACE}<>' + chr(34) + chr(39) + ']+', 0)}, lambda x: regexp_replace(x, '[.,;:!?)]+$', ''))",
    "posix_paths": _group("text", rf"(?:^|[^{_W}:])((?:\.{{0,2}}/|/)[{_W}.-]+(?:/[{_W}.-]+)+)"),
    "file_names": f"list_filter(regexp_extract_all(regexp_replace(text, {lit(f'([A-Za-z0-9])[.!?]({_S}|$)')}, '\\1\\2', 'g'), '[{_W}.-]+'), lambda x: regexp_full_match(x, {lit(_FILE)}))",
    "document_labels": _unmarked(_group(_mark("text", _W), f"(?:^|[^{_W}])(Page(?:{_S}{_M})+No(?:\\.{_M})?)(?:$|[^{_W}])")),
    "ipv4": f"list_filter(regexp_extract_all(text, '[\\p{{Nd}}.]+'), lambda x: regexp_full_match(x, {lit(_IP)}))",
    "endpoints": _unmarked(_group(_mark("text", _ALNUM), f"(?:^|[^{_ALNUM}])((?:TCP|UDP)/{_M}\\p{{Nd}}{{1,5}})(?:$|[^{_ALNUM}])")),
    "standards": _unmarked(_group(_mark("text", _ALNUM), f"(?:^|[^{_ALNUM}])((?:ISO|IEC|EN|KS|DIN|JIS)(?:{_S}{_M})+[A-Z]?{_GAP}\\p{{Nd}}+(?:-{_M}\\p{{Nd}}+)*(?::{_M}\\p{{Nd}}{{4}})?)(?:$|[^{_ALNUM}])")),
    "versions": _unmarked(_group(_mark("text", _ALNUM), f"(?:^|[^{_ALNUM}])(Rev\\.{_M}[A-Za-z0-9]+|v\\p{{Nd}}+(?:\\.{_M}\\p{{Nd}}+){{1,3}})(?:$|[^{_ALNUM}])")),
    "document_ids": _group("text", rf"(?:^|[^{_W}])((?:SPEC|DWG|Document){_S}+No\.{_S}*[A-Za-z0-9._/-]+|(?:P/N|S/N|ECN|ECR|LOT){_S}*:?{_S}*[A-Za-z0-9._/-]+)"),
    "numbers": _unmarked(_group(_evened("text"), f"(?:^|[^{_NUMERIC}])((?:[-+]{_M})?(?:\\p{{Nd}}{{1,3}}(?:,{_M}\\p{{Nd}}{{3}})+|\\p{{Nd}}+)(?:\\.\\p{{Nd}}+)?)(?:$|[^{_NUMERIC}]|\\.(?:$|[^\\p{{Nd}}]))")),
    "ranges": _unmarked(_group(_mark("text", _NUMERIC), f"(?:^|[^{_NUMERIC}])({_SIGNED}{_GAP}(?:[±–-]{_M}){_GAP}{_SIGNED})(?:$|[^{_NUMERIC}])")),
    "units": _unmarked(_group(_mark(_plain_evened("text"), _ALNUM), f"(?:^|[^{_ALNUM}])({_UNITS.replace('N' + chr(92) + '.m', 'N' + chr(92) + '.' + _M + 'm')})(?:$|[^{_ALNUM}])")),
    "quantities": _unmarked(_group(_evened("text"), f"(?:^|[^{_NUMERIC}])({_SIGNED}{_GAP}(?:{_UNITS}))(?:$|[^{_ALNUM}])")),
    "single_letter_quantities": _unmarked(_group(_mark("text", _NUMERIC), f"(?:^|[^{_NUMERIC}])({_SIGNED}{_GAP}(?:V|A|N|m))(?:$|[^{_ALNUM}])")),
    "polarity": _unmarked(_group(_mark("text", _ALNUM), f"(?:^|[^{_ALNUM}])(ON|OFF)(?:$|[^{_ALNUM}])")),
}


def _token_query(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        texts = all_texts(spark, d).unionByName(spark.createDataFrame(CASES, "tbl string, field string, record_id string, text string"))
        rows = texts.select("tbl", "field", "record_id", tokens(name, F.col("text")).alias("t")).filter("size(t) > 0")
        return rows.select("tbl", "field", "record_id", F.size("t").alias("n"), F.array_join("t", "|").alias("tokens")).distinct()

    query.__doc__ = f"Tokens of the category {name} in every text column of six tables, and in cases that hold all categories, as the tables do not."
    return query


for _name in EXTRACTORS:
    QUERIES[f"tok_{_name}"] = _token_query(_name)
    if _name in EXPRESSIONS:
        SQL[f"tok_{_name}"] = f"SELECT DISTINCT tbl, field, record_id, len(t)::INT AS n, array_to_string(t, '|') AS tokens FROM (SELECT tbl, field, record_id, {EXPRESSIONS[_name]} AS t FROM ({ALL_TEXTS} UNION ALL {CASES_SQL}) WHERE text IS NOT NULL) WHERE len(t) > 0"


def token_counts_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.size(tokens("numbers", F.col("text"))).alias("n"), F.size(tokens("ipv4", F.col("text"))).alias("a"))
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("numbers"), F.sum("a").alias("addresses"))


QUERIES["token_counts_by_language"] = token_counts_by_language
SQL["token_counts_by_language"] = f"""SELECT lang, count(*) AS documents, sum(len({EXPRESSIONS["numbers"]}))::BIGINT AS numbers, sum(len({EXPRESSIONS["ipv4"]}))::BIGINT AS addresses
    FROM (SELECT lang, coalesce(text, '') AS text FROM documents) GROUP BY lang"""


def bag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that a translation lost or gained, with multiplicity."""
    s, t = tokens("numbers", F.col("source_text")), tokens("numbers", F.col("target_text"))
    rows = pairs(spark, d).select("occurrence_id", s.alias("s"), t.alias("t")).select("occurrence_id", bag_minus(F.col("s"), F.col("t")).alias("m"), bag_minus(F.col("t"), F.col("s")).alias("a"))
    return rows.filter("size(m) + size(a) > 0").select("occurrence_id", F.array_join("m", "|").alias("missing"), F.array_join("a", "|").alias("added"))


QUERIES["bag_diff"] = bag_diff
SQL["bag_diff"] = f"""WITH o AS ({PAIRS}), x AS (SELECT occurrence_id, unnest({EXPRESSIONS["numbers"]}) AS t, 1 AS s, 0 AS g FROM (SELECT occurrence_id, source_text AS text FROM o)
    UNION ALL SELECT occurrence_id, unnest({EXPRESSIONS["numbers"]}), 0, 1 FROM (SELECT occurrence_id, target_text AS text FROM o)),
    c AS (SELECT occurrence_id, t, sum(s) - sum(g) AS d FROM x GROUP BY occurrence_id, t HAVING sum(s) <> sum(g)),
    e AS (SELECT occurrence_id, t, d, unnest(range(abs(d)::BIGINT)) AS k FROM c)
    SELECT occurrence_id, coalesce(string_agg(t, '|' ORDER BY t) FILTER (WHERE d > 0), '') AS missing, coalesce(string_agg(t, '|' ORDER BY t) FILTER (WHERE d < 0), '') AS added FROM e GROUP BY occurrence_id"""


def bag_containment(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, endpoints and file names of a source that its translation must hold as often, and does not."""
    names = ["ipv4", "endpoints", "file_names"]
    required = lambda c: F.concat(*[tokens(n, F.col(c)) for n in names])
    rows = pairs(spark, d).select("occurrence_id", bag_minus(required("source_text"), required("target_text")).alias("m"))
    return rows.filter("size(m) > 0").select("occurrence_id", F.array_join("m", "|").alias("missing"))


QUERIES["bag_containment"] = bag_containment
_REQUIRED = " || ".join(EXPRESSIONS[n] for n in ("ipv4", "endpoints", "file_names"))
SQL["bag_containment"] = f"""WITH o AS ({PAIRS}), x AS (SELECT occurrence_id, unnest({_REQUIRED}) AS t, 1 AS s FROM (SELECT occurrence_id, source_text AS text FROM o) UNION ALL SELECT occurrence_id, unnest({_REQUIRED}), -1 FROM (SELECT occurrence_id, target_text AS text FROM o)),
    c AS (SELECT occurrence_id, t, sum(s) AS d FROM x GROUP BY ALL HAVING sum(s) > 0), e AS (SELECT occurrence_id, t, unnest(range(d::BIGINT)) AS k FROM c)
    SELECT occurrence_id, string_agg(t, '|' ORDER BY t) AS missing FROM e GROUP BY occurrence_id"""


def distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each rebuilt unit, each once, in the order in which they first stand."""
    t = tokens("numbers", F.col("text"))
    return table(spark, d, "logical_units").select("logical_unit_id", t.alias("t")).filter("size(t) > size(array_distinct(t))").select("logical_unit_id", F.array_join(F.array_distinct("t"), "|").alias("tokens"))


QUERIES["ordered_dedup"] = distinct_tokens
SQL["ordered_dedup"] = f"""WITH x AS (SELECT logical_unit_id, {EXPRESSIONS["numbers"]} AS t FROM logical_units WHERE text IS NOT NULL), y AS (SELECT logical_unit_id, t, list_filter(t, lambda v, i: list_position(t, v) = i) AS u FROM x)
    SELECT logical_unit_id, array_to_string(u, '|') AS tokens FROM y WHERE len(u) < len(t)"""
