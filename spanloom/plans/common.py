"""What the catalogs of queries share: the text columns of the tables, and quoting for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

TEXTS = [("documents", "doc_id", ("text",)), ("logical_units", "logical_unit_id", ("text",)), ("segments", "segment_id", ("src",)), ("fragments", "fragment_id", ("text",)), ("occurrences", "occurrence_id", ("source_text", "target_text")), ("translation_cache", "id", ("original_text", "translation"))]
ALL_TEXTS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS field, {k}::VARCHAR AS record_id, {c} AS text FROM {t}" for t, k, columns in TEXTS for c in columns)
NAMES = ("Quenthar Ltd. Asia",)  # names that the tables' texts keep in every language
GLOSSARY = {"relay": "rơ le", "fuse": "cầu chì", "contract": "hợp đồng", "patient": "bệnh nhân", "backup": "bản sao lưu", "tractor": "máy kéo", "referee": "trọng tài", "invoice": "hóa đơn"}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, field, record_id, text) of every text column; a table with two is read once."""
    out = None
    for name, key, columns in TEXTS:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("f")
        one = table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("record_id"), each).select("tbl", "f.field", "record_id", "f.text")
        out = one if out is None else out.unionAll(one)
    return out


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Translated occurrences with both texts, each once."""
    o = table(spark, d, "occurrences").filter("status = 'TRANSLATED' AND source_text IS NOT NULL AND target_text IS NOT NULL")
    return o.select("occurrence_id", "source_text", "target_text", "lang_in", "lang_out").dropDuplicates(["occurrence_id"])


PAIRS = "SELECT DISTINCT occurrence_id, source_text, target_text, lang_in, lang_out FROM occurrences WHERE status = 'TRANSLATED' AND source_text IS NOT NULL AND target_text IS NOT NULL"

#: Texts that hold every category of tokens, next to what only looks like one.
CASE_TEXTS = [
    "Set {{x}} and {v0} to %s, ${y} or $z; not {1x}.", "Keep <b0></b0> and <x/> <s1>NOT</s1>", "See https://example.org/a?b=1. Then go (http://example.org/x).",
    "Open C:\\temp\\cfg.ini, \\\\host\\share and C:\\J1C\\ 오늘날짜-시’분’초’.txt now", "In /etc/app/cfg.ini or ./run/all, not x//y", "Files cfg17.v2.ini. Log.TXT, a.b.exe!",
    "Page No. 3 and Page No, not Pages No", "at 192.0.2.27 and 10.0.0.1, not 1.2.3.4.5 or 300.1.1.1", "TCP/502 and UDP/69, not XTCP/1", "D100, AL.52, 0x2005, KM-757, R[1], OK#3, PCW and CN7 D100D200",
    "ISO 10218-1, IEC 60204:2016 and EN ISO 1", "Rev.B v1.2.3 v2.0, not xv1.2", "SPEC No. A-1, P/N: 77-B, LOT 5", "0.5, 1,234.50, -3 and +4.25 but D100 1.2.3", "10–20, 3 - 4, 5±0.1; 1~2", "10~20 값",
    "2350mm, 0.5 MPa, 12 N.m, 3 μs, 40% and 5 mm/s 6mm 7mm", "24V, 3 A, 5 N and 2 m long", "Servo ON then OFF ON OFF, not ONE", "MOV D100 D200\nRun BMOV D1 D2 now\n3: IF ready THEN MOVJ P001\nNWAIT\nMOV along", "Append `;` and `[x]` here; MOV\nSET M1\n", "",
]
CASES = [("case", "text", str(n), t) for n, t in enumerate(CASE_TEXTS)]
CASES_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in CASES) + ") AS v(tbl, field, record_id, text)"
