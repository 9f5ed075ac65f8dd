"""All core queries, by name, and their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.patterns import SPACE
from spanloom.functions.scripts import HAN, HANGUL
from spanloom.functions.spans import APPROVED
from spanloom.operators import flow, geometry, layout, ledger, metrics, rules, texts, units
from spanloom.plans import page_queries, rule_queries, token_queries
from spanloom.plans.common import ALL_TEXTS, TEXTS, Query, all_texts, lit
from spanloom.plans.page_queries import BOXES as _BOXES
from spanloom.sources.tables import table, union_records

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SMOKE = "/root/testdata/sf0.001"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: numbers and network addresses per language of the documents."""
    return token_queries.token_counts_by_language(spark, SMOKE)


def queries() -> dict[str, Query]:
    return {**token_queries.QUERIES, **rule_queries.QUERIES, **page_queries.QUERIES, **_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**token_queries.SQL, **rule_queries.SQL, **page_queries.SQL, **_SQL}


# Audit --------------------------------------------------------------------------------------------------------


def script_leak_audit(spark: SparkSession, d: str) -> DataFrame:
    """Han and Hangul characters of Vietnamese targets per page, beyond those that preserved sources permit."""
    o = table(spark, d, "occurrences").filter("lang_out = 'vi'").select("occurrence_id", "manual_id", "page", "status", "source_text", "target_text").dropDuplicates(["occurrence_id"])
    kind = F.array(F.struct(F.lit("hangul").alias("script"), F.lit(HANGUL).alias("p")), F.struct(F.lit("han").alias("script"), F.lit(HAN).alias("p")))
    chars = lambda c, k: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.col(k), F.lit(0))
    rows = o.withColumn("k", F.explode(kind)).select("manual_id", "page", "k.script", "status", "source_text", "target_text", F.col("k.p").alias("p"))
    actual = rows.select("manual_id", "page", "script", F.explode(chars("target_text", "p")).alias("c")).groupBy("manual_id", "page", "script", "c").agg(F.count("*").alias("n"))
    allowed = rows.filter("status IN ('ALLOWED_PRESERVE', 'UNRESOLVED')").select("manual_id", "page", "script", F.explode(chars("source_text", "p")).alias("c")).groupBy("manual_id", "page", "script", "c").agg(F.count("*").alias("m"))
    left = actual.join(allowed, ["manual_id", "page", "script", "c"], "left").withColumn("x", F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0))))
    return left.groupBy("manual_id", "page", "script").agg(F.sum("x").alias("leaks")).filter("leaks > 0")


_KINDS = f"(VALUES ('hangul', {lit(HANGUL)}), ('han', {lit(HAN)})) AS k(script, p)"
_LEAKS = f"""WITH o AS (SELECT DISTINCT occurrence_id, manual_id, page, status, coalesce(source_text, '') AS s, coalesce(target_text, '') AS t FROM occurrences WHERE lang_out = 'vi'),
    chars AS (SELECT o.*, unnest(string_split(t, '')) AS c FROM o), actual AS (SELECT manual_id, page, script, c, count(*) AS n FROM chars, {_KINDS} WHERE c <> '' AND regexp_matches(c, p) GROUP BY ALL),
    src AS (SELECT o.*, unnest(string_split(s, '')) AS c FROM o WHERE status IN ('ALLOWED_PRESERVE', 'UNRESOLVED')), allowed AS (SELECT manual_id, page, script, c, count(*) AS m FROM src, {_KINDS} WHERE c <> '' AND regexp_matches(c, p) GROUP BY ALL)
    SELECT manual_id, page, script, sum(greatest(0, n - coalesce(m, 0)))::BIGINT AS leaks FROM actual LEFT JOIN allowed USING (manual_id, page, script, c) GROUP BY ALL HAVING sum(greatest(0, n - coalesce(m, 0))) > 0"""
_add("script_leak_audit", script_leak_audit, _LEAKS)
_RECORDED = f"""SELECT *, CASE WHEN demoted THEN 'UNRESOLVED' ELSE status END AS s FROM (SELECT DISTINCT ON (occurrence_id) *, coalesce(status = 'ALLOWED_PRESERVE' AND NOT (coalesce(preserve_reason_is_approved, false) AND coalesce(preserve_reason IN ({', '.join(lit(r) for r in APPROVED)}), false)), false) AS demoted FROM occurrences)"""

# Ledger -------------------------------------------------------------------------------------------------------

_add(
    "ledger_reconcile",
    lambda s, d: ledger.reconcile(table(s, d, "fragments"), table(s, d, "occurrences")),
    """WITH e AS (SELECT DISTINCT manual_id, 'span-' || substr(fragment_id, 6) AS span_id, 1 AS e FROM fragments), o AS (SELECT DISTINCT occurrence_id, manual_id, source_span_ids FROM occurrences),
    x AS (SELECT manual_id, unnest(source_span_ids) AS span_id FROM o), a AS (SELECT manual_id, span_id, count(*) AS times FROM x GROUP BY ALL)
    SELECT manual_id, count(e) AS eligible, count(times) AS assigned, count(*) FILTER (WHERE times IS NULL) AS unassigned, count(*) FILTER (WHERE e IS NULL) AS unknown, coalesce(sum(greatest(0, times - 1)), 0)::BIGINT AS duplicates FROM e FULL JOIN a USING (manual_id, span_id) GROUP BY manual_id""",
)
_add(
    "delivery_status",
    lambda s, d: ledger.delivery(table(s, d, "occurrences"), table(s, d, "fragments"), script_leak_audit(s, d)),
    f"""WITH r AS ({_SQL["ledger_reconcile"]}), k AS ({_LEAKS}), o AS ({_RECORDED}), p AS (SELECT manual_id, count(*) AS n, count(*) FILTER (WHERE s = 'TRANSLATED') AS translated, count(*) FILTER (WHERE s = 'ALLOWED_PRESERVE') AS preserved, count(*) FILTER (WHERE s = 'UNRESOLVED') AS unresolved,
    count(*) FILTER (WHERE s IS NULL OR s NOT IN ('TRANSLATED', 'ALLOWED_PRESERVE', 'UNRESOLVED')) AS unknown, count(*) FILTER (WHERE demoted OR len(coalesce(validation_failures, [])) > 0) AS failed FROM o GROUP BY manual_id), l AS (SELECT manual_id, sum(leaks) AS leaked FROM k GROUP BY 1)
    SELECT p.*, round((translated + preserved + unresolved) / n, 4) AS coverage, round((translated + preserved) / n, 4) AS completion, CASE WHEN coalesce(r.unassigned > 0 OR r.duplicates > 0 OR r.unknown > 0, false) OR p.unknown > 0 OR coalesce(leaked, 0) > 0 OR (failed > 0 AND unresolved = 0) THEN 'FAIL'
    WHEN unresolved > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS delivery FROM p LEFT JOIN r USING (manual_id) LEFT JOIN l USING (manual_id)""",
)


def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences that the ledger takes otherwise than they stand: kept without an approved reason."""
    r = ledger.recorded(table(spark, d, "occurrences")).filter("demoted")
    return r.select("occurrence_id", "status", "unresolved_reason", F.array_join("validation_failures", ",").alias("failures"), F.col("target_text").eqNullSafe(F.col("source_text")).alias("reset"))


_add("ledger_records", ledger_records, f"SELECT occurrence_id, 'UNRESOLVED' AS status, 'unapproved_preserve' AS unresolved_reason, array_to_string(CASE WHEN list_contains(coalesce(validation_failures, []), 'unapproved_preserve') THEN validation_failures ELSE coalesce(validation_failures, []) || ['unapproved_preserve'] END, ',') AS failures, true AS reset FROM ({_RECORDED}) WHERE demoted")
_add("queue_summary", lambda s, d: table(s, d, "occurrences").dropDuplicates(["occurrence_id"]).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("occurrences")), "SELECT coalesce(status, 'unknown') AS status, count(DISTINCT occurrence_id) AS occurrences FROM occurrences GROUP BY 1")
_add("failure_counts", lambda s, d: ledger.failure_counts(table(s, d, "occurrences")), "SELECT failure, count(DISTINCT occurrence_id) AS occurrences FROM (SELECT occurrence_id, unnest(validation_failures) AS failure FROM occurrences) GROUP BY failure")

# Units --------------------------------------------------------------------------------------------------------

_CUR = ", ".join(f"{v} AS c_{k}" for k, v in units._FIELDS.items()) + ", " + ", ".join(f"bbox.{x} AS c_{x}" for x in ("x0", "y0", "x1", "y1"))
_LAGS = ", ".join(f"lag(c_{n}) OVER w AS p_{n}" for n in [*units._FIELDS, "x0", "y0", "x1", "y1", "chars", "ends"])
_SPACES = f"[{SPACE}]"
_DECISIONS = f"""WITH f AS (SELECT DISTINCT ON (fragment_id) manual_id, reading_order AS ord, coalesce(text, '') AS text, {_CUR} FROM fragments),
 c AS (SELECT *, length(trim(regexp_replace(text, {lit(units.TAGS)}, '', 'g'))) AS c_chars, regexp_matches(trim(text), {lit(units.ENDS)}) AS c_ends, regexp_matches(text, {lit(units.STARTS)}) AS c_starts FROM f),
 p AS (SELECT *, false AS barred, {_LAGS} FROM c WINDOW w AS (PARTITION BY manual_id, c_page ORDER BY ord, c_y0, c_x0, c_id)),
 j AS (SELECT *, {units.DECISION} AS decision FROM p),
 u AS (SELECT manual_id, c_page AS page, c_id AS fragment_id, ord, CASE WHEN c_style IN (1, 2, 3) THEN '<s' || c_style || '>' || text || '</s' || c_style || '>' ELSE text END AS text, c_x0, c_y0, c_x1, c_y1, decision, CASE WHEN decision IN ('same_line_continuation', 'inline_emphasis') THEN CASE WHEN c_x0 - p_x1 > 0.15 * greatest(1.0, p_y1 - p_y0) THEN 'S' ELSE 'N' END ELSE 'W' END AS joint,
 sum(CASE WHEN decision = 'first' OR decision LIKE 'rejected%' THEN 1 ELSE 0 END) OVER (PARTITION BY manual_id, c_page ORDER BY ord, c_y0, c_x0, c_id ROWS UNBOUNDED PRECEDING) AS unit FROM j)"""
_HEAD, _TAIL = f"regexp_replace(substr(x, 2), '^{_SPACES}+', '')", f"regexp_replace(s, '{_SPACES}+$', '')"
_add(
    "logical_units",
    lambda s, d: units.logical_units(table(s, d, "fragments")),
    _DECISIONS
    + f""", g AS (SELECT manual_id, page, unit, list(joint || text ORDER BY ord, fragment_id) AS t, min_by(fragment_id, (ord, fragment_id)) AS a, max_by(fragment_id, (ord, fragment_id)) AS z, count(*)::INT AS fragments,
 coalesce(string_agg(decision, ',' ORDER BY ord, fragment_id) FILTER (WHERE decision <> 'first' AND decision NOT LIKE 'rejected%'), '') AS reasons, min(c_x0) AS x0, min(c_y0) AS y0, max(c_x1) AS x1, max(c_y1) AS y1 FROM u GROUP BY ALL)
 SELECT manual_id, page, 'p' || (page + 1) || ':' || a || '..' || z AS unit_id, fragments, reasons, x0, y0, x1, y1, list_reduce(list_prepend('', t), lambda s, x: CASE WHEN s = '' THEN substr(x, 2) WHEN length(x) = 1 THEN s
 WHEN x LIKE 'W%' THEN CASE WHEN s LIKE '%-' THEN s || {_HEAD} ELSE {_TAIL} || ' ' || {_HEAD} END
 WHEN x LIKE 'N%' OR regexp_matches(s, '{_SPACES}$') OR regexp_matches(substr(x, 2), '^{_SPACES}') THEN s || substr(x, 2) ELSE s || ' ' || substr(x, 2) END) AS text FROM g""",
)
_add("reconstruction_metrics", lambda s, d: units.reconstruction_metrics(table(s, d, "fragments")), _DECISIONS + " SELECT decision, count(*) AS fragments FROM u GROUP BY decision")
_add(
    "conservation",
    lambda s, d: units.conservation(table(s, d, "fragments"), table(s, d, "logical_units")),
    """WITH h AS (SELECT DISTINCT manual_id, fragment_id, 1 AS c FROM fragments), x AS (SELECT manual_id, unnest(source_fragment_ids) AS fragment_id FROM logical_units), u AS (SELECT manual_id, fragment_id, count(*) AS times FROM x GROUP BY ALL)
    SELECT manual_id, count(c) AS candidates, count(times) AS assigned, count(*) FILTER (WHERE times IS NULL) AS unassigned, coalesce(sum(times - 1), 0)::BIGINT AS duplicates, count(*) FILTER (WHERE c IS NULL) AS unknown FROM h FULL JOIN u USING (manual_id, fragment_id) GROUP BY manual_id""",
)
_add(
    "unit_length_stats",
    lambda s, d: metrics.unit_length_stats(table(s, d, "logical_units")),
    "SELECT manual_id, count(*) AS units, round(avg(length(text)), 4) AS mean_chars, round(median(length(text)), 4) AS median_chars, max(length(text))::INT AS max_chars FROM logical_units WHERE text IS NOT NULL GROUP BY manual_id",
)
_add(
    "reconstruction_health",
    lambda s, d: metrics.health(table(s, d, "logical_units")),
    """WITH p AS (SELECT manual_id, sum(len(source_fragment_ids))::BIGINT AS fragments, count(*) AS units, count(*) FILTER (WHERE len(source_fragment_ids) = 1) AS singles FROM logical_units GROUP BY manual_id), q AS (SELECT *, greatest(0, fragments - 1) AS cand, fragments - units AS acc FROM p),
    r AS (SELECT *, coalesce(round(cand / nullif(fragments, 0), 4), 0) AS candidate_rate, coalesce(round(acc / nullif(cand, 0), 4), 0) AS acceptance_rate, coalesce(round(singles / nullif(units, 0), 4), 0) AS singleton_rate FROM q)
    SELECT manual_id, fragments, units, candidate_rate, acceptance_rate, singleton_rate, CASE WHEN (cand >= 100 OR cand >= 0.2 * fragments) AND (acceptance_rate < 0.25 OR singleton_rate > 0.75) THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'PASS' END AS health FROM r""",
)
_add(
    "batch_percentiles",
    lambda s, d: metrics.batch_percentiles(table(s, d, "segments")),
    """WITH o AS (SELECT DISTINCT segment_id, lang_out, length(src) AS n FROM segments WHERE src IS NOT NULL) SELECT lang_out, count(*) AS segments, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.99), 4) AS p99, max(n)::INT AS longest, round(sum(n) / (count(*) * 12000), 6) AS used FROM o GROUP BY lang_out""",
)

_STAGES = [("a", None, 10.0), ("b", "a", 4.0), ("c", "a", 3.5), ("d", "b", 1.25), ("e", None, 2.0)]
_add(
    "exclusive_time",
    lambda s, d: metrics.exclusive_time(s.createDataFrame(_STAGES, "id string, parent string, seconds double")),
    "WITH s(id, parent, seconds) AS (VALUES " + ", ".join(f"('{a}', {lit(b) if b else 'NULL'}, {c}::DOUBLE)" for a, b, c in _STAGES) + ") SELECT s.id, round(s.seconds - coalesce((SELECT sum(c.seconds) FROM s c WHERE c.parent = s.id), 0), 4) AS exclusive FROM s",
)

# Flow ---------------------------------------------------------------------------------------------------------

_add(
    "segment_dedup",
    lambda s, d: flow.segment_dedup(table(s, d, "segments")),
    "SELECT segment_id, count(*) AS copies, count(DISTINCT coalesce(src, chr(1))) > 1 AS conflict, length(min(src))::INT AS chars FROM segments GROUP BY segment_id",
)
_add(
    "cache_latest",
    lambda s, d: flow.latest_cache(table(s, d, "translation_cache")),
    """SELECT id, translate_engine, versions, length(translation)::INT AS chars FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY translate_engine, translate_engine_params, original_text) AS versions FROM translation_cache
    WINDOW w AS (PARTITION BY translate_engine, translate_engine_params, original_text ORDER BY written_at DESC, id DESC)) WHERE r = 1""",
)
_add(
    "lookup_precedence",
    lambda s, d: flow.lookup_precedence(table(s, d, "segments"), table(s, d, "occurrences"), table(s, d, "translation_cache")),
    """WITH g AS (SELECT DISTINCT ON (segment_id) segment_id, src, occurrence_id, lang_out FROM segments), o AS (SELECT DISTINCT ON (occurrence_id) occurrence_id, source_text FROM occurrences WHERE status = 'TRANSLATED' AND target_text IS NOT NULL),
    c AS (SELECT DISTINCT original_text AS src, translate_engine_params ->> '$.lang_out' AS lang_out FROM translation_cache WHERE translation IS NOT NULL)
    SELECT segment_id, CASE WHEN o.occurrence_id IS NOT NULL AND o.source_text IS NOT DISTINCT FROM g.src THEN 'occurrence' WHEN c.src IS NOT NULL THEN 'cache' ELSE 'miss' END AS found_in FROM g LEFT JOIN o USING (occurrence_id) LEFT JOIN c ON c.src = g.src AND c.lang_out = g.lang_out""",
)
_SAFE = rule_queries._safe(rule_queries._SEGMENT.replace("(text", "(src"))
_JOBS = f"""j AS (SELECT segment_id, src, lang_out, CASE WHEN {_SAFE} THEN sha256(concat_ws(chr(1), src, lang_out)) ELSE segment_id END AS job FROM (SELECT DISTINCT ON (segment_id) segment_id, src, lang_out FROM segments WHERE src IS NOT NULL))"""
_add("job_fanout", lambda s, d: flow.job_fanout(table(s, d, "segments")), f"WITH {_JOBS} SELECT job, count(*) AS served, min(segment_id) AS first_segment FROM j GROUP BY job")
_add(
    "job_identity",
    lambda s, d: flow.job_keys(table(s, d, "segments")).select("segment_id", "identity"),
    f"WITH {_JOBS} SELECT segment_id, substr(CASE WHEN job = segment_id THEN sha256(src || chr(0) || 'index=' || segment_id) ELSE sha256(src) END, 1, 16) AS identity FROM j",
)
_add(
    "job_outcomes",
    lambda s, d: flow.job_outcomes(table(s, d, "segments"), table(s, d, "translation_cache")),
    f"""WITH {_JOBS}, f AS (SELECT job, arg_min(src, segment_id) AS src, arg_min(lang_out, segment_id) AS lang_out FROM j GROUP BY job), k AS (SELECT original_text AS src, translate_engine_params ->> '$.lang_out' AS lang_out, arg_max(translation, (written_at, id)) AS t FROM translation_cache WHERE translation IS NOT NULL GROUP BY ALL)
    SELECT j.segment_id, j.job, length(k.t)::INT AS chars FROM j JOIN f USING (job) LEFT JOIN k ON k.src = f.src AND k.lang_out = f.lang_out""",
)
_add("segment_accounts", lambda s, d: flow.accounts(flow.job_outcomes(table(s, d, "segments"), table(s, d, "translation_cache"))), f"SELECT count(*) AS segments, count(chars) AS translated, count(*) - count(chars) AS missing, true AS complete FROM ({_SQL['job_outcomes']})")
_add("cascade", lambda s, d: flow.cascade(table(s, d, "segments"), table(s, d, "translation_cache")))
_add("loaded_segments", lambda s, d: flow.loaded_segments(table(s, d, "segments").filter("src IS NOT NULL AND src <> ''").dropDuplicates(["segment_id"])).select("segment_id", F.length("src").alias("chars")), "SELECT DISTINCT segment_id, length(src)::INT AS chars FROM segments WHERE src <> ''")
_add("negative_cache", lambda s, d: flow.negative_cache(table(s, d, "segments")))


def handoff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Usable rows of the hand-off's cache, whose keys hold an id and a text as JSON: with a target, and the same tags on both sides."""
    c = table(spark, d, "translation_cache").filter("translate_engine = 'handoff' AND original_text LIKE '[%'")
    parts = F.from_json("original_text", "array<string>")
    return flow.segment_table(c.select(parts[0].alias("segment_id"), parts[1].alias("src"), F.col("translation").alias("dst"))).select("segment_id", F.length("dst").alias("chars")).distinct()


_add("segment_table", handoff_rows)


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """The event log as attempts: errors fail with a reason, purchases succeed, others are neutral."""
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("other")
    kinds = F.array(*map(F.lit, ["TechnicalInvariantError", "Timeout", "SegmentTooLongError"]))
    return table(spark, d, "events").select(F.col("user_id").alias("identity"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("reason"), kinds[(F.col("event_id") % 3).cast("int")].alias("error"))


_EVENTS = "e AS (SELECT user_id AS identity, event_id AS seq, event_type, coalesce(props ->> '$.k', '') AS reason FROM events), b AS (SELECT *, lag(event_type) OVER w AS before, lag(reason) OVER w AS was FROM e WHERE event_type = 'purchase' OR (event_type = 'error' AND trim(reason) <> '') WINDOW w AS (PARTITION BY identity ORDER BY seq)), t AS (SELECT identity, min(seq) AS trusted_at, arg_min(was, seq) AS reason FROM b WHERE event_type = 'error' AND before = 'error' GROUP BY identity)"
_add("two_strike", lambda s, d: flow.two_strike(_attempts(s, d)), f"WITH {_EVENTS} SELECT * FROM t")
_add("skip_on_trusted", lambda s, d: flow.skipped(_attempts(s, d)).groupBy("identity", "reason").agg(F.count("*").alias("skipped")), f"WITH {_EVENTS} SELECT t.identity, t.reason, count(*) AS skipped FROM t JOIN e ON e.identity = t.identity AND e.seq > trusted_at GROUP BY ALL")
_RETRY = """r AS (SELECT user_id AS identity, event_id AS seq, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round FROM events),
    a AS (SELECT identity, seq, row_number() OVER (PARTITION BY identity, round ORDER BY seq)::INT AS attempt, CASE seq % 3 WHEN 2 THEN 1 ELSE 8 END AS budget FROM r WHERE event_type = 'error')"""
_add("retry_state", lambda s, d: flow.retry_state(_attempts(s, d)), f"WITH {_RETRY} SELECT identity, seq, attempt, budget, least(60.0, power(2.0, least(attempt - 1, 6)))::DOUBLE AS wait, attempt >= budget AS stop FROM a")
_add("retry_sleeps", lambda s, d: metrics.retry_sleeps(flow.retry_state(_attempts(s, d)).filter("NOT stop")), f"WITH {_RETRY}, w AS (SELECT identity, least(60.0, power(2.0, least(attempt - 1, 6)))::DOUBLE AS w FROM a WHERE attempt < budget) SELECT identity, count(*) AS sleeps, round(sum(w), 4) AS total, round(avg(w), 4) AS mean, max(w) AS longest FROM w GROUP BY identity")
_add(
    "adjacent_context",
    lambda s, d: flow.adjacent_context(table(s, d, "segments")),
    """WITH g AS (SELECT DISTINCT ON (segment_id) segment_id, manual_id, src, lang_out, queued_at FROM segments), n AS (SELECT segment_id, src, lang_out, lag(src) OVER w AS p, lag(segment_id) OVER w AS pid, lag(lang_out) OVER w AS pl, lead(src) OVER w AS n, lead(segment_id) OVER w AS nid, lead(lang_out) OVER w AS nl FROM g WINDOW w AS (PARTITION BY manual_id ORDER BY queued_at, segment_id))
    SELECT segment_id, CASE WHEN length(p) <= 300 AND p <> src AND pl IS NOT DISTINCT FROM lang_out THEN pid WHEN length(n) <= 300 AND n <> src AND nl IS NOT DISTINCT FROM lang_out THEN nid END AS context_id FROM n""",
)


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Waits between attempts: doubling from one second, at most a minute."""
    return spark.range(1, 8).select(F.col("id").alias("attempt"), F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("id") - 1)).alias("wait"))


_add("backoff_schedule", backoff_schedule, "SELECT i AS attempt, least(60.0, power(2.0, i - 1))::DOUBLE AS wait FROM range(1, 8) AS r(i)")

# Layout and ordering ------------------------------------------------------------------------------------------

_add(
    "geometry_kind",
    lambda s, d: layout.geometry_kinds(table(s, d, "fragments")),
    f"""WITH {_BOXES}, p AS (SELECT x0 AS c_x0, y0 AS c_y0, x1 AS c_x1, y1 AS c_y1, lag(x0) OVER w AS p_x0, lag(y0) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1 FROM b WINDOW w AS (PARTITION BY manual_id, page ORDER BY reading_order, y0, x0, fragment_id))
    SELECT coalesce({units.KIND}, 'none') AS kind, count(*) AS pairs FROM p WHERE p_x0 IS NOT NULL GROUP BY 1""",
)
_add(
    "smallest_parent",
    lambda s, d: layout.smallest_parent(table(s, d, "fragments")),
    """WITH b AS (SELECT DISTINCT ON (fragment_id) fragment_id, manual_id, page, region_id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM fragments),
    r AS (SELECT manual_id, page, region_id, min(x0) AS rx0, min(y0) AS ry0, max(x1) AS rx1, max(y1) AS ry1 FROM b WHERE region_id IS NOT NULL GROUP BY ALL),
    c AS (SELECT fragment_id, r.region_id AS parent, (rx1 - rx0) * (ry1 - ry0) AS a FROM b JOIN r USING (manual_id, page) WHERE x0 >= rx0 AND x1 <= rx1 AND y0 >= ry0 AND y1 <= ry1)
    SELECT fragment_id, parent, round(a, 2) AS area FROM (SELECT *, row_number() OVER (PARTITION BY fragment_id ORDER BY a, parent) AS k FROM c) WHERE k = 1""",
)


def excess_rows(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of a text on a page beyond as many as its fragments are."""
    o = table(spark, d, "occurrences").select("occurrence_id", "manual_id", "page", F.col("source_text").alias("text"), "recorded_at")
    f = table(spark, d, "fragments").dropDuplicates(["fragment_id"]).select("manual_id", "page", "text")
    return layout.excess_rows(o, f, "occurrence_id", "recorded_at")


_add(
    "excess_rows",
    excess_rows,
    """WITH o AS (SELECT DISTINCT ON (occurrence_id) occurrence_id, manual_id, page, source_text AS text, recorded_at FROM occurrences WHERE source_text IS NOT NULL), a AS (SELECT manual_id, page, text, count(*) AS n FROM (SELECT DISTINCT ON (fragment_id) * FROM fragments) WHERE text IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY manual_id, page, text ORDER BY recorded_at, occurrence_id) AS k FROM o) SELECT occurrence_id, k - n AS excess FROM k JOIN a USING (manual_id, page, text) WHERE k > n""",
)
_add(
    "greedy_batches",
    lambda s, d: layout.greedy_batches(table(s, d, "segments")),
    """WITH RECURSIVE q AS (SELECT DISTINCT ON (segment_id) segment_id, manual_id, queued_at, src, coalesce(length(src), 0) AS n, coalesce(length(context.text), 0) AS c FROM segments), o AS (SELECT segment_id, manual_id, queued_at, n + CASE WHEN n + c <= 12000 AND regexp_matches(src, '[가-힣]') THEN c ELSE 0 END AS n FROM q),
    x AS (SELECT *, row_number() OVER (PARTITION BY manual_id ORDER BY queued_at, segment_id) AS i FROM o WHERE n <= 12000),
    f AS (SELECT segment_id, manual_id, i, n, 0::BIGINT AS batch, 1 AS items, n AS chars FROM x WHERE i = 1 UNION ALL
    SELECT x.segment_id, x.manual_id, x.i, x.n, CASE WHEN f.items >= 30 OR f.chars + x.n > 12000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.items >= 30 OR f.chars + x.n > 12000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= 30 OR f.chars + x.n > 12000 THEN x.n ELSE f.chars + x.n END FROM f JOIN x ON x.manual_id = f.manual_id AND x.i = f.i + 1)
    SELECT segment_id, batch FROM f UNION ALL SELECT segment_id, -1 FROM o WHERE n > 12000""",
)

_add(
    "batch_stats",
    lambda s, d: flow.batch_stats(table(s, d, "segments"), layout.greedy_batches(table(s, d, "segments"))),
    f"""WITH g AS ({_SQL["greedy_batches"]}), n AS (SELECT DISTINCT ON (segment_id) segment_id, manual_id, coalesce(length(src), 0) AS n FROM segments), p AS (SELECT manual_id, batch, count(*) AS units, sum(n) AS chars FROM g JOIN n USING (segment_id) WHERE batch >= 0 GROUP BY ALL)
    SELECT count(*) AS batches, round(avg(units), 4) AS units_mean, round(quantile_cont(units, 0.5), 4) AS units_median, round(avg(chars), 4) AS chars_mean, round(quantile_cont(chars, 0.5), 4) AS chars_median, round(quantile_cont(chars, 0.9), 4) AS chars_p90, max(chars)::BIGINT AS chars_longest, round(sum(chars) / (count(*) * 12000), 6) AS used FROM p""",
)
_add(
    "provider_counters",
    lambda s, d: table(s, d, "translation_cache").groupBy("translate_engine").agg(F.count("*").alias("units"), F.sum(F.length("original_text")).alias("chars"), F.count_if(F.col("translation").isNull() | ~F.col("translation").rlike(f"[^{SPACE}]")).alias("unanswered")),
    "SELECT translate_engine, count(*) AS units, sum(length(original_text))::BIGINT AS chars, count(*) FILTER (WHERE translation IS NULL OR NOT regexp_matches(translation, " + lit(f"[^{SPACE}]") + ")) AS unanswered FROM translation_cache GROUP BY 1",
)


def geometry_match(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose fragments and units cover the same box within a hundredth."""
    a = geometry.bbox_union(table(spark, d, "fragments")).drop("fragments")
    u = table(spark, d, "logical_units").groupBy("manual_id", "page").agg(*[f(f"bbox.{c}").alias(f"u{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    same = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        same = same & (F.abs(F.col(c) - F.col(f"u{c}")) <= 0.01)
    return a.join(u, ["manual_id", "page"], "full_outer").select("manual_id", "page", F.coalesce(same, F.lit(False)).alias("same"))


_add(
    "geometry_match",
    geometry_match,
    f"""WITH {_BOXES}, a AS (SELECT manual_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY ALL), u AS (SELECT manual_id, page, min(bbox.x0) AS ux0, min(bbox.y0) AS uy0, max(bbox.x1) AS ux1, max(bbox.y1) AS uy1 FROM logical_units GROUP BY ALL)
    SELECT manual_id, page, coalesce(abs(x0 - ux0) <= 0.01 AND abs(y0 - uy0) <= 0.01 AND abs(x1 - ux1) <= 0.01 AND abs(y1 - uy1) <= 0.01, false) AS same FROM a FULL JOIN u USING (manual_id, page)""",
)

def span_ids(spark: SparkSession, d: str) -> DataFrame:
    """Bit-exact identity of a source span: hash of page, index and text, separated by NUL."""
    f = table(spark, d, "fragments").filter("text IS NOT NULL").select("fragment_id", "page", "reading_order", "text").dropDuplicates(["fragment_id"])
    key = F.concat(F.lit("page="), "page", F.lit("\x00index="), "reading_order", F.lit("\x00"), "text")
    return f.select("fragment_id", F.concat(F.lit("span-"), F.substring(F.sha2(key, 256), 1, 20)).alias("span_id"))


_add("span_ids", span_ids, "SELECT DISTINCT fragment_id, 'span-' || substr(sha256('page=' || page || chr(0) || 'index=' || reading_order || chr(0) || text), 1, 20) AS span_id FROM fragments WHERE text IS NOT NULL")


def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """Whether versions in the documents' file names, and some others, are newer than given ones; missing parts are zero."""
    text = F.col("text")
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(text, F.lit(r"[.](v[0-9]+(?:[.][0-9]+)*)[.]ini"), F.lit(1))).alias("candidate")).distinct()
    given = spark.createDataFrame([(v,) for v in _VERSIONS], "candidate string")
    current = spark.createDataFrame([(v,) for v in _VERSIONS], "current string")
    rows = found.unionByName(given).distinct().crossJoin(F.broadcast(current))  # a few literals
    return rows.select("candidate", "current", (rules.version_parts(F.col("candidate")) > rules.version_parts(F.col("current"))).alias("newer"))


_VERSIONS = ["0.10.0", "0.9.0", "0.2", "0.2.0", "0.2.1", "v0.2.0-rc1", "2", "1.0.0.0.1", "1"]
_PARTS = lambda c: f"list_transform(string_split(regexp_replace(regexp_extract({c}, '^[vV]?([0-9]+([.][0-9]+)*)', 1), '([.]0+)+$', ''), '.'), lambda x: x::BIGINT)"
_add("version_compare", version_compare, f"""WITH c AS (SELECT unnest(regexp_extract_all(text, '[.](v[0-9]+(?:[.][0-9]+)*)[.]ini', 1)) AS candidate FROM documents UNION SELECT * FROM (VALUES {', '.join(f"({lit(v)})" for v in _VERSIONS)})), r AS (SELECT * FROM (VALUES {', '.join(f"({lit(v)})" for v in _VERSIONS)}) AS v(current))
    SELECT candidate, current, {_PARTS('candidate')} > {_PARTS('current')} AS newer FROM c, r""")


def canonical_params(spark: SparkSession, d: str) -> DataFrame:
    """Engine parameters as JSON with sorted keys and no spaces, which is how a cache keys them, and how often each occurs."""
    entries = F.array_sort(F.map_entries(F.from_json("translate_engine_params", "map<string,string>")))
    dumped = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"'))), ","), F.lit("}"))
    return table(spark, d, "translation_cache").groupBy(dumped.alias("params")).agg(F.count("*").alias("entries")).withColumn("fingerprint", F.sha2("params", 256))


_add("canonical_params", canonical_params, """WITH k AS (SELECT id, translate_engine_params AS p, unnest(list_sort(json_keys(translate_engine_params))) AS k FROM translation_cache), d AS (SELECT id, '{' || string_agg('"' || k || '":"' || (p ->> ('$.' || k)) || '"', ',' ORDER BY k) || '}' AS params FROM k GROUP BY id)
    SELECT params, count(*) AS entries, sha256(params) AS fingerprint FROM d GROUP BY params""")

# Whole tables of texts -----------------------------------------------------------------------------------------

_add(
    "tag_nesting",
    lambda s, d: texts.tag_nesting(all_texts(s, d)),
    f"""WITH x AS (SELECT tbl, field, record_id, regexp_extract_all(text, {lit(texts.TAG)}) AS t FROM ({ALL_TEXTS}) WHERE regexp_matches(text, {lit(texts.TAG)})),
    n AS (SELECT *, list_transform(t, lambda x: CASE WHEN x LIKE '%/>' THEN '' WHEN x LIKE '</%' THEN '/' ELSE '+' END || CASE WHEN x LIKE '%/>' THEN '' ELSE lower(regexp_extract(x, {lit(texts.TAG_NAME)}, 1)) END) AS steps FROM x)
    SELECT DISTINCT tbl, field, record_id, len(t)::INT AS tags, list_reduce(list_prepend('', steps), lambda s, x: CASE WHEN x = '' THEN s WHEN x LIKE '+%' THEN s || '<' || substr(x, 2) WHEN ends_with(s, '<' || substr(x, 2)) THEN left(s, length(s) - length(x)) ELSE s || '<!' END) = '' AS balanced FROM n""",
)
_add(
    "formula_markers",
    lambda s, d: texts.formula_markers(all_texts(s, d)),
    rf"""WITH x AS (SELECT tbl, field, record_id, text, regexp_extract_all(text, {lit(texts.MARKER)}) AS m FROM ({ALL_TEXTS}) WHERE regexp_matches(text, {lit(texts.MARKER)}) OR regexp_matches(text, {lit(texts.MASKED)})),
    k AS (SELECT *, list_transform(m, lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^0+([0-9])', '')) AS k FROM x)
    SELECT DISTINCT tbl, field, record_id, array_to_string(list_transform(k, lambda x: '<b' || x || '></b' || x || '>'), '') AS masked, m = list_transform(k, lambda x: '{{v' || x || '}}') AND NOT regexp_matches(text, {lit(texts.MASKED)}) AS same FROM k""",
)


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the tokens of all categories in every source text, leftmost-longest; no SQL, tested against brute force."""
    return texts.token_spans(union_records([(table(spark, d, t), t, k, c[0]) for t, k, c in TEXTS[:4]]))


_add("token_spans", token_spans)

_LINE_FLAGS = ", ".join(f"regexp_matches(l, {lit(p)})" + (f" AND k <= {most}" if most else "") + f" AS {n}" for n, (p, most) in texts.FLAGS.items())
_add(
    "page_kinds",
    lambda s, d: texts.page_kinds(table(s, d, "fragments")),
    f"""WITH b AS (SELECT DISTINCT ON (fragment_id) fragment_id, manual_id, page, reading_order, bbox.y0 AS y0, bbox.x0 AS x0, regexp_split_to_array(coalesce(text, ''), {lit(texts.LINE_END)}) AS t FROM fragments),
    r AS (SELECT *, unnest(t) AS raw, generate_subscripts(t, 1) AS i FROM b), c AS (SELECT *, nullif(regexp_replace(raw, {lit(texts.EDGES)}, '', 'g'), '') AS l FROM r),
    p AS (SELECT manual_id, page, l, row_number() OVER w AS k, lead(l) OVER w AS after FROM c WINDOW w AS (PARTITION BY manual_id, page, l IS NULL ORDER BY reading_order, y0, x0, fragment_id, i)),
    f AS (SELECT *, {_LINE_FLAGS} FROM p), g AS (SELECT manual_id, page, count(l) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in texts.COUNTS.items())} FROM f GROUP BY manual_id, page)
    SELECT manual_id, page, n AS lines, {texts.KIND} AS kind FROM g""",
)
