"""Exact-once ledger: which source spans are assigned to which outcome, and what that means for delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import APPROVED

STATUSES = ["TRANSLATED", "ALLOWED_PRESERVE", "UNRESOLVED"]


def assignments(occurrences: DataFrame) -> DataFrame:
    """(manual_id, span_id, occurrence_id), one row per assigned span."""
    once = occurrences.dropDuplicates(["occurrence_id"])
    return once.select("manual_id", "occurrence_id", F.explode("source_span_ids").alias("span_id"))


def reconcile(fragments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per manual: eligible, assigned, unassigned, unknown and doubly assigned spans.

    One full outer join of two pre-aggregated sides; no side is broadcast.
    """
    eligible = fragments.select("manual_id", F.concat(F.lit("span-"), F.expr("substring(fragment_id, 6)")).alias("span_id")).distinct()
    assigned = assignments(occurrences).groupBy("manual_id", "span_id").agg(F.count("*").alias("times"))
    both = eligible.withColumn("e", F.lit(1)).join(assigned, ["manual_id", "span_id"], "full_outer")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return both.groupBy("manual_id").agg(
        F.count("e").alias("eligible"),
        one(F.col("times").isNotNull()).alias("assigned"),
        one(F.col("times").isNull()).alias("unassigned"),
        one(F.col("e").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("times") - 1)), F.lit(0)).alias("duplicates"),
    )


def recorded(occurrences: DataFrame) -> DataFrame:
    """Occurrences as the ledger takes them: one kept without an approved reason becomes unresolved, with its source as target and the failure noted."""
    once = occurrences.dropDuplicates(["occurrence_id"])
    demoted = (F.col("status") == "ALLOWED_PRESERVE") & ~(F.coalesce("preserve_reason_is_approved", F.lit(False)) & F.coalesce(F.col("preserve_reason").isin(APPROVED), F.lit(False)))
    failures = F.coalesce("validation_failures", F.array().cast("array<string>"))
    noted = F.array_distinct(F.concat(failures, F.array(F.lit("unapproved_preserve"))))
    return once.withColumns({
        "demoted": F.coalesce(demoted, F.lit(False)), "status": F.when(demoted, "UNRESOLVED").otherwise(F.col("status")), "target_text": F.when(demoted, F.col("source_text")).otherwise(F.col("target_text")),
        "unresolved_reason": F.when(demoted, "unapproved_preserve").otherwise(F.col("unresolved_reason")), "validation_failures": F.when(demoted, noted).otherwise(F.array_distinct(failures)),
    })


def mark_unresolved(recorded_: DataFrame, marks: DataFrame) -> DataFrame:
    """Recorded occurrences with some marked unresolved afterwards; ``marks`` has occurrence_id, reason and failures, the last mark of an id by ``seq``."""
    last = marks.groupBy("occurrence_id").agg(F.max_by("reason", "seq").alias("m_reason"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("failures")))).alias("m_failures"))
    both = recorded_.join(last, "occurrence_id", "left")
    hit = F.col("m_reason").isNotNull()
    return both.withColumns({
        "status": F.when(hit, "UNRESOLVED").otherwise(F.col("status")), "target_text": F.when(hit, F.col("source_text")).otherwise(F.col("target_text")),
        "unresolved_reason": F.coalesce("m_reason", "unresolved_reason"), "validation_failures": F.array_distinct(F.concat("validation_failures", F.coalesce("m_failures", F.array().cast("array<string>")))),
    }).drop("m_reason", "m_failures")


def delivery(occurrences: DataFrame, fragments: DataFrame, leaks: DataFrame | None = None) -> DataFrame:
    """Per manual: counts by status, coverage, completion and whether it can be delivered.

    It fails if spans are unassigned, assigned twice or not eligible, if a status
    is unknown, if the final text leaks the source's script, or if failures are
    left without an unresolved occurrence.
    """
    per = recorded(occurrences).groupBy("manual_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in zip(STATUSES, ("translated", "preserved", "unresolved"), strict=True)],
        F.count_if(F.col("status").isNull() | ~F.col("status").isin(STATUSES)).alias("unknown"),
        F.count_if(F.size("validation_failures") > 0).alias("failed"),
    )
    both = per.join(reconcile(fragments, occurrences).withColumnRenamed("unknown", "unknown_spans"), "manual_id", "left")
    leaked = F.lit(0)
    if leaks is not None:
        both = both.join(leaks.groupBy("manual_id").agg(F.sum("leaks").alias("leaked")), "manual_id", "left")
        leaked = F.coalesce("leaked", F.lit(0))
    spans_fail = (F.col("unassigned") > 0) | (F.col("duplicates") > 0) | (F.col("unknown_spans") > 0)
    fail = F.coalesce(spans_fail, F.lit(False)) | (F.col("unknown") > 0) | (leaked > 0) | ((F.col("failed") > 0) & (F.col("unresolved") == 0))
    share = lambda *c: F.round(sum((F.col(x) for x in c[1:]), F.col(c[0])) / F.col("n"), 4)
    return both.select("manual_id", "n", "translated", "preserved", "unresolved", "unknown", "failed", share("translated", "preserved", "unresolved").alias("coverage"), share("translated", "preserved").alias("completion"), F.when(fail, "FAIL").when(F.col("unresolved") > 0, "PARTIAL").otherwise("SUCCESS").alias("delivery"))


def failure_counts(occurrences: DataFrame) -> DataFrame:
    """Distinct occurrences per failure code."""
    return occurrences.select("occurrence_id", F.explode("validation_failures").alias("failure")).groupBy("failure").agg(F.countDistinct("occurrence_id").alias("occurrences"))
