"""Aggregated measures of texts, units and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_length_stats(units: DataFrame) -> DataFrame:
    """Per manual: units and mean, median and longest length; exact percentiles are per group, not global."""
    n = F.length("text")
    return units.filter("text IS NOT NULL").groupBy("manual_id").agg(F.count("*").alias("units"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(F.percentile(n, F.lit(0.5)), 4).alias("median_chars"), F.max(n).alias("max_chars"))


def batch_percentiles(segments: DataFrame, capacity: int = 12_000) -> DataFrame:
    """Linear percentiles, mean and use of the capacity of source lengths per wanted language, from the histogram (value, frequency)."""
    once = segments.dropDuplicates(["segment_id"]).filter("src IS NOT NULL")
    h = once.groupBy("lang_out", F.length("src").alias("n")).agg(F.count("*").alias("k"))
    q = lambda p: F.expr(f"round(percentile(n, {p}, k), 4)").alias(f"p{int(p * 100)}")
    chars = F.sum(F.col("n") * F.col("k"))
    return h.groupBy("lang_out").agg(F.sum("k").alias("segments"), F.round(chars / F.sum("k"), 4).alias("mean"), q(0.5), q(0.9), q(0.99), F.max("n").alias("longest"), F.round(chars / (F.sum("k") * capacity), 6).alias("used"))


def health(units: DataFrame) -> DataFrame:
    """Per manual: candidates and accepted merges, their rates, and whether a person should look.

    Every fragment but the first is a candidate. A person should look if the
    candidates are many (100, or a fifth of the fragments) and few are accepted
    (under a quarter) or most units are single fragments (over three quarters).
    """
    size = F.size("source_fragment_ids")
    per = units.groupBy("manual_id").agg(F.sum(size).alias("fragments"), F.count("*").alias("units"), F.count_if(size == 1).alias("singles"))
    per = per.withColumns({"candidates": F.greatest(F.lit(0), F.col("fragments") - 1), "accepted": F.col("fragments") - F.col("units")})
    guarded = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    many = (F.col("candidates") >= 100) | (F.col("candidates") >= 0.2 * F.col("fragments"))
    review = F.when(many & ((guarded("accepted", "candidates") < 0.25) | (guarded("singles", "units") > 0.75)), "MANUAL_REVIEW_REQUIRED").otherwise("PASS")
    return per.select("manual_id", "fragments", "units", guarded("candidates", "fragments").alias("candidate_rate"), guarded("accepted", "candidates").alias("acceptance_rate"), guarded("singles", "units").alias("singleton_rate"), review.alias("health"))


def page_mode(fragments: DataFrame) -> DataFrame:
    """The most common style of each page that is not the plain one; of equally common ones the least."""
    n = fragments.dropDuplicates(["fragment_id"]).filter("style <> 0").groupBy("manual_id", "page", "style").agg(F.count("*").alias("n"))
    return n.groupBy("manual_id", "page").agg(F.max_by("style", F.struct(F.col("n"), -F.col("style"))).alias("style"), F.max("n").alias("n"))


def retry_sleeps(waits: DataFrame) -> DataFrame:
    """Number, sum, mean and longest of the waits per identity; ``waits`` has identity and wait."""
    return waits.groupBy("identity").agg(F.count("*").alias("sleeps"), F.round(F.sum("wait"), 4).alias("total"), F.round(F.avg("wait"), 4).alias("mean"), F.max("wait").alias("longest"))


def exclusive_time(stages: DataFrame) -> DataFrame:
    """Time of a stage without its direct children; ``stages`` has id, parent, seconds."""
    inner = stages.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("seconds").alias("inner"))
    return stages.join(inner, "id", "left").select("id", F.round(F.col("seconds") - F.coalesce("inner", F.lit(0.0)), 4).alias("exclusive"))


def stage_shares(stages: DataFrame, total: float) -> DataFrame:
    """Share of each stage's own time in the whole; 0 if the whole is."""
    return exclusive_time(stages).groupBy("id").agg(F.round(F.sum("exclusive") / total if total else F.lit(0.0), 4).alias("share"))
