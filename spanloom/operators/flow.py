"""Work queues: deduplication, cache lookup, batching order, retry state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions import spans
from spanloom.functions.patterns import jvm
from spanloom.operators import integrity, rules
from spanloom.session import cut_lineage

LONGEST_CONTEXT = 300  # characters


def segment_dedup(segments: DataFrame) -> DataFrame:
    """One row per segment_id, and whether its copies agree on the source (conflicts are errors for a loader)."""
    per = segments.groupBy("segment_id").agg(F.count("*").alias("copies"), F.countDistinct(F.coalesce("src", F.lit("\x00"))).alias("sources"), F.min("src").alias("src"))
    return per.select("segment_id", "copies", (F.col("sources") > 1).alias("conflict"), F.length("src").alias("chars"))


def latest_cache(cache: DataFrame) -> DataFrame:
    """The last written entry per engine, parameters and text: an append log read as a key-value cache.

    ``max_by`` over a struct combines map-side, so a hot key is one row per task.
    """
    key = ["translate_engine", "translate_engine_params", "original_text"]
    return cache.groupBy(*key).agg(F.max(F.struct("written_at", "id")).alias("w"), F.max_by("translation", F.struct("written_at", "id")).alias("translation"), F.count("*").alias("versions")).select(
        F.col("w.id").alias("id"), "translate_engine", "versions", F.length("translation").alias("chars")
    )


def lookup_precedence(segments: DataFrame, occurrences: DataFrame, cache: DataFrame) -> DataFrame:
    """Where each segment's translation comes from: its occurrence, else the cache of its text, else nowhere.

    Both lookup sides are made unique before joining, so no join fans out.
    """
    seg = segments.select("segment_id", "src", "occurrence_id", "lang_out").dropDuplicates(["segment_id"])
    by_id = occurrences.filter("status = 'TRANSLATED' AND target_text IS NOT NULL").select("occurrence_id", F.col("source_text").alias("o_src"), "target_text").dropDuplicates(["occurrence_id"])
    by_text = cache.filter("translation IS NOT NULL").groupBy(F.col("original_text").alias("src"), F.get_json_object("translate_engine_params", "$.lang_out").alias("lang_out"))
    by_text = by_text.agg(F.count("*").alias("entries"))
    out = seg.join(by_id, "occurrence_id", "left").join(by_text, ["src", "lang_out"], "left")
    source = F.when(F.col("o_src").eqNullSafe(F.col("src")) & F.col("target_text").isNotNull(), "occurrence").when(F.col("entries").isNotNull(), "cache").otherwise("miss")
    return out.select("segment_id", source.alias("found_in"))


def loaded_segments(segments: DataFrame) -> DataFrame:
    """Segments as a loader takes them: one per id; a row without a source, or an id with two sources, is an error.

    A missing id is the hash of the source.
    """
    key = F.coalesce("segment_id", F.substring(F.sha2("src", 256), 1, 16))
    rows = segments.withColumn("segment_id", key)
    same = F.struct("src", "logical_unit_id", "occurrence_id", "source_fragment_ids")
    per = rows.groupBy("segment_id").agg(F.min("src").alias("src"), F.countDistinct(same).alias("versions"), F.count_if(F.col("src").isNull() | (F.col("src") == "")).alias("without"))
    fail = lambda c, m: F.when(c, F.raise_error(F.lit(m)).cast("string"))
    checked = F.coalesce(fail(F.col("without") > 0, "a source record needs a text"), fail(F.col("versions") > 1, "an id stands for several sources"), F.col("src"))
    return per.select("segment_id", checked.alias("src"))


def job_keys(segments: DataFrame, service: str = "google") -> DataFrame:
    """(segment_id, src, lang_out, job, identity): segments of one text share a job where that is safe, else each has its own.

    The identity of a job is the hash of its text, or of text and place.
    """
    seg = segments.select("segment_id", "src", "lang_out").dropDuplicates(["segment_id"]).filter("src IS NOT NULL")
    shared = rules.safe_to_share(F.col("src"))
    if service == "handoff":
        shared = shared & ~rules.context_sensitive(F.col("src"))
    place = F.concat("src", F.lit("\x00index="), "segment_id")
    job = F.when(shared, F.sha2(F.concat_ws("\x01", "src", "lang_out"), 256)).otherwise(F.col("segment_id"))
    return seg.select("segment_id", "src", "lang_out", job.alias("job"), F.substring(F.sha2(F.when(shared, F.col("src")).otherwise(place), 256), 1, 16).alias("identity"))


def job_fanout(segments: DataFrame) -> DataFrame:
    """Jobs and how many segments each serves."""
    return job_keys(segments).groupBy("job").agg(F.count("*").alias("served"), F.min("segment_id").alias("first_segment"))


def job_outcomes(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """(segment_id, job, chars): every job is looked up once, by its first segment's text, and the outcome goes back to all segments of the job.

    The outcome is null where the cache has none. Jobs are far fewer than
    segments only if texts repeat; both joins are on the job's key.
    """
    keys = job_keys(segments)
    jobs = keys.groupBy("job").agg(F.min_by(F.struct("src", "lang_out"), "segment_id").alias("r")).select("job", "r.*")
    known = cache.filter("translation IS NOT NULL").groupBy(F.col("original_text").alias("src"), F.get_json_object("translate_engine_params", "$.lang_out").alias("lang_out"))
    known = known.agg(F.max_by("translation", F.struct("written_at", "id")).alias("translation"))
    done = jobs.join(known, ["src", "lang_out"], "left").select("job", F.length("translation").alias("chars"))
    return keys.select("segment_id", "job").join(done, "job").select("segment_id", "job", "chars")


def cascade(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """(segment_id, found_in): the first of the provider's cache with a valid translation, the hand-off's cache, else the provider.

    A cached translation of the provider with signs of corruption is passed on
    ('escalated') unless the hand-off has one.
    """
    seg = segments.select("segment_id", "src", "lang_out").dropDuplicates(["segment_id"])
    engine = lambda e: cache.filter((F.col("translate_engine") == e) & F.col("translation").isNotNull()).groupBy(F.col("original_text").alias("src"), F.get_json_object("translate_engine_params", "$.lang_out").alias("lang_out")).agg(F.max_by("translation", F.struct("written_at", "id")).alias(e))
    both = seg.join(engine("google"), ["src", "lang_out"], "left").join(engine("handoff"), ["src", "lang_out"], "left")
    codes = integrity.integrity_codes(F.col("src"), F.col("google"), F.lit(None).cast("string"), F.col("lang_out"), F.lit(True))
    bad = F.col("google").isNotNull() & (F.size(codes) > 0)
    where = F.when(F.col("google").isNotNull() & ~bad, "google").when(F.col("handoff").isNotNull(), "handoff").when(bad, "escalated").otherwise("provider")
    return both.select("segment_id", where.alias("found_in"))


def assess(sources: DataFrame, supplied: DataFrame, kept: Sequence[str] = spans.KEPT_NAMES, glossary: dict[str, str] | None = None) -> DataFrame:
    """(segment_id, verdict) of every source, and of supplied translations that fit none.

    ``sources`` has segment_id, src; ``supplied`` segment_id, src, dst (a missing id is
    the hash of src). Errors first: 'unknown_id', 'source_mismatch' and 'duplicate'; then
    'missing' without a translation, the first check that fails, or 'accepted'.
    """
    s = sources.select("segment_id", F.col("src").alias("own")).dropDuplicates(["segment_id"])
    given = supplied.select(F.coalesce("segment_id", F.substring(F.sha2("src", 256), 1, 16)).alias("segment_id"), "src", "dst")
    per = given.groupBy("segment_id").agg(F.count("*").alias("n"), F.min("src").alias("src"), F.min("dst").alias("dst"))
    both = s.join(per, "segment_id", "full_outer")
    failed = integrity.first_failure(F.col("own"), F.col("dst"), F.lit("vi"), kept, glossary)
    verdict = (
        F.when(F.col("own").isNull(), "unknown_id").when(F.col("n") > 1, "duplicate").when(F.col("src") != F.col("own"), "source_mismatch")
        .when(F.coalesce(F.col("dst"), F.lit("")) == "", "missing").otherwise(F.coalesce(failed, F.lit("accepted")))
    )
    return both.select("segment_id", verdict.alias("verdict"))


def segment_table(supplied: DataFrame) -> DataFrame:
    """(segment_id, src, dst) of the usable rows of a translation table: with source and target, formula markers in tag form, and the same tags on both sides."""
    tags = lambda c: F.regexp_replace(c, jvm(r"(?i)\{\s*v(\d+)\s*\}"), "<b$1></b$1>")
    rows = supplied.filter("src IS NOT NULL AND dst IS NOT NULL AND dst <> ''").select("segment_id", "src", tags(F.col("dst")).alias("dst"))
    s, d = tags(F.col("src")), F.col("dst")
    pairs = (integrity.style_pairs(s) == integrity.style_pairs(d)) & (integrity.formula_tags(s) == integrity.formula_tags(d))
    return rows.filter(F.coalesce(pairs, F.lit(False)))


def two_strike(attempts: DataFrame) -> DataFrame:
    """(identity, trusted_at, reason): identities trusted after two failures without a success between, since when, and the first one's reason.

    ``attempts`` has identity, seq, outcome ('failure', 'success', others neutral) and, if
    known, reason; a failure of blank reason counts as neutral.
    """
    rows = attempts if "reason" in attempts.columns else attempts.withColumn("reason", F.lit("failure"))
    counted = rows.filter("outcome = 'success' OR (outcome = 'failure' AND trim(reason) <> '')")
    w = Window.partitionBy("identity").orderBy("seq")
    seen = counted.withColumn("before", F.lag(F.struct("outcome", "reason")).over(w))
    struck = seen.filter("outcome = 'failure' AND before.outcome = 'failure'")
    return struck.groupBy("identity").agg(F.min("seq").alias("trusted_at"), F.min_by("before.reason", "seq").alias("reason"))


def skipped(attempts: DataFrame) -> DataFrame:
    """(identity, seq, reason): later attempts of trusted identities, which are not made."""
    return attempts.select("identity", "seq").join(two_strike(attempts), "identity").filter("seq > trusted_at").select("identity", "seq", "reason")


def retry_state(attempts: DataFrame) -> DataFrame:
    """(identity, seq, attempt, budget, wait, stop): attempts since the last success, and whether the error's budget is spent.

    ``attempts`` has identity, seq, outcome and error (its class). Waits double from
    one second to a minute.
    """
    w = Window.partitionBy("identity").orderBy("seq")
    rounds = F.count_if(F.col("outcome") == "success").over(w.rowsBetween(Window.unboundedPreceding, -1))
    failures = attempts.withColumn("round", F.coalesce(rounds, F.lit(0))).filter("outcome = 'failure'")
    attempt = F.row_number().over(Window.partitionBy("identity", "round").orderBy("seq"))
    kind = rules.retry_class(F.col("error"))
    budget = F.when(kind == "pre_provider", P.BUDGETS["pre_provider"]).when(kind == "content", P.BUDGETS["content"]).otherwise(P.BUDGETS["transport"])
    rows = failures.select("identity", "seq", attempt.alias("attempt"), budget.alias("budget"))
    wait = F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(6))))
    return rows.select("identity", "seq", "attempt", "budget", wait.alias("wait"), (F.col("attempt") >= F.col("budget")).alias("stop"))


def negative_cache(segments: DataFrame, engine: str = "google") -> DataFrame:
    """(segment_id, eligible): whether a failure of a segment may be remembered for its text: shared, of the provider, without context of its own."""
    once = segments.select("segment_id", "src", "context").dropDuplicates(["segment_id"])
    ok = rules.safe_to_share(F.col("src")) & F.lit(engine == "google") & F.col("context").isNull() & ~rules.context_sensitive(F.col("src"))
    return once.select("segment_id", F.coalesce(ok, F.lit(False)).alias("eligible"))


def adjacent_context(segments: DataFrame, longest: int = LONGEST_CONTEXT) -> DataFrame:
    """The nearest short neighbour of each segment in its manual's queue that is in another text and of the same wanted language: the previous one, else the next.

    A manual may hold a third of all rows, so neighbours are sought within its
    days; the first and last rows of a day, a small table, learn theirs from the
    neighbouring days.
    """
    short = F.when(F.length("src") <= longest, F.struct("segment_id", "src", "lang_out"))
    once = segments.select("segment_id", "manual_id", "src", "lang_out", "queued_at").dropDuplicates(["segment_id"])
    rows = once.withColumns({"day": F.date_trunc("day", "queued_at"), "me": F.coalesce(short, F.struct("segment_id", F.lit(None).cast("string").alias("src"), "lang_out")), "at": F.struct("queued_at", "segment_id")})
    inside = Window.partitionBy("manual_id", "day").orderBy("at")
    near = rows.withColumns({"p": F.lag("me").over(inside), "n": F.lead("me").over(inside)})
    days = rows.groupBy("manual_id", "day").agg(F.min_by("me", "at").alias("first"), F.max_by("me", "at").alias("last"))
    along = Window.partitionBy("manual_id").orderBy("day")
    edges = days.select("manual_id", "day", F.lag("last").over(along).alias("ep"), F.lead("first").over(along).alias("en"))
    l, e = near.alias("l"), edges.alias("e")
    both = l.join(e, [F.col("l.manual_id").eqNullSafe(F.col("e.manual_id")), F.col("l.day").eqNullSafe(F.col("e.day"))], "left")
    fits = lambda c: c["src"].isNotNull() & (c["src"] != F.col("l.src")) & c["lang_out"].eqNullSafe(F.col("l.lang_out"))
    p, n = F.coalesce("l.p", "e.ep"), F.coalesce("l.n", "e.en")
    return both.select("l.segment_id", F.when(fits(p), p["segment_id"]).when(fits(n), n["segment_id"]).alias("context_id"))


def retry_rounds(sources: DataFrame, translate: Callable[[DataFrame], DataFrame], rounds: int = 3, kept: Sequence[str] = spans.KEPT_NAMES, glossary: dict[str, str] | None = None) -> DataFrame:
    """(segment_id, verdict, round): sources translated and assessed, the failed ones again, at most ``rounds`` times.

    ``translate`` takes segment_id, src and gives segment_id, src, dst. Each round is
    written once, so that a provider is never asked twice for it.
    """
    left, done = sources.select("segment_id", "src").dropDuplicates(["segment_id"]), None
    for n in range(1, rounds + 1):
        verdicts = assess(left, cut_lineage(translate(left)), kept, glossary)
        judged = cut_lineage(verdicts.filter("verdict <> 'unknown_id'").withColumn("round", F.lit(n)))
        settled = judged if n == rounds else judged.filter("verdict = 'accepted'")
        done = settled if done is None else done.unionByName(settled)
        left = left.join(judged.filter("verdict <> 'accepted'").select("segment_id"), "segment_id", "left_semi")
    return done


def accounts(jobs: DataFrame) -> DataFrame:
    """One row: segments, those with and without an outcome, and whether these make up all; ``jobs`` as of ``job_outcomes``."""
    per = jobs.agg(F.count("*").alias("segments"), F.count("chars").alias("translated"), F.count_if(F.col("chars").isNull()).alias("missing"))
    return per.withColumn("complete", F.col("segments") == F.col("translated") + F.col("missing"))


def batch_stats(segments: DataFrame, batches: DataFrame, capacity: int = 12_000) -> DataFrame:
    """One row: batches, units and characters per batch (mean, median, p90, longest) and use of the capacity; ``batches`` as of ``greedy_batches``."""
    n = segments.dropDuplicates(["segment_id"]).select("segment_id", "manual_id", F.coalesce(F.length("src"), F.lit(0)).alias("n"))
    per = batches.filter("batch >= 0").join(n, "segment_id").groupBy("manual_id", "batch").agg(F.count("*").alias("units"), F.sum("n").alias("chars"))
    # The histogram is small however many batches there are.
    h = per.groupBy("units", "chars").agg(F.count("*").alias("k"))
    q = lambda c, p, name: F.round(F.expr(f"percentile({c}, {p}, k)"), 4).alias(name)
    total = F.sum("k")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("k")) / total, 4)
    return h.agg(total.alias("batches"), mean("units").alias("units_mean"), q("units", 0.5, "units_median"), mean("chars").alias("chars_mean"), q("chars", 0.5, "chars_median"), q("chars", 0.9, "chars_p90"), F.max("chars").alias("chars_longest"), F.round(F.sum(F.col("chars") * F.col("k")) / (total * capacity), 6).alias("used"))
