"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language, mixing, normal, packing, pairs, repetition, sentences, subjects, tokenizer
from spanloom.sources.tables import spread, table, union_records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of one page whose texts print alike but differ in characters."""
    a = table(spark, d, "fragments").select(F.col("fragment_id").alias("id"), "manual_id", "page", "text")
    b = table(spark, d, "occurrences").select(F.col("occurrence_id").alias("id"), "manual_id", "page", F.col("source_text").alias("text"))
    return normal.look_alike_pairs(a.unionAll(b), ["manual_id", "page"])


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text of fragments and occurrences."""
    rows = union_records([(table(spark, d, "fragments"), "fragments", "fragment_id", "text"), (table(spark, d, "occurrences"), "occurrences", "occurrence_id", "source_text")])
    return rows.select("tbl", "record_id", normal.canonical_column(F.col("text")).alias("form")).dropDuplicates(["tbl", "record_id"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for df, name, key, label, text in language.labelled_sources(spark, d):
        one = df.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("record_id"), F.col(label).alias("label"), F.col(text).alias("text"))
        out = one if out is None else out.unionAll(one)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages in a text that its label does not name."""
    return language.unlabelled_languages(_labelled(spark, d), language.fit_on(spark, d))


def p2_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language, with its place and confidence."""
    rows = _labelled(spark, d).dropDuplicates(["tbl", "record_id"]).drop("label")
    return language.stretch_rows(rows, language.fit_on(spark, d)).withColumn("confidence", F.round("confidence", 3))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every record (most characters), its confidence and its share."""
    s = p2_stretches(spark, d).withColumn("n", F.col("end_at") - F.col("start_at"))
    per = s.groupBy("tbl", "record_id", "lang").agg(F.sum("n").alias("n"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"))
    best = per.groupBy("tbl", "record_id").agg(F.max(F.struct("n", "lang", "confidence")).alias("b"), F.sum("n").alias("t"))
    return best.select("tbl", "record_id", F.col("b.lang").alias("lang"), F.round("b.confidence", 3).alias("confidence"), F.round(F.col("b.n") / F.col("t"), 3).alias("share"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of segments and logical units with its place."""
    model = sentences.fit_on(spark, d)
    rows = union_records([(table(spark, d, "segments"), "segments", "segment_id", "src"), (table(spark, d, "logical_units"), "logical_units", "logical_unit_id", "text")])
    return sentences.sentence_spans(rows.dropDuplicates(["tbl", "record_id"]), model)


def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every segment (or piece of one) per limit."""
    return packing.pack(table(spark, d, "segments"), table(spark, d, "batch_limits"))


def p4_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The length buckets that the dynamic programme chooses, with their padding."""
    return packing.bucket_report(table(spark, d, "segments"), table(spark, d, "batch_limits"))


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per limit and group: containers, the least number possible by volume, and the share of space used."""
    used = p4_containers(spark, d).groupBy("limit_name", "manual_id", "lang_out", "capacity").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("used"))
    least = F.greatest(F.lit(1), F.ceil(F.col("used") / F.col("capacity")))
    return used.select("limit_name", "manual_id", "lang_out", "containers", least.alias("least"), F.round(F.col("used") / (F.col("containers") * F.col("capacity")), 4).alias("fill"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return union_records([(table(spark, d, "occurrences"), "occurrences", "occurrence_id", "target_text"), (table(spark, d, "translation_cache"), "translation_cache", "id", "translation")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that repeat themselves in two fifths of their text or more."""
    return repetition.repetition(_answers(spark, d)).filter("rejected").select("tbl", "record_id")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content of every text."""
    return repetition.repetition(_answers(spark, d)).select("tbl", "record_id", F.round("share", 4).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defect."""
    o = table(spark, d, "occurrences").filter("status = 'TRANSLATED'")
    o = o.select(F.lit("occurrences").alias("tbl"), F.col("occurrence_id").alias("record_id"), F.col("source_text").alias("prompt"), F.col("target_text").alias("answer"), F.col("lang_out").alias("want"), F.lit(None).cast("string").alias("engine"))
    c = table(spark, d, "translation_cache")
    c = c.select(F.lit("translation_cache").alias("tbl"), F.col("id").cast("string").alias("record_id"), F.col("original_text").alias("prompt"), F.col("translation").alias("answer"), F.get_json_object("translate_engine_params", "$.lang_out").alias("want"), F.col("translate_engine").alias("engine"))
    rows = o.unionAll(c)
    return pairs.defective_pairs(rows, language.fit_on(spark, d), pairs.usual_ratios(rows))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_documents(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokenizer.count_column(F.col("text")).alias("tokens"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of every document decode to its text again, by the incremental decoder."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokenizer.roundtrip_column(F.col("text")).alias("same"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return mixing.mix(mixing.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of the mix."""
    return mixing.report(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that at least a quarter of a document's sentences deal with."""
    return subjects.document_subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject."""
    found = subjects.document_subjects(spark, d)
    n = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    per = found.join(n, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
    return table(spark, d, "subject_areas").select("subject").join(per, "subject", "left").fillna(0, ["documents", "chars"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_stretches, p2_documents, p3_found, p4_containers, p4_buckets, p4_fill, p5_found, p5_shares, p6_found, p7_ids, p7_counts, p7_roundtrip, p8_selection, p8_report, p9_found, p9_composition)}


def oracle_sql() -> dict[str, str]:
    """None of these has an exact form in SQL: they are tested against brute force, round trips and held-out accuracy."""
    return {}
