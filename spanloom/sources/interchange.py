"""JSON-lines interchange, page selection, append-once queue, injected providers and verified publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_SCHEMA = "segment_id string, src string, logical_unit_id string, occurrence_id string, source_fragment_ids array<string>, context struct<type:string,kind:string,text:string>"
LONGEST_REQUEST = 5000  # characters that a provider takes at once


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, and a line that is no object of it fails the read with its beginning."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    first = rows.columns[0]
    failed = F.raise_error(F.concat(F.lit("not a record: "), F.substring("_bad", 1, 200)))
    kind = rows.schema[first].dataType
    return rows.withColumn(first, F.when(F.col("_bad").isNotNull(), failed.cast(kind)).otherwise(F.col(first))).drop("_bad")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSON-lines file; a bad line fails the read. A missing id is the hash of its source."""
    rows = read_objects(spark, path, SEGMENT_SCHEMA)
    return rows.withColumn("segment_id", F.coalesce("segment_id", F.substring(F.sha2("src", 256), 1, 16)))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, src, dst) from lines that hold one record or a list of records under "translations"."""
    one = "segment_id string, src string, dst string"
    rows = read_objects(spark, path, f"{one}, translations array<struct<segment_id:string,src:string,dst:string>>")
    nested = rows.select("segment_id", "src", "dst", F.explode_outer("translations").alias("t"))
    return nested.select(*[F.coalesce(f"t.{c}", c).alias(c) for c in ("segment_id", "src", "dst")])


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, target) from a file that holds one JSON object of texts; an empty term or target fails the read."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("term", "target"))
    bad = (F.trim("term") == "") | F.coalesce(F.trim("target") == "", F.lit(True))
    return rows.select(F.when(bad, F.raise_error(F.lit("terms and targets must not be empty")).cast("string")).otherwise(F.col("term")).alias("term"), "target")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; the job commit makes the result appear as a whole."""
    df.write.mode("errorifexists").json(path)


def publish(df: DataFrame, path: str, staging: str) -> int:
    """Write to a staging folder, read it back, compare rows and digests, and only then rename it to ``path``; returns the rows.

    Both folders lie on one file system, which all executors share. Readers of
    ``path`` see either nothing or the whole verified result.
    """
    spark = df.sparkSession
    digest = lambda d: d.select(F.xxhash64(*d.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    df.write.mode("overwrite").parquet(staging)
    wrote, read = digest(df), digest(spark.read.parquet(staging))
    if tuple(wrote) != tuple(read):
        raise RuntimeError("the staged result differs from what was to be written")
    jvm = spark._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    if not fs.rename(source, target):
        raise RuntimeError("the staged result could not be renamed")
    return int(read.n)


def enqueue_misses(misses: DataFrame, queue: DataFrame, key: str = "segment_id") -> DataFrame:
    """Misses not yet queued, each once."""
    return misses.dropDuplicates([key]).join(queue.select(key).distinct(), key, "left_anti")


def append_misses(misses: DataFrame, path: str, key: str = "segment_id") -> int:
    """Append the misses that the queue at ``path`` does not hold yet; returns how many."""
    spark = misses.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    new = enqueue_misses(misses, spark.read.parquet(path), key) if there else misses.dropDuplicates([key])
    before = spark.read.parquet(path).count() if there else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def call_provider(units: DataFrame, provider: Callable[[list[str]], list[str]], text: str = "src", longest: int = LONGEST_REQUEST) -> DataFrame:
    """``units`` with the provider's answer in ``dst`` and, for texts that are too long or blank answers, why there is none in ``error``.

    The provider is injected and called once per Arrow batch with its different
    texts; HTML escapes and control characters are taken out of its answers.
    """
    import html
    import unicodedata

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            asked = list(dict.fromkeys(t for t in part[text].dropna() if t.strip() and len(t) <= longest))
            answers = dict(zip(asked, provider(asked), strict=True)) if asked else {}
            clean = {k: "".join(c for c in html.unescape(v or "") if unicodedata.category(c)[0] != "C") for k, v in answers.items()}
            part["dst"] = [clean.get(t) or None for t in part[text]]
            part["error"] = ["SegmentTooLongError" if isinstance(t, str) and len(t) > longest else None if isinstance(t, str) and clean.get(t) else "UnresolvedSegmentError" for t in part[text]]
            yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInPandas(translate, f"{fields}, dst string, error string")


def page_selection(spark: SparkSession, grammar: str) -> DataFrame:
    """Zero-based pages of a one-based selection such as "1,3-5"; an empty or reversed range is an error."""
    items = spark.createDataFrame([(grammar,)], "g string").select(F.explode(F.split("g", ",")).alias("i"))
    ends = items.select(F.trim(F.regexp_extract("i", r"^\s*(\d+)", 1)).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract("i", r"-\s*(\d+)\s*$", 1), F.lit("")), F.regexp_extract("i", r"^\s*(\d+)", 1)).cast("int").alias("b"))
    checked = ends.withColumn("b", F.when((F.col("a") >= 1) & (F.col("a") <= F.col("b")), F.col("b")).otherwise(F.raise_error(F.lit("bad page selection")).cast("int")))
    return checked.select(F.explode(F.sequence(F.col("a") - 1, F.col("b") - 1)).alias("page")).distinct()


def binary_guard(spark: SparkSession, path: str, suffix: str = ".pdf", magic: str = "%PDF-") -> DataFrame:
    """(path, length, ok): files of a folder with the suffix in any case, each once, and whether they carry the magic in their first kilobyte."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.select("path", "length", head.contains(magic).alias("ok")).dropDuplicates(["path"])
