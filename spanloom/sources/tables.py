"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str, waves: int = 2) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` if its scan has too few splits to busy the cores.

    Large inputs already have more splits than ``waves`` rounds of tasks and
    pass unchanged, so the exchange exists only where the input is small.
    Keys should be unique-ish, so that no hot value gathers in one task.
    """
    want = waves * df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want, *keys)


def union_records(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Stack ``(df, tbl, id column, text column)`` as (tbl, record_id, text)."""
    out = None
    for df, name, key, text in parts:
        one = df.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        out = one if out is None else out.unionAll(one)
    return out
