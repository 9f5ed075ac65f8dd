"""Bounded, repeatable samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, key: str, limit: int) -> list[Row]:
    """At most ``limit`` rows of ``df``, those of smallest hash of ``key``.

    ``rows`` is about the number of rows of the table behind ``df``. Larger
    tables are thinned by the same hash first, so that all tasks together send
    the driver a small multiple of ``limit`` rows, whatever their number. The
    sample is the same on every run and for every partitioning.
    """
    h = F.xxhash64(key)
    parts = rows // (4 * limit)
    if parts > 1:
        df = df.filter(F.pmod(h, F.lit(parts)) == 0)
    return df.orderBy(h, *df.columns).limit(limit).collect()


def distinct_sample(df: DataFrame, key: str, limit: int, stratum: str | None = None) -> list[Row]:
    """At most ``limit`` different values of ``key``, those of smallest hash, with their ``stratum`` if one is named.

    Copies of a value count once, so a hot one takes one place only; its stratum
    is the one most of them have. The strata (few) take turns, so each keeps an
    equal share of the bound, and what small ones leave goes to the others. Only
    hashes are counted and ranked, thinned per stratum by the number of its
    values; the values of those chosen are then looked up. The sample is the
    same on every run and for every partitioning.
    """
    hashed = df.select(key, F.xxhash64(key).alias("h"), (F.col(stratum) if stratum else F.lit("")).alias("g"))
    votes = hashed.groupBy("h", "g").count()
    values = votes.groupBy("h").agg(F.max(F.struct("count", "g"))["g"].alias("g"))
    sizes = {r.g: r["count"] for r in values.groupBy("g").count().collect()}
    if not sizes:
        return []
    parts = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, max(1, n // (2 * limit)))])
    kept = values.filter(F.pmod("h", parts[F.col("g")]) == 0)
    turn = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    chosen = kept.withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", "h").limit(limit).select("h", "g")
    picked = df.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    found = hashed.drop("g").join(F.broadcast(picked), "h").groupBy("h", "g").agg(F.min(key).alias(key))  # at most limit rows
    return found.orderBy("h").select(F.col("g").alias(stratum or "stratum"), key).collect()
