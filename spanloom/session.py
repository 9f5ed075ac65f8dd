"""Session construction for tests, the bench and interactive use.

On a cluster the session comes from the driver; nothing here overrides its
settings.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session sized for the test machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where
    that is unset, a local session uses a temporary folder; on a cluster, whose
    machines share no such folder, that is an error. Unlike a local checkpoint,
    the written files survive the loss of any executor.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-"))
    return df.checkpoint(eager=True)
