"""Progress and cancellation of long work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Passes (query name, batch, rows) of every finished micro-batch to a callable."""

    def __init__(self, report: Callable[[str, int, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Work inside carries ``tag``; the callable given, from any thread, cancels its jobs."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield lambda: sc.cancelJobsWithTag(tag)
    finally:
        sc.removeJobTag(tag)
