"""Scans in steps that go on where they were stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from chronolake.schema import Schema


class Progress:
    """Names of the steps done, one empty file each in a folder; a step counts once its file is there."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf, self.path = spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def done(self) -> set[str]:
        fs = self._at().getFileSystem(self._conf)
        return {f.getPath().getName() for f in fs.listStatus(self._at())} if fs.exists(self._at()) else set()

    def mark(self, name: str) -> None:
        self._at().getFileSystem(self._conf).createNewFile(self._at(name))


def spans(start: datetime, stop: datetime, step: timedelta) -> Iterator[tuple[datetime, datetime]]:
    """[start, stop) in steps."""
    while start < stop:
        yield start, min(start + step, stop)
        start += step


def resumable(spark: SparkSession, schema: Schema, table: str, start: datetime, stop: datetime, step: timedelta, progress: Progress, sink: Callable[[DataFrame, str], None]) -> int:
    """Give ``sink`` a table's rows span by span, leaving out spans done before; returns how many were done now.

    ``sink`` gets a span's rows and its name, and has to replace what it may have made of that span earlier, since a
    span whose processing failed is given again.
    """
    done, now = progress.done(), 0
    for a, b in spans(start, stop, step):
        name = a.strftime("%Y%m%dT%H%M%S")
        if name in done:
            continue
        rows = schema.rows(spark, table, [(a, b)])
        sink(rows.where((rows["time"] >= a) & (rows["time"] < b)), name)
        progress.mark(name)
        now += 1
    return now
