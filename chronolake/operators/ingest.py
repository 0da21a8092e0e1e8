"""Keyed storage of tables: puts, upserts, the changelog, and what follows from them."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from chronolake.schema import QueryError, Table
from chronolake.session import written

CHANGELOG = T.StructType([T.StructField(n, t) for n, t in (("table", T.StringType()), ("updated_at", T.TimestampType()), ("from", T.TimestampType()), ("to", T.TimestampType()), ("updated_by", T.StringType()))])


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``; combined before the shuffle, so repeated puts of one key stay cheap."""
    rest = [c for c in rows.columns if c not in key]
    top = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_top")
    return rows.groupBy(*key).agg(top).select(*key, *[F.col(f"_top.`{c}`").alias(c) for c in rest])


def base_time(table: Table) -> Column:
    """The start of a row's time partition, in epoch milliseconds."""
    return F.unix_millis("time") - F.pmod(F.unix_millis("time"), F.lit(table.span_ms))


class StoreBusy(RuntimeError):
    """Another put into the table is under way."""


#: Time partitions up to so many are named one by one to the scan of a put.
FEW_SPANS = 10_000


class Store:
    """Tables as Parquet partitioned by time span, one folder each, and one changelog.

    A put reads only the partitions it touches, merges them by key and replaces just these. The merged rows are first
    written to the shared folder, since a partition can't be read and overwritten by one plan. Puts into one table
    exclude each other: a file holds the table while one is under way, or, if that put died, until the file is older
    than ``lease_seconds``; no put may take longer.
    """

    def __init__(self, spark: SparkSession, path: str, wait_seconds: float = 600, lease_seconds: float = 86_400):
        self.spark, self.path, self.wait_seconds, self.lease_seconds = spark, path.rstrip("/"), wait_seconds, lease_seconds

    @contextmanager
    def _holding(self, table: Table) -> Iterator[None]:
        lock = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(f"_put-{table.name}"))
        fs, end = lock.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), time.monotonic() + self.wait_seconds
        while not fs.createNewFile(lock):
            found = fs.globStatus(lock)
            if found and time.time() - found[0].getModificationTime() / 1000 > self.lease_seconds:
                fs.delete(lock, False)
                continue
            if time.monotonic() > end:
                raise StoreBusy(f"{lock.toString()} is there; if no put is under way, one died: delete the file")
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, table: Table) -> DataFrame:
        """The stored rows with their ``base_time``; an empty table before the first put."""
        schema = T.StructType([*table.struct().fields, T.StructField("base_time", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(self._at(table.name))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def put(self, table: Table, rows: DataFrame, user: str | None = None, now: datetime | None = None) -> None:
        """Add or replace data points by (time, dimensions). Of equal keys within ``rows`` the last column order decides.

        Rows with a null in their key are refused. Metrics that ``rows`` lacks become null; other columns are ignored.
        """
        have = set(rows.columns)
        missing = [c for c in table.key if c not in have]
        if missing:
            raise QueryError(f"{', '.join(missing)} not defined for {table.name}")
        columns = [F.timestamp_millis(F.unix_millis("time")).alias("time")]
        columns += [F.col(f"`{d.name}`").cast(d.type.spark).alias(d.name) for d in table.dimensions]
        columns += [(F.col(f"`{m.name}`") if m.name in have else F.lit(None)).cast(m.type.spark).alias(m.name) for m in table.metrics]
        broken = F.raise_error(F.lit(f"{table.name}: the key of a data point has a null"))
        whole = ~F.greatest(*[F.col(f"`{c}`").isNull() for c in table.key]) if len(table.key) > 1 else F.col("time").isNotNull()
        new = rows.select(*columns).where(F.when(whole, F.lit(True)).otherwise(broken)).withColumn("base_time", base_time(table)).withColumn("_seq", F.monotonically_increasing_id())
        new = written(latest(new, table.key, ["_seq"]), f"put-{table.name}")
        now, began = now or datetime.now(UTC), time.monotonic()
        with self._holding(table):
            spans = written(new.select("base_time").distinct(), f"spans-{table.name}")
            self._log(table, spans, user, now)  # stays if the put dies halfway
            old = self._touched(table, spans).withColumn("_seq", F.lit(-1).cast("bigint"))
            merged = written(latest(old.unionByName(new), table.key, ["_seq"]).drop("_seq"), f"merged-{table.name}")
            writer = merged.repartition("base_time").sortWithinPartitions(*table.key[1:], "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("base_time").parquet(self._at(table.name))
            # a reader of the first entry may have come before the rows
            self._log(table, spans, user, now + timedelta(milliseconds=1 + int(1000 * (time.monotonic() - began))))

    def _touched(self, table: Table, spans: DataFrame) -> DataFrame:
        """The stored rows of the partitions that a put touches; the scan lists only these, or those between the first and the last of very many."""
        named = [r[0] for r in spans.limit(FEW_SPANS + 1).collect()]
        if len(named) <= FEW_SPANS:
            return self.read(table).where(F.col("base_time").isin(named))
        first, last = spans.agg(F.min("base_time"), F.max("base_time")).first()
        return self.read(table).where(F.col("base_time").between(first, last)).join(spans, "base_time", "left_semi")

    def _log(self, table: Table, touched: DataFrame, user: str | None, now: datetime) -> None:
        rows = touched.select(
            F.lit(table.name).alias("table"), F.lit(now).cast("timestamp").alias("updated_at"), F.timestamp_millis("base_time").alias("from"),
            F.timestamp_millis(F.col("base_time") + table.span_ms).alias("to"), F.lit(user).cast("string").alias("updated_by"),
        )
        rows.write.mode("append").parquet(self._at("_changelog"))

    def changelog(self) -> DataFrame:
        """The latest entry of each (table, interval)."""
        try:
            rows = self.spark.read.schema(CHANGELOG).parquet(self._at("_changelog"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CHANGELOG)
        return latest_intervals(rows)


def latest_intervals(rows: DataFrame) -> DataFrame:
    """Of changelog rows for one (table, from, to) the one updated last."""
    return latest(rows.select(*CHANGELOG.names), ["table", "from", "to"], ["updated_at", "updated_by"]).select(*CHANGELOG.names)


def filter_changelog(rows: DataFrame, table: str | None = None, updated_by: str | None = None, updated: tuple | None = None, recalculated: tuple | None = None, recalculated_after: datetime | None = None) -> DataFrame:
    """Changelog entries by table, user, time of the update (within bounds) and interval.

    An interval meets ``recalculated`` (a, b) if it begins within it or spans a; ``recalculated_after`` asks for a start at or after it.
    """
    if table is not None:
        rows = rows.where(F.col("table") == table)
    if updated_by is not None:
        rows = rows.where(F.col("updated_by") == updated_by)
    if updated is not None:
        rows = rows.where(F.col("updated_at").between(*[F.lit(x).cast("timestamp") for x in updated]))
    if recalculated is not None:
        a, b = [F.lit(x).cast("timestamp") for x in recalculated]
        rows = rows.where(F.col("from").between(a, b) | ((F.col("from") <= a) & (F.col("to") >= a)))
    if recalculated_after is not None:
        rows = rows.where(F.col("from") >= F.lit(recalculated_after).cast("timestamp"))
    return rows


def intervals_of(rows: DataFrame, table: str, span_ms: int, time: str = "time") -> DataFrame:
    """The changelog intervals that data points touch: ``table``, ``from``, ``to``, ``n_points``."""
    base = F.unix_millis(time) - F.pmod(F.unix_millis(time), F.lit(span_ms))
    got = rows.where(F.col(time).isNotNull()).groupBy(base.alias("_b")).agg(F.count(F.lit(1)).alias("n_points"))
    return got.select(F.lit(table).alias("table"), F.timestamp_millis("_b").alias("from"), F.timestamp_millis(F.col("_b") + span_ms).alias("to"), "n_points")
