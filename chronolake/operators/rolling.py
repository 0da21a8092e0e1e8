"""Totals over trailing periods for every entity and calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.session import written


def in_force(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The one row in force for each key: the greatest by ``order`` (nulls lowest); null keys are keys.

    A max over a struct combines on the map side, so repeated puts of a hot key shrink before the shuffle.
    """
    top = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]))
    return df.groupBy(*key).agg(top.alias("_top")).select(*key, *[F.col(f"_top.k{i}").alias(c) for i, c in enumerate(keep)])


def daily_totals(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Columns ``entity``, ``day`` (days since 1970-01-01, UTC) and ``total``; rows without entity or time have no day."""
    return (
        df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(time).cast("date")).alias("day"))
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0).cast("bigint"))).alias("total"))
    )


def rolling_totals(daily: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Totals and averages over the last n days for each n of ``periods``, days without activity included.

    ``daily`` has ``entity``, ``day``, ``total`` (one row a pair). The result has one row for every entity and day from
    its first to its last: ``entity``, ``day``, ``total_n`` and ``avg_n`` (the total over n calendar days).
    Each calendar day is range-joined with the daily totals inside its trailing bounds. Days fall in buckets as wide as
    the longest period, so a total can only matter to its own bucket and the next one: it is sent to just these two and
    the join is an equi-join on (entity, bucket) with the bounds left over. A bucket of one entity holds at most
    2 x width totals however hot the entity is, and the aggregation reuses the join's partitioning.
    """
    width = max(periods)
    bucket = F.floor(F.col("day") / width).cast("int")
    span = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    # first by coarse bucket, then by day: a long-lived entity's calendar is spread before it is unrolled
    calendar = (
        span.select("entity", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width).cast("int"), F.floor(F.col("last") / width).cast("int"))).alias("bucket"))
        .select("entity", "bucket", F.explode(F.sequence(F.greatest("first", F.col("bucket") * width), F.least("last", F.col("bucket") * width + (width - 1)))).alias("day"))
    )
    reach = daily.select(F.col("entity").alias("e"), F.explode(F.array(bucket, bucket + 1)).alias("b"), F.col("day").alias("d"), "total")
    age = F.col("day") - F.col("d")
    joined = calendar.join(reach, (F.col("entity") == F.col("e")) & (F.col("bucket") == F.col("b")) & (F.col("d") <= F.col("day")) & (F.col("d") > F.col("day") - width), "left")
    totals = [F.coalesce(F.sum(F.when(age < n, F.col("total"))), F.lit(0)).cast("bigint").alias(f"total_{n}") for n in periods]
    out = joined.groupBy("entity", "bucket", "day").agg(*totals)
    return out.select("entity", "day", *[c for n in periods for c in (F.col(f"total_{n}"), (F.col(f"total_{n}") / F.lit(float(n))).alias(f"avg_{n}"))])


def day_text(day: Column) -> Column:
    """Days since 1970-01-01 as YYYY-MM-DD."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


RECEIPT_KEY = ("dp_time", "kkm_id", "operation_type", "shift")


def receipt_rolling(receipt: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals of total_sum for each device, over the data points in force; null sums count as 0."""
    points = in_force(receipt, RECEIPT_KEY, ("put_at", "row_id"), ("total_sum",))
    # both the calendar and the join read the days, which are made once
    return rolling_totals(written(daily_totals(points, "kkm_id", "dp_time", "total_sum"), "daily-totals"), periods)
