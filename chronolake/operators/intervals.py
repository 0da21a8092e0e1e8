"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.session import written

#: Starts in a slice, about.
SLICE_ROWS = 1_000_000


def islands(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Periods and gaps of the half-open intervals ``start`` to ``stop`` (epoch ms) of each ``entity``.

    Rows with a null bound or start >= stop are ignored; a null entity is an entity. Result: ``entity``, ``kind``
    ('period' or 'gap'), ``from_ms``, ``to_ms``; touching intervals form one period.
    Sort by start per entity, compare each start with the running maximum of the previous ends, number the islands
    cumulatively and aggregate. One entity may hold a third of all rows, and most of them in a short time, so the running
    values go in two levels: within (entity, slice), and over one summary row a slice, whose result is carried into the
    slice. Slices are ranges of (entity, start) of about ``slice_rows`` starts each, whatever their length in time; they
    are written once, since a range is not cut the same way twice. Equal starts are combined before.
    """
    df = df.where((F.col("start") < F.col("stop")) & F.col("start").isNotNull() & F.col("stop").isNotNull())
    slices = max(1, -(-df.count() // slice_rows))
    one = df.groupBy("entity", "start").agg(F.max("stop").alias("stop")).repartitionByRange(slices, "entity", "start")
    one = written(one.withColumn("slice", F.spark_partition_id()), "interval-slices")
    in_slice = Window.partitionBy("entity", "slice").orderBy("start")
    ends = F.max("stop").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))
    local = one.select("entity", "slice", "start", "stop", ends.alias("before"))
    by_slice = one.groupBy("entity", "slice").agg(F.max("stop").alias("stop"))
    over_slices = Window.partitionBy("entity").orderBy("slice")
    carry = by_slice.select(F.col("entity").alias("e"), F.col("slice").alias("s"), F.max("stop").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    marked = (
        local.join(carry, F.col("entity").eqNullSafe(F.col("e")) & (F.col("slice") == F.col("s")))
        .select("entity", "slice", "start", "stop", F.greatest("before", "carry").alias("reached"))  # greatest skips nulls
        .withColumn("opens", (F.col("reached").isNull() | (F.col("start") > F.col("reached"))).cast("int"))
        .withColumn("nth", F.sum("opens").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # islands opened in earlier slices, again one summary row a slice
    opened = marked.groupBy("entity", "slice").agg(F.sum("opens").alias("n"))
    offset = opened.select(F.col("entity").alias("e"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    labelled = marked.join(offset, F.col("entity").eqNullSafe(F.col("e")) & (F.col("slice") == F.col("s"))).withColumn("island", F.col("offset") + F.col("nth"))
    # the row that opens an island knows where the one before it ended, so gaps need no second look at the periods
    merged = labelled.groupBy("entity", "island").agg(F.min("start").alias("from_ms"), F.max("stop").alias("to_ms"), F.max(F.when(F.col("opens") == 1, F.col("reached"))).alias("gap_from"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_ms"), F.col("to_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("from_ms"), F.col("from_ms").alias("to_ms")),
    )
    return merged.select("entity", F.explode(kinds).alias("x")).where(F.col("x.from_ms").isNotNull()).select("entity", "x.kind", "x.from_ms", "x.to_ms")


def changelog_periods(updates: DataFrame) -> DataFrame:
    """Periods and gaps of the changelog of each table; entries without a table have none."""
    rows = updates.where(F.col("table_name").isNotNull()).select(F.col("table_name").alias("entity"), F.unix_millis("from_ts").alias("start"), F.unix_millis("to_ts").alias("stop"))
    return islands(rows).withColumnRenamed("entity", "table_name")
