"""Co-grouping two tables by key in groups of bounded size, whatever the keys' frequencies."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.session import written

#: Tables of hot keys up to so many rows are broadcast; larger ones are joined as Spark sees fit.
BROADCAST_KEYS = 100_000


def _spans(df: DataFrame, key: str, rows: int) -> tuple[int, DataFrame | None]:
    """Row count, and a table (_k, _parts) of the keys with more than half of ``rows`` rows: into how many parts to cut each.

    What comes to the driver are two numbers.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, hot = counts.agg(F.sum("n"), F.count_if(F.col("n") > rows // 2)).first()
    if not hot:
        return total or 0, None
    spans = written(counts.where(F.col("n") > rows // 2).select(F.col(key).alias("_k"), F.ceil(F.col("n") / rows).cast("bigint").alias("_parts")), "hot-keys")
    return total, F.broadcast(spans) if hot <= BROADCAST_KEYS else spans


def search_join(left: DataFrame, right: DataFrame, key: str, left_id: str, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows_per_group: int = 200_000) -> tuple[DataFrame, bool]:
    """Run ``search(left rows, right rows)`` for groups of keys; both sides have ``key`` under that name.

    A key with more than half of ``rows_per_group`` left rows forms groups of its own of at most about that many, cut by
    the hash of ``left_id``, and gets its right rows in each. All other keys are hashed into shards of half as many rows on
    average. A key with more right rows than half of that has its right rows cut too, and each of its left rows then
    meets all the slices one after another: the second value returned is true and the caller has to reduce to one
    answer per left row. So no group grows with the tables, only their number does. Rows with a null key take no part.
    """
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    (total, hot), (total_right, hot_right) = _spans(left, key, rows_per_group), _spans(right, key, rows_per_group)
    shards = 2 * max(2, math.ceil(max(total, total_right) / rows_per_group))
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("bigint")
    # groups of hot keys have negative numbers
    own = lambda part: -1 - F.shiftrightunsigned(F.xxhash64(F.col(key), part), 2)
    left, right = left.withColumns({"_g": shard, "_s": F.lit(0).cast("bigint")}), right.withColumns({"_g": shard, "_s": F.lit(0).cast("bigint")})
    if hot is not None:
        left = left.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_g", F.when(F.col("_parts").isNotNull(), own(F.pmod(F.xxhash64(left_id), F.col("_parts")))).otherwise(F.col("_g"))).drop("_k", "_parts")
        right = right.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        right = right.withColumn("_g", F.when(F.col("_parts").isNotNull(), own(F.col("_p"))).otherwise(F.col("_g"))).drop("_k", "_parts", "_p")
    if hot_right is not None:
        whole = [c for c in right.columns if not c.startswith("_") and right.schema[c].dataType.typeName() != "map"]
        right = right.join(hot_right, F.col(key) == F.col("_k"), "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(*whole), F.col("_parts")), F.lit(0))).drop("_k", "_parts")
        left = left.join(hot_right, F.col(key) == F.col("_k"), "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_k", "_parts")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a, b)

    got = left.groupBy("_g", "_s").cogroup(right.groupBy("_g", "_s")).applyInArrow(run, schema)
    return got, hot_right is not None
