"""Per-key aggregation as a tree, so that no reducer ever receives all partial states of a hot key."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.session import written

#: How two partial states of each kind become one.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
FOLD = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], chunk_rows: int = 1 << 17, fan_in: int = 32) -> DataFrame:
    """Aggregate by ``keys`` (null is a key) over a tree of partial states.

    ``aggs``: result name -> (kind, input column), kind one of count, sum, min, max. Leaves are chunks of ``chunk_rows``
    consecutive rows of one input partition, combined where they were read. Each round then merges up to ``fan_in``
    neighbouring states of a key, until one round covers all: log_fan_in(chunks) rounds, no merge step receiving more
    than ``fan_in`` states of any one key; the largest partition's rows are counted for that. Since every chunk lies in one partition, the leaves' states are complete
    after the map-side combine, and only they are shuffled. An empty input has no keys and gives no rows.
    """
    partitions = max(1, df.rdd.getNumPartitions())
    row = F.monotonically_increasing_id()  # partition << 33 | row in the partition
    per = 1 << max(0, 33 - int(math.log2(chunk_rows)))
    leaf = (F.shiftright(row, 33) * per + F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), int(math.log2(chunk_rows)))).alias("_node")
    state = df.select(*keys, leaf, *[c.alias(f"_in_{n}") for n, (_, c) in aggs.items()])
    state = state.groupBy(*keys, "_node").agg(*[FOLD[k](f"_in_{n}").alias(n) for n, (k, _) in aggs.items()])
    # a partition's chunks first, then partitions; ids are sparse, so the first rounds work on the chunks of a partition
    node, chunks = F.col("_node"), math.ceil(_largest_partition(df) / chunk_rows)
    while chunks > fan_in:
        state = _merge(state, keys, aggs, F.floor(node / per) * per + F.floor(node % per / fan_in))
        chunks = math.ceil(chunks / fan_in)
    state = _merge(state, keys, aggs, F.floor(node / per))
    while partitions > 1:
        state = _merge(state, keys, aggs, F.floor(F.col("_node") / fan_in))
        partitions = math.ceil(partitions / fan_in)
    return state.select(*keys, *aggs)


def _largest_partition(df: DataFrame) -> int:
    """Rows of the input partition that has the most."""
    return df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _merge(state: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], node: Column) -> DataFrame:
    return state.select(*keys, node.alias("_node"), *aggs).groupBy(*keys, "_node").agg(*[MERGE[k](n).alias(n) for n, (k, _) in aggs.items()])


#: The dimensions a few values dominate, and the amount of a row: by table.
SKEWED = {"kkm_items": (("kkm_id", "item"), "sum_cents"), "receipt": (("kkm_id",), "total_sum")}


def _by_value(df: DataFrame, dims: Sequence[str], aggs: Mapping[str, tuple[str, Column]], fan_in: int = 32) -> DataFrame:
    """``aggs`` for every value of each dimension, all from one scan: a row counts once under each dimension."""
    inputs = {f"_v_{n}": c for n, (_, c) in aggs.items()}
    pairs = F.array(*[F.struct(F.lit(d).alias("dim_name"), F.col(d).cast("string").alias("dim_value")) for d in dims])
    wide = df.select(F.explode(pairs).alias("_p"), *[c.alias(n) for n, c in inputs.items()]).select("_p.*", *inputs)
    return tree_aggregate(wide, ["dim_name", "dim_value"], {n: (k, F.col(f"_v_{n}")) for n, (k, _) in aggs.items()}, fan_in=fan_in)


def skewed_totals(tables: Mapping[str, DataFrame], fan_in: int = 32) -> DataFrame:
    """Row count, total amount and first and last time for every value of each skewed dimension, as written."""
    parts = []
    for name, (dims, amount) in SKEWED.items():
        aggs = {"n_rows": ("count", F.lit(1)), "total_cents": ("sum", F.col(amount)), "first_time": ("min", F.col("dp_time")), "last_time": ("max", F.col("dp_time"))}
        got = _by_value(tables[name], dims, aggs, fan_in)
        parts.append(got.select(F.lit(name).alias("table_name"), "dim_name", "dim_value", *aggs))
    return parts[0].unionAll(parts[1])


def heavy_values(tables: Mapping[str, DataFrame], share: float = 0.04) -> DataFrame:
    """Values that at least ``share`` of the table's stored rows hold; null is not a value but its rows are stored.

    The counts are written once; the tables' sizes are their sums, one row a table (two in all), which the join broadcasts.
    """
    parts = [_by_value(tables[name], dims, {"n_rows": ("count", F.lit(1))}).select(F.lit(name).alias("table_name"), "dim_name", "dim_value", "n_rows") for name, (dims, _) in SKEWED.items()]
    values = written(parts[0].unionAll(parts[1]), "value-counts")
    stored = values.where("dim_name = 'kkm_id'").groupBy("table_name").agg(F.sum("n_rows").alias("stored"))
    # in whole numbers: n * 10^6 >= share * 10^6 * stored
    enough = F.col("n_rows") * 1_000_000 >= F.col("stored") * round(share * 1_000_000)
    return values.where("dim_value IS NOT NULL").join(F.broadcast(stored), "table_name").where(enough).select("table_name", "dim_name", "dim_value")
