"""The test tables as time-series tables with links and rollups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake import types as S
from chronolake.operators.rolling import RECEIPT_KEY, in_force
from chronolake.schema import DAY_MS, Dimension, Link, Metric, Rollup, Schema, Table, phrase_link, related_link
from chronolake.session import table
from chronolake.sources.links import from_parquet, in_memory

PRIORITIES = [{"o_orderpriority": p, "rank": r, "group": g} for p, r, g in (("1-URGENT", 1, "Fast"), ("2-HIGH", 2, "Fast"), ("3-MEDIUM", 3, "Slow"), ("4-NOT SPECIFIED", 4, "Slow"))]

_RECEIPT_SUMS = {"total_sum": "sum(total_sum)", "cash_sum": "sum(cash_sum)", "card_sum": "sum(card_sum)", "positions_count": "sum(positions_count)"}
RECEIPT_ROLLUPS = (
    Rollup("receiptByDay", "receipt", ("receipt_by_day",), {"kkm_id": "kkm_id", "operation_type": "operation_type", **_RECEIPT_SUMS, "min_time": "min(time)", "max_time": "max(time)", "receipt_count": "count(1)"}, ("kkm_id", "operation_type"), "trunc_day(time)"),
    *[
        Rollup(f"receiptBy{u.capitalize()}", "receipt_by_day", (f"receipt_by_{u}",), {"kkm_id": "kkm_id", "operation_type": "operation_type", **_RECEIPT_SUMS, "min_time": "min(min_time)", "max_time": "max(max_time)", "receipt_count": "sum(receipt_count)"}, ("kkm_id", "operation_type"), f"trunc_{u}(time)")
        for u in ("week", "month")
    ],
    Rollup(
        "receiptByDayAllKkms", "receipt_by_day", ("receipt_by_day_all_kkms",),
        {"kkm_count": "distinct_count(kkm_id)", "total_sum": "sum(CASE WHEN operation_type = 1 OR operation_type = 4 THEN total_sum ELSE -total_sum)", "receipt_count": "sum(receipt_count)"}, (), "trunc_day(time)",
    ),
    Rollup("itemKkmsByMonth", "kkm_items", ("item_kkms_by_month",), {"item": "item", "kkm_id": "kkm_id", "operation_type": "operation_type", "sum_cents": "sum(sum_cents)", "item_count": "count(item)"}, ("item", "kkm_id", "operation_type"), "trunc_month(time)"),
)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data points of receipt in force; keys hold no nulls."""
    rows = table(spark, sf_dir, "receipt").dropna(subset=list(RECEIPT_KEY))
    return in_force(rows, RECEIPT_KEY, ("put_at", "row_id"), ("total_sum", "cash_sum", "card_sum", "positions_count", "operator_name"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def _device_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "kkm_link")
    return got.select("kkm_id", F.col("value_time").alias("time"), *[F.col("field_values")[k].alias(k) for k in ("region", "store_format")])


def catalog(sf_dir: str) -> Schema:
    """Tables sales, orders, events, receipt, kkm_items and the rollups' targets over one folder of test tables."""
    parts = from_parquet("Part", "l_partkey", {"name": S.VARCHAR, "brand": S.VARCHAR, "type": S.VARCHAR, "size": S.INTEGER}, f"{sf_dir}/part.parquet", {"l_partkey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"})
    suppliers = from_parquet("Supplier", "l_suppkey", {"name": S.VARCHAR, "nationkey": S.INTEGER}, f"{sf_dir}/supplier.parquet", {"l_suppkey": "s_suppkey", "name": "s_name", "nationkey": "s_nationkey"})
    customers = Link("Customer", "o_custkey", {f: S.VARCHAR for f in ("name", "segment", "nation", "region")}, partial(_customers, sf_dir=sf_dir))
    priorities = in_memory("Priority", "o_orderpriority", S.VARCHAR, {"rank": S.INTEGER, "group": S.VARCHAR}, PRIORITIES)
    devices = Link("Device", "kkm_id", {"region": S.VARCHAR, "store_format": S.VARCHAR}, partial(_device_values, sf_dir=sf_dir), time_sensitive=True)
    d = Dimension
    sums = [Metric(n, S.BIGINT) for n in ("total_sum", "cash_sum", "card_sum", "positions_count")]
    spans = [Metric("min_time", S.TIMESTAMP), Metric("max_time", S.TIMESTAMP), Metric("receipt_count", S.BIGINT)]
    by_device = [d("kkm_id", S.INTEGER), d("operation_type", S.TINYINT)]
    tables = [
        Table("sales", [d("l_partkey", S.BIGINT), d("l_suppkey", S.BIGINT), d("l_returnflag"), d("l_linestatus"), d("l_orderkey", S.BIGINT), d("l_linenumber", S.INTEGER)], [Metric(n, S.DOUBLE) for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], [parts, suppliers], time="l_shipdate"),
        Table("orders", [d("o_custkey", S.BIGINT), d("o_orderstatus"), d("o_orderpriority"), d("o_orderkey", S.BIGINT)], [Metric("o_totalprice", S.DOUBLE)], [customers, priorities], time="o_orderdate"),
        Table("events", [d("user_id", S.BIGINT), d("event_type"), d("event_id", S.BIGINT)], [Metric("value", S.DOUBLE), Metric("props", S.VARCHAR)], time="ts"),
        Table("receipt", [d("kkm_id", S.INTEGER), d("operation_type", S.TINYINT), d("shift", S.INTEGER)], [*sums, Metric("operator_name", S.VARCHAR), Metric("total", S.CURRENCY, "total_sum"), Metric("cash", S.CURRENCY, "cash_sum")], [devices], time="dp_time"),
        Table("kkm_items", [d("kkm_id", S.INTEGER), d("item"), d("operation_type", S.TINYINT), d("pos", S.SMALLINT)], [Metric("quantity", S.DOUBLE), Metric("sum_cents", S.BIGINT), Metric("sum", S.CURRENCY, "sum_cents"), Metric("measure", S.VARCHAR), Metric("document_number", S.BIGINT), Metric("customer_code", S.VARCHAR), Metric("row_id", S.BIGINT)], [phrase_link("item"), related_link("item", ("time", "kkm_id"))], time="dp_time"),
        *[Table(f"receipt_by_{u}", by_device, [*sums, *spans], span_ms=n * DAY_MS) for u, n in (("day", 30), ("week", 90), ("month", 365))],
        Table("receipt_by_day_all_kkms", [], [Metric("kkm_count", S.INTEGER), Metric("total_sum", S.BIGINT), Metric("receipt_count", S.BIGINT)], span_ms=365 * DAY_MS),
        Table("item_kkms_by_month", [d("item"), *by_device], [Metric("sum_cents", S.BIGINT), Metric("item_count", S.BIGINT)], span_ms=365 * DAY_MS),
    ]
    read = {"sales": "lineitem", "orders": "orders", "events": "events", "kkm_items": "kkm_items"}
    sources = {name: partial(_stored, path=f"{sf_dir}/{source}.parquet") for name, source in read.items()}
    sources["receipt"] = partial(_receipt, sf_dir=sf_dir)
    return Schema({t.name: t for t in tables}, sources, RECEIPT_ROLLUPS)
