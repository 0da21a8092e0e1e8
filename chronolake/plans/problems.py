"""Queries of the general data problems over the test tables, with the same results in SQL where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators import bitemporal, incremental, intervals, rolling, tree
from chronolake.session import shared_dir, table, temporary

Query = Callable[[SparkSession, str], DataFrame]


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling.receipt_rolling(table(spark, sf_dir, "receipt"))
    return r.select(F.col("entity").alias("kkm_id"), rolling.day_text(F.col("day")).alias("day_utc"), "total_7", F.round("avg_7", 4).alias("avg_7"), "total_30", F.round("avg_30", 4).alias("avg_30"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling.receipt_rolling(table(spark, sf_dir, "receipt"))
    return r.where((F.col("total_7") == 0) & (F.col("total_30") > 0)).select(F.col("entity").alias("kkm_id"), rolling.day_text(F.col("day")).alias("day_utc"))


def _skewed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("kkm_items", "receipt")}


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tree.skewed_totals(_skewed(spark, sf_dir))
    return got.withColumns({c: F.unix_millis(c) for c in ("first_time", "last_time")})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.heavy_values(_skewed(spark, sf_dir))


def p3_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bitemporal.receipt_attributes(table(spark, sf_dir, "receipt"), table(spark, sf_dir, "kkm_link"), ("field_values",))
    return got.select("row_id", "attr_id", *[F.col("field_values")[k].alias(k) for k in ("owner", "region", "store_format", "floor_area")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.receipt_attributes(table(spark, sf_dir, "receipt"), table(spark, sf_dir, "kkm_link"))


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, replayed in batches from an empty state of their own, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    taken = incremental.replay(incremental.ChangeState(spark, path), table(spark, sf_dir, "updates_intervals"), table(spark, sf_dir, "recalc_runs"))
    temporary(spark, path)
    return taken


def p5_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(spark, sf_dir).select("run_id", "entry_id", "current")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(spark, sf_dir).where("current").select("run_id", "entry_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.changelog_periods(table(spark, sf_dir, "updates_intervals"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: number of periods and gaps, milliseconds covered and not covered."""
    kinds = intervals.changelog_periods(table(spark, sf_dir, "updates_intervals"))
    length, period = F.col("to_ms") - F.col("from_ms"), F.col("kind") == "period"
    return kinds.groupBy("table_name").agg(F.count_if(period).alias("periods"), F.count_if(~period).alias("gaps"), F.sum(F.when(period, length).otherwise(0)).alias("covered_ms"), F.sum(F.when(~period, length).otherwise(0)).alias("open_ms"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_rolling, p1_found, p2_totals, p2_found, p3_attributes, p3_found, p5_taken, p5_found, p7_found, p7_coverage)}

_P1 = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY dp_time, kkm_id, operation_type, shift ORDER BY put_at DESC NULLS LAST, row_id DESC NULLS LAST) AS rn FROM receipt),
daily AS (SELECT kkm_id, CAST(dp_time AT TIME ZONE 'UTC' AS DATE) AS d, CAST(sum(coalesce(total_sum, 0)) AS BIGINT) AS total FROM ranked WHERE rn = 1 AND kkm_id IS NOT NULL AND dp_time IS NOT NULL GROUP BY ALL),
span AS (SELECT kkm_id, min(d) AS a, max(d) AS b FROM daily GROUP BY ALL),
cal AS (SELECT kkm_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
filled AS (SELECT c.kkm_id, c.d, coalesce(t.total, 0) AS total FROM cal c LEFT JOIN daily t ON t.kkm_id = c.kkm_id AND t.d = c.d),
roll AS (SELECT kkm_id, strftime(d, '%Y-%m-%d') AS day_utc,
  CAST(sum(total) OVER (PARTITION BY kkm_id ORDER BY d ROWS 6 PRECEDING) AS BIGINT) AS total_7,
  CAST(sum(total) OVER (PARTITION BY kkm_id ORDER BY d ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM filled)
"""

_P2 = """
WITH v AS (SELECT 'kkm_items' AS table_name, 'kkm_id' AS dim_name, CAST(kkm_id AS VARCHAR) AS dim_value, sum_cents AS amount, dp_time FROM kkm_items
UNION ALL SELECT 'kkm_items', 'item', item, sum_cents, dp_time FROM kkm_items
UNION ALL SELECT 'receipt', 'kkm_id', CAST(kkm_id AS VARCHAR), total_sum, dp_time FROM receipt)
"""

_P3 = """
SELECT r.row_id, l.attr_id, {fields} FROM receipt r JOIN kkm_link l ON l.kkm_id = r.kkm_id AND l.value_time <= r.dp_time AND l.known_at <= r.dp_time
WHERE l.attr_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY l.value_time DESC, l.known_at DESC, l.attr_id DESC) = 1
"""

_P5 = """
WITH firsts AS (SELECT * FROM updates_intervals WHERE landed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_name, from_ts, to_ts, updated_at, updated_by ORDER BY landed_at, entry_id) = 1),
given AS (SELECT f.*, r.run_id FROM firsts f JOIN recalc_runs r ON r.table_name = f.table_name AND r.run_status = 'SUCCEEDED' AND r.started_at >= f.landed_at AND (r.recalculated_after IS NULL OR r.recalculated_after <= f.from_ts)
QUALIFY row_number() OVER (PARTITION BY f.entry_id ORDER BY r.started_at, r.run_id) = 1),
ranked AS (SELECT run_id, entry_id, row_number() OVER (PARTITION BY run_id, from_ts, to_ts ORDER BY updated_at DESC NULLS LAST, entry_id DESC) = 1 AS current FROM given)
"""

_P7 = """
WITH ok AS (SELECT DISTINCT table_name, epoch_ms(from_ts) AS s, epoch_ms(to_ts) AS e FROM updates_intervals WHERE table_name IS NOT NULL AND from_ts < to_ts),
reach AS (SELECT *, max(e) OVER (PARTITION BY table_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY table_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
periods AS (SELECT table_name, island, min(s) AS f, max(e) AS t FROM marked GROUP BY ALL),
kinds AS (SELECT table_name, 'period' AS kind, f AS from_ms, t AS to_ms FROM periods
UNION ALL SELECT * FROM (SELECT table_name, 'gap' AS kind, lag(t) OVER (PARTITION BY table_name ORDER BY island) AS from_ms, f AS to_ms FROM periods) WHERE from_ms IS NOT NULL)
"""

SQL: dict[str, str] = {
    "p1_rolling": _P1 + "SELECT kkm_id, day_utc, total_7, round(total_7 / 7.0, 4) AS avg_7, total_30, round(total_30 / 30.0, 4) AS avg_30 FROM roll",
    "p1_found": _P1 + "SELECT kkm_id, day_utc FROM roll WHERE total_7 = 0 AND total_30 > 0",
    "p2_totals": _P2 + "SELECT table_name, dim_name, dim_value, count(*) AS n_rows, CAST(sum(amount) AS BIGINT) AS total_cents, epoch_ms(min(dp_time)) AS first_time, epoch_ms(max(dp_time)) AS last_time FROM v GROUP BY ALL",
    "p2_found": _P2 + "SELECT table_name, dim_name, dim_value FROM v GROUP BY ALL HAVING dim_value IS NOT NULL AND count(*) >= 0.04 * (CASE table_name WHEN 'receipt' THEN (SELECT count(*) FROM receipt) ELSE (SELECT count(*) FROM kkm_items) END)",
    "p3_attributes": _P3.format(fields=", ".join(f"l.field_values['{k}'] AS {k}" for k in ("owner", "region", "store_format", "floor_area"))),
    "p3_found": _P3.replace(", {fields}", ""),
    "p5_taken": _P5 + "SELECT run_id, entry_id, current FROM ranked",
    "p5_found": _P5 + "SELECT run_id, entry_id FROM ranked WHERE current",
    "p7_found": _P7 + "SELECT table_name, kind, from_ms, to_ms FROM kinds",
    "p7_coverage": _P7 + "SELECT table_name, count(*) FILTER (kind = 'period') AS periods, count(*) FILTER (kind = 'gap') AS gaps, CAST(coalesce(sum(to_ms - from_ms) FILTER (kind = 'period'), 0) AS BIGINT) AS covered_ms, CAST(coalesce(sum(to_ms - from_ms) FILTER (kind = 'gap'), 0) AS BIGINT) AS open_ms FROM kinds GROUP BY ALL",
}
