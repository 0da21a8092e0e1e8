"""Queries of the dialect over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.dialect.parser import parse
from chronolake.engine import Engine
from chronolake.operators import ingest, links, rollup
from chronolake.plans.catalog import catalog
from chronolake.plans.select import Planner
from chronolake.session import table

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2025, 7, 1, tzinfo=UTC)


def comparable(df: DataFrame) -> DataFrame:
    """Times as text in milliseconds and decimals as rounded doubles, which every engine prints alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif f.dataType.typeName() == "decimal":
            c = F.round(c.cast("double"), 4)
        elif f.dataType.typeName() == "double":
            c = F.round(c, 4)
        out.append(c.alias(f.name))
    return df.select(*out)


def _dialect(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(Engine(spark, catalog(sf_dir), now=lambda: NOW).sql(text))

    run.__doc__ = text
    return run


#: name: (text in the dialect, SQL)
TEXTS: dict[str, tuple[str, str]] = {}

_Y = "time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1997-01-01'"
_L = "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'"
_EY = "time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-15'"
_EL = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-15'"
_OY = "time >= TIMESTAMP '1990-01-01' AND time < TIMESTAMP '2005-01-01'"
_OL = "o_orderdate >= TIMESTAMP '1990-01-01' AND o_orderdate < TIMESTAMP '2005-01-01'"
_WY = _OY
_WL = "l_shipdate >= TIMESTAMP '1990-01-01' AND l_shipdate < TIMESTAMP '2005-01-01'"
_RY = "time >= TIMESTAMP '2025-01-01' AND time < TIMESTAMP '2026-01-01'"
_T = "'%Y-%m-%d %H:%M:%S.%g'"
_RECEIPT = "(SELECT * FROM receipt WHERE dp_time IS NOT NULL AND kkm_id IS NOT NULL AND operation_type IS NOT NULL AND shift IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dp_time, kkm_id, operation_type, shift ORDER BY put_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)"


def _add(name: str, text: str, sql: str) -> None:
    TEXTS[name] = (text, sql)


_add("downsample_day", f"SELECT trunc_day(time) AS d, l_returnflag, sum(l_quantity) AS q, count(l_quantity) AS n FROM sales WHERE {_Y} GROUP BY d, l_returnflag", f"SELECT strftime(date_trunc('day', l_shipdate), {_T}) AS d, l_returnflag, round(sum(l_quantity), 4) AS q, count(l_quantity) AS n FROM lineitem WHERE {_L} GROUP BY ALL")
_add("scan_project", f"SELECT time AS t, l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_extendedprice FROM sales WHERE {_Y} AND l_discount = 0.05", f"SELECT strftime(l_shipdate, {_T}) AS t, l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_extendedprice FROM lineitem WHERE {_L} AND l_discount = 0.05")
_add("no_table", "SELECT 10 - 3 AS a, 'x' + 'y' AS s, length('abc') AS n WHERE 10 - 3 >= 5", "SELECT 7.0 AS a, 'xy' AS s, 3 AS n")
_add("no_table_false", "SELECT 1 AS a WHERE 10 - 3 <= 5", "SELECT 1.0 AS a WHERE false")
_add("always_false", f"SELECT l_orderkey FROM sales WHERE {_Y} AND 1 = 2", "SELECT l_orderkey FROM lineitem WHERE false")
_add("auto_names", f"SELECT sum(l_quantity), sum(l_quantity), max(l_tax) - min(l_tax), l_linestatus FROM sales WHERE {_Y} GROUP BY l_linestatus", f'SELECT round(sum(l_quantity), 4) AS "sum(l_quantity)", round(sum(l_quantity), 4) AS "sum(l_quantity)_2", round(max(l_tax) - min(l_tax), 4) AS "max(l_tax)_minus_min(l_tax)", l_linestatus FROM lineitem WHERE {_L} GROUP BY l_linestatus')
_add("names_any_case", f'SELECT sales.L_OrderKey AS k, "l_tax" AS x FROM sales WHERE {_Y} AND L_TAX > 0.07', f"SELECT l_orderkey AS k, l_tax AS x FROM lineitem WHERE {_L} AND l_tax > 0.07")
_add("nested_select", f"SELECT q AS total, l_returnflag AS flag FROM (SELECT sum(l_quantity) AS q, l_returnflag FROM sales WHERE {_Y} GROUP BY l_returnflag) s WHERE l_quantity > 10", f"SELECT round(sum(l_quantity), 4) AS total, l_returnflag AS flag FROM lineitem WHERE {_L} AND l_quantity > 10 GROUP BY l_returnflag")
_add("string_case", f"SELECT l_orderkey, l_linenumber, l_returnflag FROM sales WHERE {_Y} AND l_returnflag = 'r' AND l_linestatus IN ('o', 'F') AND l_quantity > 49", f"SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE {_L} AND lower(l_returnflag) = 'r' AND lower(l_linestatus) IN ('o', 'f') AND l_quantity > 49")
_add("not_equal", f"SELECT l_returnflag, count(l_tax) AS n FROM sales WHERE {_Y} AND l_returnflag <> 'A' AND l_linenumber != 1 GROUP BY l_returnflag", f"SELECT l_returnflag, count(l_tax) AS n FROM lineitem WHERE {_L} AND l_returnflag <> 'A' AND l_linenumber <> 1 GROUP BY ALL")
_add("order_comparisons", f"SELECT count(l_tax) AS n FROM sales WHERE {_Y} AND l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_tax < 0.08", f"SELECT count(l_tax) AS n FROM lineitem WHERE {_L} AND l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_tax < 0.08")
_add("between", f"SELECT l_orderkey, l_linenumber FROM sales WHERE time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-10' AND l_quantity BETWEEN 5 AND 8", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-10' AND l_quantity BETWEEN 5 AND 8")
_add("in_list", f"SELECT l_linenumber, count(l_tax) AS n FROM sales WHERE {_Y} AND l_linenumber IN (1, 3, 5) AND l_suppkey NOT IN (2, 4) GROUP BY l_linenumber", f"SELECT l_linenumber, count(l_tax) AS n FROM lineitem WHERE {_L} AND l_linenumber IN (1, 3, 5) AND l_suppkey NOT IN (2, 4) GROUP BY ALL")
_add("null_tests", f"SELECT count(kkm_id) AS n, count(customer_code) AS coded FROM kkm_items WHERE {_RY} AND measure IS NULL AND sum_cents IS NOT NULL", "SELECT count(kkm_id) AS n, count(customer_code) AS coded FROM kkm_items WHERE dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND measure IS NULL AND sum_cents IS NOT NULL")
_add("null_functions", f"SELECT is_null(customer_code) AS missing, is_not_null(measure) AS measured, count(kkm_id) AS n FROM kkm_items WHERE {_RY} GROUP BY missing, measured", "SELECT customer_code IS NULL AS missing, measure IS NOT NULL AS measured, count(kkm_id) AS n FROM kkm_items WHERE dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00' GROUP BY ALL")
_add("and_or_not", f"SELECT l_orderkey, l_linenumber FROM sales WHERE {_Y} AND (l_quantity > 48 OR l_discount = 0.1) AND not(l_tax > 0.02)", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_L} AND (l_quantity > 48 OR l_discount = 0.1) AND NOT (l_tax > 0.02)")
_add("or_time_ranges", "SELECT l_orderkey, l_linenumber FROM sales WHERE (time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1996-01-05') OR (time >= TIMESTAMP '1998-02-01' AND time < TIMESTAMP '1998-02-03' AND l_returnflag = 'N')", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-01-05') OR (l_shipdate >= TIMESTAMP '1998-02-01' AND l_shipdate < TIMESTAMP '1998-02-03' AND l_returnflag = 'N')")
_add("tuple_in", f"SELECT l_orderkey, l_linenumber, l_suppkey FROM sales WHERE {_Y} AND (l_linenumber, l_suppkey) IN ((1, 3), (2, 5), (4, 7))", f"SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE {_L} AND ((l_linenumber = 1 AND l_suppkey = 3) OR (l_linenumber = 2 AND l_suppkey = 5) OR (l_linenumber = 4 AND l_suppkey = 7))")
_add("tuple_not_in", f"SELECT l_linenumber, count(l_tax) AS n FROM sales WHERE {_Y} AND (l_linenumber, l_suppkey) NOT IN ((1, 3), (2, 5)) GROUP BY l_linenumber", f"SELECT l_linenumber, count(l_tax) AS n FROM lineitem WHERE {_L} AND NOT ((l_linenumber = 1 AND l_suppkey = 3) OR (l_linenumber = 2 AND l_suppkey = 5)) GROUP BY ALL")
_add("exact_time", "SELECT l_orderkey, l_linenumber FROM sales WHERE time IN (TIMESTAMP '1996-03-13', TIMESTAMP '1997-01-28', TIMESTAMP '1998-05-05')", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate IN (TIMESTAMP '1996-03-13', TIMESTAMP '1997-01-28', TIMESTAMP '1998-05-05')")
_add("case_when", f"SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' AS size, count(l_tax) AS n FROM sales WHERE {_Y} GROUP BY size", f"SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, count(l_tax) AS n FROM lineitem WHERE {_L} GROUP BY ALL")
_add("dim_id", f"SELECT id(user_id) AS hex_id, count(value) AS n FROM events WHERE {_EY} AND id(user_id) <> '0000000000000001' GROUP BY hex_id", f"SELECT printf('%016x', user_id) AS hex_id, count(value) AS n FROM events WHERE {_EL} AND user_id <> 1 GROUP BY ALL")
_add("dim_id_in", f"SELECT user_id, sum(value) AS v FROM events WHERE {_EY} AND id(user_id) IN ('0000000000000002', '0000000000000003') GROUP BY user_id", f"SELECT user_id, round(sum(value), 4) AS v FROM events WHERE {_EL} AND user_id IN (2, 3) GROUP BY ALL")
_add("group_keys_only", f"SELECT l_returnflag, l_linestatus FROM sales WHERE {_Y} GROUP BY l_returnflag, l_linestatus", f"SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE {_L}")
_add("group_key_hidden", f"SELECT sum(l_quantity) AS q FROM sales WHERE {_Y} GROUP BY l_suppkey", f"SELECT round(sum(l_quantity), 4) AS q FROM lineitem WHERE {_L} GROUP BY l_suppkey")
_add("global_aggregate", f"SELECT min(l_quantity) AS least, max(l_extendedprice) AS most, sum(l_linenumber) AS numbers, count(l_tax) AS n FROM sales WHERE {_Y}", f"SELECT min(l_quantity) AS least, max(l_extendedprice) AS most, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(l_tax) AS n FROM lineitem WHERE {_L}")
_add("global_aggregate_empty", "SELECT sum(l_quantity) AS q, count(l_quantity) AS n FROM sales WHERE time >= TIMESTAMP '1900-01-01' AND time < TIMESTAMP '1900-01-02'", "SELECT 0.0 AS q, 0 AS n WHERE false")
_add("min_max_types", f"SELECT event_type, min(time) AS t0, max(time) AS t1, min(props) AS p0, max(user_id) AS u1 FROM events WHERE {_EY} GROUP BY event_type", f"SELECT event_type, strftime(min(date_trunc('millisecond', ts)), {_T}) AS t0, strftime(max(date_trunc('millisecond', ts)), {_T}) AS t1, min(props) AS p0, max(user_id) AS u1 FROM events WHERE {_EL} GROUP BY ALL")
_add("average", f"SELECT l_returnflag, avg(l_quantity) AS q, avg(l_discount) AS d FROM sales WHERE {_Y} GROUP BY l_returnflag", f"SELECT l_returnflag, round(avg(l_quantity), 4) AS q, round(avg(l_discount), 4) AS d FROM lineitem WHERE {_L} GROUP BY ALL")
_add("distinct_count", f"SELECT l_returnflag, distinct_count(l_suppkey) AS s, distinct_count(l_partkey) AS p FROM sales WHERE {_Y} GROUP BY l_returnflag", f"SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS s, CAST(count(DISTINCT l_partkey) AS INTEGER) AS p FROM lineitem WHERE {_L} GROUP BY ALL")
_add("conditional_sum", f"SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0) AS returned, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity) AS kept FROM sales WHERE {_Y} GROUP BY l_linestatus", f"SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS returned, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END), 4) AS kept FROM lineitem WHERE {_L} GROUP BY ALL")
_add("aggregate_arithmetic", f"SELECT l_returnflag, sum(l_quantity) * max(l_tax) / 2 AS x, sum(l_extendedprice) - min(l_extendedprice) AS y FROM sales WHERE {_Y} GROUP BY l_returnflag", f"SELECT l_returnflag, round(sum(l_quantity) * max(l_tax) / 2, 4) AS x, round(sum(l_extendedprice) - min(l_extendedprice), 4) AS y FROM lineitem WHERE {_L} GROUP BY ALL")
_add("group_by_expression", f"SELECT l_partkey / 10 AS bucket, sum(l_quantity) AS q, sum(l_tax) AS t FROM sales WHERE {_Y} GROUP BY bucket", f"SELECT l_partkey // 10 AS bucket, round(sum(l_quantity), 4) AS q, round(sum(l_tax), 4) AS t FROM lineitem WHERE {_L} GROUP BY ALL")
_add("group_by_call", f"SELECT trunc_month(time) AS m, count(l_tax) AS n FROM sales WHERE {_Y} GROUP BY trunc_month(time)", f"SELECT strftime(date_trunc('month', l_shipdate), {_T}) AS m, count(l_tax) AS n FROM lineitem WHERE {_L} GROUP BY ALL")
_add("having_aggregate", f"SELECT l_suppkey, sum(l_quantity) AS q FROM sales WHERE {_Y} GROUP BY l_suppkey HAVING sum(l_quantity) > 500 AND count(l_tax) > 10", f"SELECT l_suppkey, round(sum(l_quantity), 4) AS q FROM lineitem WHERE {_L} GROUP BY ALL HAVING sum(l_quantity) > 500 AND count(l_tax) > 10")
_add("having_alias", f"SELECT l_suppkey, count(l_tax) AS n FROM sales WHERE {_Y} GROUP BY l_suppkey HAVING n >= 12", f"SELECT l_suppkey, count(l_tax) AS n FROM lineitem WHERE {_L} GROUP BY ALL HAVING count(l_tax) >= 12")
_add("null_group", f"SELECT measure, count(kkm_id) AS n, count(measure) AS m FROM kkm_items WHERE {_RY} GROUP BY measure", "SELECT measure, count(kkm_id) AS n, count(measure) AS m FROM kkm_items WHERE dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00' GROUP BY ALL")
_add("lag_by_user", f"SELECT user_id, event_id, time AS t, lag(time) AS before, lag(value) AS was FROM events WHERE {_EY} GROUP BY user_id", f"SELECT user_id, event_id, strftime(date_trunc('millisecond', ts), {_T}) AS t, strftime(lag(date_trunc('millisecond', ts)) OVER w, {_T}) AS before, round(lag(value) OVER w, 4) AS was FROM events WHERE {_EL} WINDOW w AS (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), user_id, event_type, event_id)")
_add("lag_gap", f"SELECT user_id, event_id, time - lag(time) AS gap FROM events WHERE {_EY} GROUP BY user_id HAVING time - lag(time) > INTERVAL '2' HOUR", f"SELECT * FROM (SELECT user_id, event_id, CAST(epoch_ms(date_trunc('millisecond', ts)) - lag(epoch_ms(date_trunc('millisecond', ts))) OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_type, event_id) AS BIGINT) AS gap FROM events WHERE {_EL}) WHERE gap > 7200000")
_add("lag_no_group", "SELECT event_id, lag(event_id) AS previous FROM events WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-03'", "SELECT event_id, lag(event_id) OVER (ORDER BY date_trunc('millisecond', ts), user_id, event_type, event_id) AS previous FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'")
_add("arithmetic", f"SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS a, l_quantity - 3 AS b, l_partkey * 2 AS c, -l_quantity AS d, abs(l_tax - 0.04) AS e FROM sales WHERE {_Y} AND l_linenumber = 1", f"SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_quantity + l_tax, 4) AS a, l_quantity - 3 AS b, l_partkey * 2 AS c, -l_quantity AS d, round(abs(l_tax - 0.04), 4) AS e FROM lineitem WHERE {_L} AND l_linenumber = 1")
_add("division", f"SELECT l_orderkey, l_linenumber, l_partkey / 7 AS whole, l_extendedprice / (l_tax + 0.013) AS unit, l_quantity / 4 AS quarter FROM sales WHERE {_Y} AND l_linenumber = 2", f"SELECT l_orderkey, l_linenumber, l_partkey // 7 AS whole, round(l_extendedprice / (l_tax + 0.013), 4) AS unit, round(l_quantity / 4, 4) AS quarter FROM lineitem WHERE {_L} AND l_linenumber = 2")
_add("currency", f"SELECT kkm_id, sum(total) AS t, sum(cash) * 2 AS c2, max(total) / 3 AS third FROM receipt WHERE {_RY} GROUP BY kkm_id", f"SELECT kkm_id, sum(total_sum) / 100.0 AS t, sum(cash_sum) * 2 / 100.0 AS c2, (max(total_sum) // 3) / 100.0 AS third FROM {_RECEIPT} GROUP BY kkm_id")
_add("currency_cast", f"SELECT kkm_id, operation_type, CAST(sum(total) AS BIGINT) AS units, CAST(sum(total) AS DOUBLE) AS d, CAST(max(shift) AS VARCHAR) AS s FROM receipt WHERE {_RY} GROUP BY kkm_id, operation_type", f"SELECT kkm_id, operation_type, CAST(trunc(sum(total_sum) / 100.0) AS BIGINT) AS units, round(sum(total_sum) / 100.0, 4) AS d, CAST(max(shift) AS VARCHAR) AS s FROM {_RECEIPT} GROUP BY kkm_id, operation_type")
_units = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_add("truncate_time", "SELECT event_id, " + ", ".join(f"trunc_{u}(time) AS t_{u}" for u in _units) + f" FROM events WHERE {_EY} AND event_type = 'purchase'", "SELECT event_id, " + ", ".join(f"strftime(CAST(date_trunc('{u}', ts) AS TIMESTAMP), {_T}) AS t_{u}" for u in _units) + f" FROM events WHERE {_EL} AND event_type = 'purchase'")
_add("truncate_time_short", "SELECT event_id, " + ", ".join(f"{u}(time) AS t_{u}" for u in _units) + f" FROM events WHERE {_EY} AND event_type = 'error'", "SELECT event_id, " + ", ".join(f"strftime(CAST(date_trunc('{u}', ts) AS TIMESTAMP), {_T}) AS t_{u}" for u in _units) + f" FROM events WHERE {_EL} AND event_type = 'error'")
_parts = ("year", "quarter", "month", "day", "hour", "minute", "second")
_add("extract_time", "SELECT event_id, " + ", ".join(f"extract_{u}(time) AS x_{u}" for u in _parts) + f" FROM events WHERE {_EY}", "SELECT event_id, " + ", ".join(f"CAST(extract('{u}' FROM ts) AS INTEGER) AS x_{u}" for u in _parts) + f" FROM events WHERE {_EL}")
_add("time_period", f"SELECT event_id, time + INTERVAL '1 12:00:00' AS later, time - INTERVAL '1-2' YEAR TO MONTH AS earlier, time + INTERVAL '90' MINUTE AS soon FROM events WHERE {_EY} AND event_type = 'signup'", f"SELECT event_id, strftime(date_trunc('millisecond', ts) + INTERVAL 36 HOUR, {_T}) AS later, strftime(date_trunc('millisecond', ts) - INTERVAL 14 MONTH, {_T}) AS earlier, strftime(date_trunc('millisecond', ts) + INTERVAL 90 MINUTE, {_T}) AS soon FROM events WHERE {_EL} AND event_type = 'signup'")
_add("now_function", "SELECT event_id, now() - time AS age FROM events WHERE time >= TIMESTAMP '2024-01-01' AND time < now() AND event_type = 'click'", "SELECT event_id, CAST(epoch_ms(TIMESTAMP '2025-07-01') - epoch_ms(date_trunc('millisecond', ts)) AS BIGINT) AS age FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-07-01' AND event_type = 'click'")
_add("strings", f"SELECT event_id, lower(event_type) AS lo, upper(event_type) AS up, length(event_type) AS n, event_type + '!' AS cat FROM events WHERE {_EY}", f"SELECT event_id, lower(event_type) AS lo, upper(event_type) AS up, CAST(length(event_type) AS INTEGER) AS n, event_type || '!' AS cat FROM events WHERE {_EL}")
_add("split_words", f"SELECT row_id, length(split(item)) AS n, array_to_string(split(item)) AS words FROM kkm_items WHERE {_RY} AND pos = 1", "SELECT row_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ', ') AS words FROM (SELECT row_id, CASE WHEN len(w) > 0 AND w[-1] = '' THEN w[:-2] ELSE w END AS w FROM (SELECT row_id, regexp_split_to_array(item, '[^\\p{L}\\p{Nd}]+') AS w FROM kkm_items WHERE pos = 1 AND dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00'))")
_add("array_tests", f"SELECT row_id, contains(split(item), 'rice') AS one, contains_any(split(item), {{'rice', 'apple'}}) AS some, contains_all(split(item), {{'plain', 'rice'}}) AS every, contains_same(split(item), {{'rice', 'plain'}}) AS same FROM kkm_items WHERE {_RY} AND pos = 2 AND item IS NOT NULL", "SELECT row_id, list_contains(w, 'rice') AS one, list_has_any(w, ['rice', 'apple']) AS some, list_has_all(w, ['plain', 'rice']) AS every, len(w) = 2 AND list_has_all(w, ['plain', 'rice']) AS same FROM (SELECT row_id, CASE WHEN len(w) > 0 AND w[-1] = '' THEN w[:-2] ELSE w END AS w FROM (SELECT row_id, regexp_split_to_array(item, '[^\\p{L}\\p{Nd}]+') AS w FROM kkm_items WHERE pos = 2 AND item IS NOT NULL AND dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00'))")
_add("casts", f"SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST(l_quantity AS BIGINT) AS c, CAST(l_orderkey AS VARCHAR) AS d FROM sales WHERE {_Y} AND l_linenumber = 3", f"SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST(trunc(l_quantity) AS BIGINT) AS c, CAST(l_orderkey AS VARCHAR) AS d FROM lineitem WHERE {_L} AND l_linenumber = 3")
_add("link_lookup", f"SELECT l_orderkey, l_linenumber, Part_brand AS brand, Part_size AS size, Supplier_name AS supplier FROM sales WHERE {_Y}", f"SELECT l_orderkey, l_linenumber, p_brand AS brand, p_size AS size, s_name AS supplier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE {_L}")
_add("link_group", f"SELECT Customer_region AS region, Customer_segment AS segment, sum(o_totalprice) AS total, count(o_orderkey) AS n FROM orders WHERE {_OY} GROUP BY region, segment", f"SELECT r_name AS region, c_mktsegment AS segment, round(sum(o_totalprice), 4) AS total, count(o_orderkey) AS n FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON c_custkey = o_custkey WHERE {_OL} GROUP BY ALL")
_add("link_semi", f"SELECT o_orderkey FROM orders WHERE {_OY} AND Customer_segment = 'building' AND Customer_region IN ('EUROPE', 'asia')", f"SELECT o_orderkey FROM orders WHERE {_OL} AND o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(c_mktsegment) = 'building' AND lower(r_name) IN ('europe', 'asia'))")
_add("link_anti", f"SELECT o_orderkey FROM orders WHERE {_OY} AND Customer_segment <> 'BUILDING' AND Customer_region NOT IN ('EUROPE')", f"SELECT o_orderkey FROM orders WHERE {_OL} AND o_custkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' OR r_name = 'EUROPE')")
_add("link_or", f"SELECT o_orderkey FROM orders WHERE {_OY} AND (Customer_segment = 'BUILDING' OR o_totalprice > 300000)", f"SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE {_OL} AND (lower(c_mktsegment) = 'building' OR o_totalprice > 300000)")
_add("link_in_memory", f"SELECT Priority_group AS grp, Priority_rank AS rnk, count(o_orderkey) AS n FROM orders WHERE {_OY} GROUP BY grp, rnk", f"SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Fast' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Slow' END AS grp, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS rnk, count(o_orderkey) AS n FROM orders WHERE {_OL} GROUP BY ALL")
_add("link_as_of", f"SELECT Device_region AS region, Device_store_format AS format, count(total_sum) AS n, sum(total_sum) AS s FROM receipt WHERE {_RY} GROUP BY region, format", f"""WITH links AS (SELECT kkm_id, value_time, struct_pack(region := field_values['region'], store_format := field_values['store_format']) AS v FROM kkm_link WHERE kkm_id IS NOT NULL AND value_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kkm_id, value_time ORDER BY field_values['region'] DESC NULLS LAST, field_values['store_format'] DESC NULLS LAST) = 1),
firsts AS (SELECT kkm_id, arg_min(v, value_time) AS v FROM links GROUP BY ALL),
got AS (SELECT r.*, coalesce(l.v, f.v) AS v FROM {_RECEIPT} r ASOF LEFT JOIN links l ON l.kkm_id = r.kkm_id AND l.value_time <= r.dp_time LEFT JOIN firsts f ON f.kkm_id = r.kkm_id)
SELECT v.region AS region, v.store_format AS format, count(total_sum) AS n, CAST(sum(total_sum) AS BIGINT) AS s FROM got GROUP BY ALL""")

_KL = "dp_time >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND dp_time < TIMESTAMPTZ '2026-01-01 00:00:00+00'"


def _word(word: str, whole: bool = True, item: str = "item") -> str:
    """Whether an item has a word: letters that neither a letter precedes nor, for a whole word, follows."""
    tail = "($|[^a-zа-яё])" if whole else ""
    return f"regexp_matches(lower({item}), '(^|[^a-zа-яё]){word}{tail}')"


_add("phrase_link", f"SELECT row_id FROM kkm_items WHERE {_RY} AND ItemsInvertedIndex_phrase IN ('rice', 'apple white') AND ItemsInvertedIndex_phrase <> 'plain'", f"SELECT row_id FROM kkm_items WHERE {_KL} AND ({_word('rice')} OR ({_word('apple')} AND {_word('white')})) AND NOT {_word('plain')}")
_add("phrase_link_prefix", f"SELECT row_id, item FROM kkm_items WHERE {_RY} AND ItemsInvertedIndex_phrase = 'noo% sweet'", f"SELECT row_id, item FROM kkm_items WHERE {_KL} AND {_word('noo', False)} AND {_word('sweet')}")
_add("related_link", f"SELECT row_id FROM kkm_items WHERE {_RY} AND RelatedItemsCatalog_phrase = 'rice' AND pos = 1", f"SELECT row_id FROM kkm_items k WHERE {_KL} AND pos = 1 AND EXISTS (SELECT 1 FROM kkm_items m WHERE m.dp_time = k.dp_time AND m.kkm_id = k.kkm_id AND {_word('rice', item='m.item')})")
_add("unrelated_link", f"SELECT row_id FROM kkm_items WHERE {_RY} AND RelatedItemsCatalog_item NOT IN ('Delivery fee', 'carrier bag small')", f"SELECT row_id FROM kkm_items k WHERE {_KL} AND NOT EXISTS (SELECT 1 FROM kkm_items m WHERE m.dp_time = k.dp_time AND m.kkm_id = k.kkm_id AND lower(m.item) IN ('delivery fee', 'carrier bag small'))")

# the queries over a year of sales again, over bounds that hold all of l_shipdate
for _name, (_text, _sql) in list(TEXTS.items()):
    if _Y in _text and _name != "always_false":
        _add(f"{_name}_whole", _text.replace(_Y, _WY), _sql.replace(_L, _WL))
_add("lag_no_group_whole", f"SELECT event_id, lag(event_id) AS previous FROM events WHERE {_EY}", f"SELECT event_id, lag(event_id) OVER (ORDER BY date_trunc('millisecond', ts), user_id, event_type, event_id) AS previous FROM events WHERE {_EL}")

QUERIES: dict[str, Query] = {name: _dialect(text) for name, (text, _) in TEXTS.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in TEXTS.items()}


# queries that take more than one statement of the dialect


def _limited_count(spark: SparkSession, sf_dir: str, bounds: str) -> DataFrame:
    got = _dialect(f"SELECT l_suppkey, count(l_tax) AS n FROM sales WHERE {bounds} GROUP BY l_suppkey HAVING n > 0 LIMIT 5")(spark, sf_dir)
    return got.agg(F.count(F.lit(1)).alias("n"))


def limited_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT after HAVING: any five of the groups, so only their number is fixed."""
    return _limited_count(spark, sf_dir, _Y)


def limited_count_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited_count(spark, sf_dir, _WY)


_PLACEHOLDERS = "SELECT l_orderkey, l_linenumber FROM sales WHERE time >= ? AND time < ? AND l_returnflag = ? AND l_linenumber IN (?, ?)"


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = [datetime(1996, 1, 1), datetime(1996, 2, 1), "R", 1, 2]
    return comparable(Engine(spark, catalog(sf_dir)).sql(_PLACEHOLDERS, params))


def placeholders_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = [datetime(1990, 1, 1), datetime(2005, 1, 1), "R", 1, 2]
    return comparable(Engine(spark, catalog(sf_dir)).sql(_PLACEHOLDERS, params))


def hll_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types with their exact number of users, as far as hll_count is within five standard errors of it, for several errors."""
    got = _dialect(f"SELECT event_type, hll_count(user_id, 0.05) AS a, hll_count(user_id, 0.02) AS b, hll_count(user_id, 0.004) AS c, hll_count(user_id, 0.0005) AS d, distinct_count(user_id) AS n FROM events WHERE {_EY} GROUP BY event_type")(spark, sf_dir)
    for name, error in (("a", 0.05), ("b", 0.02), ("c", 0.004), ("d", 0.0)):
        got = got.where(F.abs(F.col(name) - F.col("n")) <= 5 * error * F.col("n"))
    return got.select("event_type", "n")


def random_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct_random gives a member of the set."""
    got = _dialect(f"SELECT event_type, distinct_random(user_id) AS u FROM events WHERE {_EY} GROUP BY event_type")(spark, sf_dir)
    members = table(spark, sf_dir, "events").select(F.col("event_type").alias("e"), F.col("user_id").alias("m")).distinct()
    return got.join(members, (F.col("event_type") == F.col("e")) & (F.col("u") == F.col("m")), "left_semi").select("event_type")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items hold each token."""
    items = table(spark, sf_dir, "kkm_items").where("item IS NOT NULL")
    return links.inverted_index(items, "item").groupBy("token").agg(F.count(F.lit(1)).alias("items"))


def tokens_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens() of event types, which are single words that no rule changes."""
    return _dialect(f"SELECT event_type, array_to_string(tokens(event_type)) AS t FROM events WHERE {_EY} GROUP BY event_type, t")(spark, sf_dir)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose item has the word rice with a word that begins with pl, or the word apple, but not white."""
    rows = table(spark, sf_dir, "kkm_items").select("row_id", "item")
    return links.filter_phrases(rows, "item", include=[["rice pl%", "apple"]], exclude=["white"]).select("row_id")


def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share time and device with a row of item 'plain rice' or longer names that begin so."""
    rows = table(spark, sf_dir, "kkm_items").select("row_id", "dp_time", "kkm_id", "item")
    return links.related(rows, rows.where(F.lower("item").startswith("plain rice")), ["dp_time", "kkm_id"]).select("row_id")


def unrelated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kkm_items").select("row_id", "dp_time", "kkm_id", "item")
    return links.related(rows, rows.where(F.lower("item").startswith("plain")), ["dp_time", "kkm_id"], exclude=True).select("row_id")


def _set_operations(spark: SparkSession, sf_dir: str, bounds: str) -> DataFrame:
    e = Engine(spark, catalog(sf_dir))
    high = e.sql(f"SELECT l_partkey FROM sales WHERE {bounds} AND l_discount >= 0.09 GROUP BY l_partkey")
    small = e.sql(f"SELECT l_partkey FROM sales WHERE {bounds} AND l_quantity <= 3 GROUP BY l_partkey")
    return high.unionAll(small).distinct().subtract(high.intersect(small))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts sold with a high discount or in small lots, without those sold both ways."""
    return _set_operations(spark, sf_dir, _Y)


def set_operations_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_operations(spark, sf_dir, _WY)


def changelog_of_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the changelog that a put of all events touches."""
    return comparable(ingest.intervals_of(table(spark, sf_dir, "events").select(F.col("ts").alias("time")), "events", 86_400_000))


def upsert_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated puts of a key the last one stays."""
    rows = table(spark, sf_dir, "receipt").select("dp_time", "kkm_id", "operation_type", "shift", "total_sum", "put_at", "row_id")
    return ingest.latest(rows, ["dp_time", "kkm_id", "operation_type", "shift"], ["put_at", "row_id"]).select("row_id", "total_sum")


def changelog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW UPDATES_INTERVALS by user and time over the changelog's test table."""
    rows = table(spark, sf_dir, "updates_intervals").select(F.col("table_name").alias("table"), "updated_at", F.col("from_ts").alias("from"), F.col("to_ts").alias("to"), "updated_by")
    bounds = (datetime(2025, 2, 1, tzinfo=UTC), datetime(2025, 4, 1, tzinfo=UTC))
    got = ingest.filter_changelog(ingest.latest_intervals(rows), updated_by="etl", updated=bounds, recalculated_after=datetime(2024, 1, 1, tzinfo=UTC))
    return comparable(got)


def show_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).sql("SHOW COLUMNS FROM orders").select("COLUMN_NAME", "TYPE_NAME", "IS_NULLABLE")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).sql("SHOW TABLES").select("TABLE_NAME", "TABLE_TYPE")


def show_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).sql("SHOW FUNCTIONS FOR VARCHAR")


def _all_time(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The rollup over all times; one that re-aggregates days is computed from the days' rollup."""
        schema = catalog(sf_dir)
        by_name = {r.name: r for r in schema.rollups}
        r = by_name[name]
        start, stop = datetime(2000, 1, 1, tzinfo=UTC), datetime(2100, 1, 1, tzinfo=UTC)
        if r.source == "receipt_by_day":
            days = rollup.compute(spark, schema, by_name["receiptByDay"], start, stop)
            schema = replace(schema, sources={**schema.sources, "receipt_by_day": lambda _: days})
        return comparable(rollup.compute(spark, schema, r, start, stop))

    return run


QUERIES |= {f.__name__: f for f in (limited_count, limited_count_whole, placeholders, placeholders_whole, hll_within_error, random_member, token_counts, tokens_plain, phrase_search, related_items, unrelated_items, set_operations, set_operations_whole, changelog_of_put, upsert_in_force, changelog_filtered, show_columns, show_tables, show_functions)}
QUERIES |= {f"rollup_{n}": _all_time(r) for n, r in (("by_day", "receiptByDay"), ("by_week", "receiptByWeek"), ("by_month", "receiptByMonth"), ("all_devices", "receiptByDayAllKkms"), ("item_months", "itemKkmsByMonth"))}


def _rollup_sql(unit: str) -> str:
    return (
        f"SELECT strftime(CAST(date_trunc('{unit}', dp_time AT TIME ZONE 'UTC') AS TIMESTAMP), {_T}) AS time, kkm_id, operation_type, CAST(sum(total_sum) AS BIGINT) AS total_sum, CAST(sum(cash_sum) AS BIGINT) AS cash_sum, CAST(sum(card_sum) AS BIGINT) AS card_sum, "
        f"CAST(sum(positions_count) AS BIGINT) AS positions_count, strftime(min(dp_time AT TIME ZONE 'UTC'), {_T}) AS min_time, strftime(max(dp_time AT TIME ZONE 'UTC'), {_T}) AS max_time, count(*) AS receipt_count FROM {_RECEIPT} GROUP BY 1, 2, 3"
    )


SQL |= {
    "limited_count": "SELECT 5 AS n",
    "placeholders": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_returnflag = 'R' AND l_linenumber IN (1, 2)",
    "hll_within_error": f"SELECT event_type, CAST(count(DISTINCT user_id) AS INTEGER) AS n FROM events WHERE {_EL} GROUP BY ALL",
    "random_member": f"SELECT DISTINCT event_type FROM events WHERE {_EL}",
    "tokens_plain": f"SELECT DISTINCT event_type, event_type AS t FROM events WHERE {_EL}",
    "phrase_search": f"SELECT row_id FROM kkm_items WHERE (({_word('rice')} AND {_word('pl', False)}) OR {_word('apple')}) AND NOT {_word('white')}",
    "related_items": "SELECT row_id FROM kkm_items k WHERE EXISTS (SELECT 1 FROM kkm_items m WHERE m.dp_time = k.dp_time AND m.kkm_id = k.kkm_id AND starts_with(lower(m.item), 'plain rice'))",
    "unrelated_items": "SELECT row_id FROM kkm_items k WHERE NOT EXISTS (SELECT 1 FROM kkm_items m WHERE m.dp_time = k.dp_time AND m.kkm_id = k.kkm_id AND starts_with(lower(m.item), 'plain'))",
    "set_operations": f"WITH h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE {_L} AND l_discount >= 0.09), s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE {_L} AND l_quantity <= 3) SELECT l_partkey FROM h WHERE l_partkey NOT IN (SELECT * FROM s) UNION SELECT l_partkey FROM s WHERE l_partkey NOT IN (SELECT * FROM h)",
    "changelog_of_put": f"SELECT 'events' AS \"table\", strftime(date_trunc('day', ts)::TIMESTAMP, {_T}) AS \"from\", strftime(date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY, {_T}) AS \"to\", count(*) AS n_points FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "upsert_in_force": "SELECT row_id, total_sum FROM receipt QUALIFY row_number() OVER (PARTITION BY dp_time, kkm_id, operation_type, shift ORDER BY put_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1",
    "changelog_filtered": f"SELECT table_name AS \"table\", strftime(updated_at AT TIME ZONE 'UTC', {_T}) AS updated_at, strftime(from_ts AT TIME ZONE 'UTC', {_T}) AS \"from\", strftime(to_ts AT TIME ZONE 'UTC', {_T}) AS \"to\", updated_by FROM (SELECT * FROM updates_intervals QUALIFY row_number() OVER (PARTITION BY table_name, from_ts, to_ts ORDER BY updated_at DESC NULLS LAST, updated_by DESC NULLS LAST) = 1) WHERE updated_by = 'etl' AND updated_at BETWEEN TIMESTAMPTZ '2025-02-01 00:00:00+00' AND TIMESTAMPTZ '2025-04-01 00:00:00+00' AND from_ts >= TIMESTAMPTZ '2024-01-01 00:00:00+00'",
    "show_columns": "SELECT * FROM (VALUES ('o_totalprice', 'DOUBLE', 'YES'), ('time', 'TIMESTAMP', 'YES'), ('o_custkey', 'BIGINT', 'NO'), ('o_orderstatus', 'VARCHAR', 'NO'), ('o_orderpriority', 'VARCHAR', 'NO'), ('o_orderkey', 'BIGINT', 'NO'), ('Customer_name', 'VARCHAR', ''), ('Customer_segment', 'VARCHAR', ''), ('Customer_nation', 'VARCHAR', ''), ('Customer_region', 'VARCHAR', ''), ('Priority_rank', 'INTEGER', ''), ('Priority_group', 'VARCHAR', '')) t(COLUMN_NAME, TYPE_NAME, IS_NULLABLE)",
    "show_tables": "SELECT * FROM (VALUES ('sales', 'TABLE'), ('orders', 'TABLE'), ('events', 'TABLE'), ('receipt', 'TABLE'), ('kkm_items', 'TABLE'), ('receipt_by_day', 'ROLLUP'), ('receipt_by_week', 'ROLLUP'), ('receipt_by_month', 'ROLLUP'), ('receipt_by_day_all_kkms', 'ROLLUP'), ('item_kkms_by_month', 'ROLLUP')) t(TABLE_NAME, TABLE_TYPE)",
    "show_functions": "SELECT unnest(['count', 'distinct_count', 'distinct_random', 'is_not_null', 'is_null', 'lag', 'length', 'lower', 'max', 'min', 'split', 'tokens', 'upper']) AS NAME",
    "rollup_by_day": _rollup_sql("day"),
    "rollup_by_week": _rollup_sql("week"),
    "rollup_by_month": _rollup_sql("month"),
    "rollup_all_devices": f"SELECT strftime(CAST(date_trunc('day', dp_time AT TIME ZONE 'UTC') AS TIMESTAMP), {_T}) AS time, CAST(count(DISTINCT kkm_id) AS INTEGER) AS kkm_count, CAST(sum(CASE WHEN operation_type IN (1, 4) THEN total_sum ELSE -total_sum END) AS BIGINT) AS total_sum, count(*) AS receipt_count FROM {_RECEIPT} GROUP BY 1",
    "rollup_item_months": f"SELECT strftime(CAST(date_trunc('month', dp_time AT TIME ZONE 'UTC') AS TIMESTAMP), {_T}) AS time, item, kkm_id, operation_type, CAST(sum(sum_cents) AS BIGINT) AS sum_cents, count(item) AS item_count FROM kkm_items WHERE dp_time >= TIMESTAMPTZ '2000-01-01 00:00:00+00' GROUP BY 1, 2, 3, 4",
}

SQL |= {
    "limited_count_whole": SQL["limited_count"],
    "placeholders_whole": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_WL} AND l_returnflag = 'R' AND l_linenumber IN (1, 2)",
    "set_operations_whole": SQL["set_operations"].replace(_L, _WL),
}
