"""Queries on sales over the whole table, beside those over one year of it."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from chronolake.plans import dialect_queries as d
from tools import compare

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_every_query_over_a_year_of_sales_also_runs_over_the_whole_table():
    cut = {n for n, (text, _) in d.TEXTS.items() if d._Y in text} - {"always_false"} | {"limited_count", "placeholders", "set_operations", "lag_no_group"}
    assert cut and {f"{n}_whole" for n in cut} <= set(e.queries()) & set(e.oracle_sql())


def test_no_row_of_lineitem_is_out_of_bounds(spark):
    stored = spark.read.parquet(str(DATA / "lineitem.parquet"))
    assert e.queries()["global_aggregate_whole"](spark, str(DATA)).first().n == stored.where("l_tax IS NOT NULL").count()
    assert e.queries()["link_lookup_whole"](spark, str(DATA)).count() == stored.count()
    assert e.queries()["lag_no_group_whole"](spark, str(DATA)).count() == spark.read.parquet(str(DATA / "events.parquet")).count()


def test_whole_tables_equal_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in ("downsample_day_whole", "link_lookup_whole", "set_operations_whole", "placeholders_whole", "lag_no_group_whole"):
        assert compare.rows(e.queries()[name](spark, str(DATA)).toPandas()) == compare.rows(con.execute(e.oracle_sql()[name]).df()), name
