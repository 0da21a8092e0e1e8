"""Registered queries of the subpackage against their SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT, DATA = Path(__file__).resolve().parent.parent.parent, Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_results_equal_sql_on_the_smallest_tables(spark):
    import duckdb

    sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
    import __spark_entry__ as e
    import compare

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in ("p4_bounded", "p4_small_sets", "p6_certified", "p6_small_groups", "p8_complete"):
        assert compare.rows(e.queries()[name](spark, str(DATA)).toPandas()) == compare.rows(con.execute(e.oracle_sql()[name]).df()), name
