"""The driver's contract, with and without the optional subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 7)} <= set(e.queries())


def test_nothing_else_needs_the_optional_subpackage():
    for path in (ROOT / "chronolake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "chronolake.llm" not in path.read_text(), path
    code = "import sys; sys.modules['chronolake.llm'] = None\nimport __spark_entry__ as e; assert e.llm is None and 'p1_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_runs(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_results_equal_sql_on_the_smallest_tables(spark):
    import duckdb

    sys.path.insert(0, str(ROOT / "tools"))
    compare = importlib.import_module("compare")
    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in ("p1_found", "p2_found", "p3_found", "p5_found", "p7_found", "downsample_day", "link_as_of", "lag_by_user", "rollup_all_devices", "set_operations", "put_twice", "put_changelog", "stream_ingest", "resumed_scan", "link_jdbc", "link_declared", "phrase_stored", "users", "permissions", "query_log", "rejected", "tokens_stemmed", "converters"):
        assert compare.rows(e.queries()[name](spark, str(DATA)).toPandas()) == compare.rows(con.execute(e.oracle_sql()[name]).df()), name
