"""Queries whose executors are processes of their own."""

import subprocess
import sys
from pathlib import Path

import pytest

from chronolake.plans.statement_queries import _database

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")

RUN = """
import sys
import duckdb
from pyspark.sql import SparkSession
root, data, shared, name = sys.argv[1:]
sys.path[:0] = [root, root + "/tools"]
import __spark_entry__ as e
import compare
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + shared).config("spark.driver.host", "127.0.0.1").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
con = duckdb.connect()
con.execute("SET TimeZone = 'UTC'")
for t in ("lineitem", "orders", "part"):
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
got, wanted = compare.rows(e.queries()[name](spark, data).toPandas()), compare.rows(con.execute(e.oracle_sql()[name]).df())
assert len(wanted) and got == wanted, (got, wanted)
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["link_declared", "link_jdbc"])
def test_a_database_is_seen_from_other_processes(name, tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(ROOT), str(DATA), str(tmp_path / "shared"), name], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_database_holds_the_rows_as_they_are(spark, rows):
    given = [(1, "plain", None), (2, "", " lead"), (3, 'q"uo,te', "tail "), (4, "new\nline", "c\r\nr"), (5, None, "ünï漢"), (6, "back\\slash", "\\"), (7, '""', "\t"), (8, " ", ","), (9, None, None)]
    df = spark.createDataFrame(given, "k bigint, a string, b string").repartition(12)
    assert rows(spark.read.jdbc(_database(spark, "kept", df), "kept")) == sorted(given, key=repr)
    assert rows(spark.read.jdbc(_database(spark, "nothing", df.where("k < 0")), "nothing")) == []
