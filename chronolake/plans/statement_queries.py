"""Queries of storing, sources, administration and functions of constants, with the SQL that gives the same rows."""

from __future__ import annotations

import shutil
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake import types as S
from chronolake.access import ROLES, User
from chronolake.engine import Engine
from chronolake.operators import links, rollup
from chronolake.operators.ingest import Store
from chronolake.plans.catalog import catalog
from chronolake.plans.dialect_queries import _EL, _EY, _OL, _OY, _T, _WL, _WY, comparable
from chronolake.plans.dialect_queries import TEXTS as _DIALECT
from chronolake.schema import DAY_MS, Dimension, Metric, QueryError, Rollup, Schema, Table, phrase_link
from chronolake.session import shared_dir, table, temporary
from chronolake.sources.files import concatenated, to_csv
from chronolake.sources.links import declared, from_jdbc
from chronolake.streaming.ingest import save_data_points
from chronolake.streaming.progress import Progress, resumable

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2025, 7, 1, tzinfo=UTC)
YEAR_MS = 365 * DAY_MS


def _folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    temporary(spark, path)
    return path


# storing


def _stored_orders(spark: SparkSession, sf_dir: str) -> tuple[Table, Store]:
    """All orders put, and those of one status put again with twice their price."""
    schema, store = catalog(sf_dir), Store(spark, _folder(spark, "store"))
    orders = replace(schema.table("orders"), span_ms=YEAR_MS, links=(), time="time")
    rows = schema.rows(spark, "orders")
    store.put(orders, rows, "loader", NOW)
    store.put(orders, rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "fixer", NOW + timedelta(hours=1))
    return orders, store


def put_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, store = _stored_orders(spark, sf_dir)
    e = Engine(spark, Schema({"orders": orders}, {"orders": lambda _: store.read(orders)}), store)
    return comparable(e.sql(f"SELECT time AS t, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_OY}"))


def put_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW UPDATES_INTERVALS after the puts: each interval with the user of its last one."""
    orders, store = _stored_orders(spark, sf_dir)
    e = Engine(spark, Schema({"orders": orders}, {}), store)
    return comparable(e.sql("SHOW UPDATES_INTERVALS WHERE 'orders' = table").select("table", "from", "to", "updated_by"))


_NOTES = Table("notes", [Dimension("author")], [Metric("score", S.BIGINT), Metric("note", S.VARCHAR)])
_NOTES_SQL = "strftime(t, '%Y-%m-%d %H:%M:%S.%g') AS t, author, score, note"


def _notes(spark: SparkSession) -> Engine:
    store = Store(spark, _folder(spark, "notes"))
    return Engine(spark, Schema({"notes": _NOTES}, {"notes": lambda _: store.read(_NOTES)}), store, now=lambda: NOW)


def _all_notes(e: Engine) -> DataFrame:
    return comparable(e.sql("SELECT time AS t, author, score, note FROM notes WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2025-01-01'"))


def upsert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _notes(spark)
    e.sql("UPSERT INTO notes (time, author, score) VALUES (TIMESTAMP '2024-03-01', 'ann', 1), (TIMESTAMP '2024-03-02', 'bob', 2), (TIMESTAMP '2024-03-01', 'ann', 5)")
    e.sql("UPSERT INTO notes (time, author, score, note) VALUES (TIMESTAMP '2024-03-02', 'bob', 3, 'again'), (TIMESTAMP '2024-03-02', 'Bob', 4, NULL)")
    return _all_notes(e)


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _notes(spark)
    e.batch("UPSERT INTO notes (time, author, score, note) VALUES (?, ?, ?, ?)", [(datetime(2024, 5, d), f"a{d % 3}", d, None if d % 2 else "even") for d in range(1, 21)])
    return _all_notes(e)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream into a store."""
    schema, store = catalog(sf_dir), Store(spark, _folder(spark, "stream"))
    events = replace(schema.table("events"), span_ms=YEAR_MS)
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("time"), "user_id", "event_type", "event_id", "value", "props")
    save_data_points(rows, store, events, _folder(spark, "stream-check"), once=True).awaitTermination()
    return comparable(store.read(events).select(F.col("time").alias("t"), "user_id", "event_type", "event_id", "value", "props"))


def resumed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted year by year; the scan stops in the third year, and goes on where it stopped."""
    schema, out, progress = catalog(sf_dir), _folder(spark, "years"), Progress(spark, _folder(spark, "progress"))
    stops = [3]

    def sink(rows: DataFrame, name: str) -> None:
        stops[0] -= 1
        if not stops[0]:
            raise InterruptedError
        made = rows.groupBy(F.date_format("time", "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
        made.coalesce(1).write.mode("overwrite").parquet(f"{out}/{name}")

    scan = (spark, schema, "orders", datetime(1990, 1, 1, tzinfo=UTC), datetime(2006, 1, 1, tzinfo=UTC), timedelta(days=366), progress, sink)
    try:
        resumable(*scan)
    except InterruptedError:
        resumable(*scan)
    return comparable(spark.read.parquet(*[f"{out}/{n}" for n in sorted(progress.done())]))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as CSV and read again."""
    path = _folder(spark, "csv")
    got = comparable(Engine(spark, catalog(sf_dir)).sql(f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(l_tax) AS n FROM sales WHERE {_WY} GROUP BY l_returnflag, l_linestatus"))
    to_csv(got, path)
    return spark.read.schema("l_returnflag string, l_linestatus string, q double, n bigint").option("header", True).csv(path)


def results_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results, one after the other."""
    e = Engine(spark, catalog(sf_dir))
    return comparable(concatenated([e.sql(f"SELECT {k} AS k, count(l_tax) AS n FROM sales WHERE {_WY} GROUP BY {k}") for k in ("l_returnflag", "l_linestatus")]))


# links


def _database(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """A database of one table that every process of the application can open, read-only: its URL.

    Derby's databases belong to the one process that has them open, except those in archives. So the driver alone loads
    the table, from texts that the executors write, and puts the database into an archive in the shared folder.
    """
    home = urlparse(_folder(spark, "database"))
    if home.scheme not in ("", "file"):
        raise RuntimeError(f"the database needs a shared folder that is mounted on every machine, not {home.scheme}:")
    at = Path(home.path)
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    rows.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])).write.text(f"file://{at}/texts")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    drivers, url = spark._jvm.java.sql.DriverManager, f"jdbc:derby:directory:{at}/loading"
    rows.limit(0).write.jdbc(f"{url};create=true", name)
    connection = drivers.getConnection(url)
    try:
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
        load.setString(1, name.upper())
        for text in sorted(at.glob("texts/part-*")):
            load.setString(2, str(text))
            load.execute()
    finally:
        connection.close()
    try:
        drivers.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:  # a database that was shut down always says so by an error
        if e.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(at / "db.jar", "w", zipfile.ZIP_STORED) as jar:
        for file in (at / "loading").rglob("*"):
            if file.is_file() and file.suffix != ".lck":
                jar.write(file, f"db/{file.relative_to(at / 'loading')}")
    for part in ("texts", "loading"):
        shutil.rmtree(at / part)
    return f"jdbc:derby:jar:({at}/db.jar)db"


def link_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link over a table of a database."""
    schema, parts = catalog(sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand_name"), "p_size")
    url = _database(spark, "part_brands", parts)
    link = from_jdbc("Db", "l_partkey", {"brandName": S.VARCHAR}, "part_brands", url)
    sales = replace(schema.table("sales"), links=(link,))
    e = Engine(spark, replace(schema, tables={"sales": sales}))
    return comparable(e.sql(f"SELECT Db_brandName AS brand, sum(l_quantity) AS q, count(l_tax) AS n FROM sales WHERE {_WY} AND Db_brandName <> 'BRAND#13' GROUP BY brand"))


_DECLARED = """{{"externalLinks": [{{"description": {{"linkName": "OrderPriority", "dimensionName": "o_orderpriority", "fieldsNames": ["shortName", "level"],
"tables": ["orders"], "fieldsMapping": {{"o_orderpriority": "code", "shortName": "short_name", "level": "lvl"}}, "relation": "priorities"}}, "connection": {{"url": "{url}"}}}}]}}"""


def link_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link declared in JSON, over a table of a database."""
    schema, rows = catalog(sf_dir), [("1-URGENT", "urgent", "a"), ("2-HIGH", "high", "a"), ("5-LOW", "low", None)]
    url = _database(spark, "priorities", spark.createDataFrame(rows, "code string, short_name string, lvl string"))
    (link, _), = declared(_DECLARED.format(url=url), schema)
    e = Engine(spark, replace(schema, tables={"orders": replace(schema.table("orders"), links=(link,))}))
    return comparable(e.sql(f"SELECT OrderPriority_shortName AS p, OrderPriority_level AS l, count(o_orderkey) AS n FROM orders WHERE {_OY} GROUP BY p, l"))


def phrase_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word search over a stored index, to which the items were added in two steps."""
    schema, items = catalog(sf_dir), table(spark, sf_dir, "kkm_items").select("item")
    index = links.TokenIndex(spark, _folder(spark, "words"), "item")
    index.add(items.where(F.length("item") % 2 == 0))
    index.add(items)
    found = phrase_link("item", index=lambda _: index.read())
    e = Engine(spark, replace(schema, tables={"kkm_items": replace(schema.table("kkm_items"), links=(found,))}))
    return e.sql(_DIALECT["phrase_link"][0])


# rollups


def rollup_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup by a function of its own, put into two targets of which one is read."""
    schema, store = catalog(sf_dir), Store(spark, _folder(spark, "rollup"))
    targets = [Table(n, [Dimension("o_orderstatus")], [Metric("total", S.DOUBLE), Metric("n", S.BIGINT)], span_ms=20 * YEAR_MS) for n in ("monthly", "copied")]
    made = lambda df: df.groupBy(F.date_trunc("month", "time").alias("time"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    r = Rollup("ordersByMonth", "orders", ("monthly", "copied"), {}, (), custom=made)
    whole = Schema({**schema.tables, **{t.name: t for t in targets}}, schema.sources, [r])
    rollup.run(spark, whole, r, store, datetime(1990, 1, 1, tzinfo=UTC), datetime(2005, 1, 1, tzinfo=UTC))
    return comparable(store.read(targets[1]).select(F.col("time").alias("t"), "o_orderstatus", "total", "n"))


# administration


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of statements that are not allowed."""
    e = Engine(spark, catalog(sf_dir))
    texts = {
        "star": f"SELECT * FROM orders WHERE {_OY}", "no condition": "SELECT o_orderkey FROM orders", "no lower bound": "SELECT o_orderkey FROM orders WHERE time < TIMESTAMP '2000-01-01'", "no upper bound": "SELECT o_orderkey FROM orders WHERE time > TIMESTAMP '2000-01-01' OR o_orderkey = 1",
        "window and aggregate": f"SELECT lag(time), sum(o_totalprice) FROM orders WHERE {_OY} GROUP BY o_orderstatus", "no key": f"SELECT o_orderkey, sum(o_totalprice) FROM orders WHERE {_OY} GROUP BY o_orderstatus", "having no key": f"SELECT o_orderstatus FROM orders WHERE {_OY} GROUP BY o_orderstatus HAVING o_totalprice > 5", "set": "SET a = 1",
    }
    out = []
    for name, text in texts.items():
        try:
            e.sql(text)
            out.append((name, "allowed"))
        except QueryError as x:
            out.append((name, str(x)))
    return _rows(spark, out, "what string, said string")


_STATEMENTS = {"read table": f"SELECT event_id FROM events WHERE {_EY}", "write table": "UPSERT INTO notes (time, author) VALUES (TIMESTAMP '2024-01-01', 'a')", "read metadata": "SHOW TABLES", "read users": "SHOW USERS", "write users": "CREATE USER 'new'", "read queries": "SHOW QUERIES", "write queries": "DELETE QUERIES WHERE STATE = 'none'"}


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements each role may run."""
    out = []
    for role in ROLES:
        notes = _notes(spark)
        e = Engine(spark, Schema({**catalog(sf_dir).tables, "notes": _NOTES}, catalog(sf_dir).sources), notes.store)
        for right, text in _STATEMENTS.items():
            try:
                e.sql(text, user=User("x", role))
                out.append((role, right, True))
            except QueryError:
                out.append((role, right, False))
    return _rows(spark, out, "role string, right string, allowed boolean")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW USERS after users were created, changed and dropped, and who can log in with which password."""
    e = Engine(spark, catalog(sf_dir))
    for text in ("CREATE USER 'ann' WITH PASSWORD 'secret' WITH ROLE 'READ_ONLY'", "CREATE USER 'bob' WITH ROLE 'ADMIN'", "CREATE USER 'cid'", "ALTER USER 'cid' SET PASSWORD = 'new' SET ROLE = 'READ_WRITE'", "CREATE USER 'dan'", "DROP USER 'dan'"):
        e.sql(text)

    def enters(name: str, password: str | None) -> bool:
        try:
            return e.users.login(name, password) is not None
        except QueryError:
            return False

    can = _rows(spark, [(n, *[enters(n, p) for p in (None, "secret", "new")]) for n in ("ann", "bob", "cid")], "NAME string, with_none boolean, with_secret boolean, with_new boolean")
    return e.sql("SHOW USERS").join(can, "NAME")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW QUERIES with queries planned, run, refused and killed; one is deleted."""
    e = Engine(spark, catalog(sf_dir), now=lambda: NOW)
    e.sql("SELECT 1 AS planned")
    e.sql("SELECT 2 AS run").collect()
    e.sql("SELECT 3 AS deleted").collect()
    try:
        e.sql("SELECT refused FROM orders")
    except QueryError:
        pass
    e.sql("SELECT 4 AS killed")
    ids = {q.query: q.query_id for q in e.log.values()}
    e.sql(f"KILL QUERY WHERE QUERY_ID = '{ids['SELECT 4 AS killed']}'")
    gone = e.sql(f"DELETE QUERIES WHERE QUERY_ID = '{ids['SELECT 3 AS deleted']}'").first()[0]
    return e.sql("SHOW QUERIES").select("query", "state", F.lit(gone).alias("deleted"))


def show_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).sql("SHOW VERSION")


# functions of constants and casts

#: Items and their words as the light stemmer and transliteration make them: fixed values.
WORDS = (
    ("хот-дог датский чикен", "hot dog datsk chiken"), ("зёрна кофейные marengo", "zern kofejn marengo"), ("мор-ое щербет смор. 80", "mor oe shcherbet smor 80"), ("аи-95-к5 евро-6 евро-6", "ai 95 k 5 k5 evr 6 evr 6"),
    ("сигареты пётр i эталон", "sigaret petr i etalon"), ("котелок солдатский алю", "kotelok soldatsk alyu"), ("Ёлка Зелёная", "elk zelen"), ("ЁЁ0Ё", "ee 0 e ee0e"), ("ѐe0ѐ", "e 0 e0"), ("а и ь сидели на ъ-трубе", "a i sidel na trub"),
)


def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens() of items and of arrays of them, through a table."""
    items = spark.createDataFrame([(NOW, w) for w, _ in WORDS], "time timestamp, item string")
    t = Table("t", [Dimension("item")], [])
    e = Engine(spark, Schema({"t": t}, {"t": lambda _: items}))
    got = e.sql("SELECT item, array_to_string(tokens(item)) AS words, length(tokens(item)) AS n, tokens(split(item)) AS parts FROM t WHERE time >= TIMESTAMP '2025-01-01' AND time < TIMESTAMP '2026-01-01'")
    return got.select("item", "words", "n", (F.size("parts") > 0).alias("has_parts"))


def tokens_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens() of the words of event types, none of which a rule changes."""
    return Engine(spark, catalog(sf_dir)).sql(f"SELECT event_id, array_to_string(tokens(split(event_type))) AS words FROM events WHERE {_EY}")


def database_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, catalog(sf_dir)).sql("SELECT database() AS d")


def converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CAST between numbers, money, texts and times."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("time"), "o_orderkey", (F.col("o_orderkey") % 100).cast("tinyint").alias("tiny"), (F.col("o_orderkey") % 1000).cast("smallint").alias("small"), F.col("o_custkey").cast("int").alias("whole"), F.col("o_custkey").alias("big"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").cast("decimal(38,2)").alias("exact"), F.col("o_custkey").alias("money"))
    t = Table("t", [Dimension("o_orderkey", S.BIGINT)], [Metric("tiny", S.TINYINT), Metric("small", S.SMALLINT), Metric("whole", S.INTEGER), Metric("big", S.BIGINT), Metric("price", S.DOUBLE), Metric("exact", S.DECIMAL), Metric("money", S.CURRENCY)])
    e = Engine(spark, Schema({"t": t}, {"t": lambda _: base}))
    wide = {"tiny": ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "DOUBLE", "VARCHAR"), "small": ("INTEGER", "BIGINT", "DECIMAL", "DOUBLE", "VARCHAR"), "whole": ("BIGINT", "DECIMAL", "DOUBLE", "VARCHAR"), "big": ("DECIMAL", "DOUBLE", "VARCHAR", "CURRENCY"), "price": ("BIGINT", "CURRENCY"), "exact": ("CURRENCY", "VARCHAR"), "money": ("DECIMAL", "BIGINT", "DOUBLE", "VARCHAR"), "time": ("VARCHAR",)}
    fields = ", ".join(f"CAST({c} AS {k}) AS {c}_{k.lower()}" for c, kinds in wide.items() for k in kinds)
    return comparable(e.sql(f"SELECT o_orderkey, {fields} FROM t WHERE {_OY}"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (put_twice, put_changelog, upsert_values, upsert_batch, stream_ingest, resumed_scan, csv_round_trip, results_in_a_row, link_jdbc, link_declared, phrase_stored, rollup_custom, rejected, permissions, users, query_log, show_version, tokens_stemmed, tokens_of_arrays, database_name, converters)}


def _values(rows: list[tuple], names: str) -> str:
    def text(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


_ALLOWED = {"DISABLED": "", "READ_ONLY": "read table, read metadata, read queries", "READ_WRITE": "read table, write table, read metadata, read queries", "ADMIN": "read table, write table, read users, write users, read metadata, read queries, write queries"}

SQL: dict[str, str] = {
    "put_twice": f"SELECT strftime(o_orderdate, {_T}) AS t, o_orderkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS o_totalprice FROM orders WHERE {_OL}",
    "put_changelog": f"SELECT 'orders' AS \"table\", strftime(make_timestamp(b * {YEAR_MS} * 1000), {_T}) AS \"from\", strftime(make_timestamp((b + 1) * {YEAR_MS} * 1000), {_T}) AS \"to\", CASE WHEN bool_or(o_orderstatus = 'F') THEN 'fixer' ELSE 'loader' END AS updated_by FROM (SELECT epoch_ms(o_orderdate) // {YEAR_MS} AS b, o_orderstatus FROM orders) GROUP BY b",
    "upsert_values": f"SELECT {_NOTES_SQL} FROM (VALUES (TIMESTAMP '2024-03-01', 'ann', 5, NULL), (TIMESTAMP '2024-03-02', 'bob', 3, 'again'), (TIMESTAMP '2024-03-02', 'Bob', 4, NULL)) v(t, author, score, note)",
    "upsert_batch": "SELECT strftime(TIMESTAMP '2024-04-30' + INTERVAL 1 DAY * d, '%Y-%m-%d %H:%M:%S.%g') AS t, 'a' || (d % 3) AS author, d AS score, CASE WHEN d % 2 = 0 THEN 'even' END AS note FROM (SELECT unnest(range(1, 21)) AS d)",
    "stream_ingest": f"SELECT strftime(date_trunc('millisecond', ts), {_T}) AS t, user_id, event_type, event_id, round(value, 4) AS value, props FROM events",
    "resumed_scan": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1",
    "csv_round_trip": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS q, count(l_tax) AS n FROM lineitem WHERE {_WL} GROUP BY ALL",
    "results_in_a_row": f"SELECT l_returnflag AS k, count(l_tax) AS n FROM lineitem WHERE {_WL} GROUP BY ALL UNION ALL SELECT l_linestatus AS k, count(l_tax) AS n FROM lineitem WHERE {_WL} GROUP BY ALL",
    "link_jdbc": f"SELECT p_brand AS brand, round(sum(l_quantity), 4) AS q, count(l_tax) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE {_WL} AND (p_brand IS NULL OR lower(p_brand) <> 'brand#13') GROUP BY ALL",
    "link_declared": f"SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS p, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' END AS l, count(o_orderkey) AS n FROM orders WHERE {_OL} GROUP BY ALL",
    "phrase_stored": _DIALECT["phrase_link"][1],
    "rollup_custom": f"SELECT strftime(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP), {_T}) AS t, o_orderstatus, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM orders WHERE {_OL} GROUP BY ALL",
    "rejected": _values([("star", "All fields matching is not supported"), ("no condition", "Empty condition"), ("no lower bound", "FROM time is not defined"), ("no upper bound", "FROM time is not defined"), ("window and aggregate", "Aggregation defined for field sum(o_totalprice) together with window functions"), ("no key", "Aggregate function is not defined for field o_orderkey"), ("having no key", "Field o_totalprice in HAVING is neither an aggregate nor a key of the groups"), ("set", "Unsupported query type")], "what, said"),
    "permissions": _values([(role, right, right in rights.split(", ")) for role, rights in _ALLOWED.items() for right in _STATEMENTS], 'role, "right", allowed'),
    "users": _values([("ann", "READ_ONLY", False, True, False), ("bob", "ADMIN", True, False, False), ("cid", "READ_WRITE", False, False, True)], "NAME, ROLE, with_none, with_secret, with_new"),
    "query_log": _values([("SELECT 1 AS planned", "RUNNING", 1), ("SELECT 2 AS run", "FINISHED", 1), ("SELECT refused FROM orders", "CANCELLED", 1), ("SELECT 4 AS killed", "CANCELLED", 1)], "query, state, deleted"),
    "show_version": _values([(0, 1, "0.1.0")], "MAJOR, MINOR, VERSION"),
    "tokens_stemmed": _values([(w, t.replace(" ", ", "), len(t.split()), True) for w, t in WORDS], "item, words, n, has_parts"),
    "tokens_of_arrays": f"SELECT event_id, regexp_replace(event_type, '[^a-z]+', ', ', 'g') AS words FROM events WHERE {_EL}",
    "database_name": "SELECT 'chronolake' AS d",
    "converters": "SELECT o_orderkey, " + ", ".join(
        [f"CAST(o_orderkey % 100 AS {k}) AS tiny_{k.lower()}" for k in ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "DOUBLE", "VARCHAR")] + [f"CAST(o_orderkey % 1000 AS {k}) AS small_{k.lower()}" for k in ("INTEGER", "BIGINT", "DECIMAL", "DOUBLE", "VARCHAR")]
        + [f"CAST(o_custkey AS {k}) AS whole_{k.lower()}" for k in ("BIGINT", "DECIMAL", "DOUBLE", "VARCHAR")] + [f"CAST(o_custkey AS {k}) AS big_{k.lower()}" for k in ("DECIMAL", "DOUBLE", "VARCHAR")] + ["CAST(o_custkey AS DOUBLE) AS big_currency"]
        + ["CAST(trunc(o_totalprice) AS BIGINT) AS price_bigint", "trunc(o_totalprice * 100) / 100 AS price_currency", "CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS DOUBLE) AS exact_currency", "CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) AS exact_varchar"]
        + ["o_custkey / 100 AS money_decimal", "o_custkey // 100 AS money_bigint", "o_custkey / 100 AS money_double", "CAST(CAST(o_custkey / 100 AS DECIMAL(38,2)) AS VARCHAR) AS money_varchar", f"strftime(o_orderdate, {_T}) AS time_varchar"]
    ) + f" FROM orders WHERE {_OL}",
}
