"""Statements over a small schema: what the rules of the language make of nulls, case, types, links and time."""

from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolake import types as S
from chronolake.engine import Engine
from chronolake.functions.tokens import raw_tokens, tokens
from chronolake.operators import links, rollup
from chronolake.operators.ingest import Store, filter_changelog, latest_intervals
from chronolake.schema import DAY_MS, Dimension, Link, Metric, QueryError, Rollup, Schema, Table, drift, phrase_link, related_link
from chronolake.sources.files import concatenated, exploded_index, to_csv
from chronolake.sources.links import declared, from_jdbc, in_memory, snake
from chronolake.streaming.ingest import save_data_points

T0 = datetime(2024, 3, 1, tzinfo=UTC)
ALL = "time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2025-01-01'"
DATA = [
    (0, "One", 1, 1.5, "Abc", 10, 100, Decimal("1.25")),
    (1, "one", 2, None, None, 7, 250, Decimal("2.00")),
    (2, "Two", 1, 0.0, "abc", None, None, None),
    (3, "Two", 2, -2.0, "zzz", -7, 99, Decimal("0.05")),
    (25, "Three", 1, 4.0, "", 3, 1, None),
]
SHAPE = "h int, A string, B smallint, d double, s string, l bigint, c bigint, n decimal(38,2)"
INFO = in_memory("Info", "A", S.VARCHAR, {"f": S.VARCHAR, "g": S.INTEGER}, [{"A": "one", "f": "x", "g": 1}, {"A": "TWO", "f": "Y", "g": 2}, {"A": None, "f": "x", "g": 9}])
COLUMNS = [Dimension("A"), Dimension("B", S.SMALLINT)], [Metric("d", S.DOUBLE), Metric("s", S.VARCHAR), Metric("l", S.BIGINT), Metric("c", S.CURRENCY), Metric("n", S.DECIMAL)]


def values(spark):
    return spark.createDataFrame([("One", T0 + timedelta(hours=1), "late"), ("One", T0, "first"), ("Two", T0 + timedelta(hours=5), "only")], "A string, time timestamp, v string")


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(DATA, SHAPE).withColumn("time", F.lit(T0) + F.make_dt_interval(hours="h"))
    timed = Link("Val", "A", {"v": S.VARCHAR}, values, time_sensitive=True)
    t = Table("t", *COLUMNS, [INFO, timed])
    empty = Table("e", [Dimension("A")], [Metric("d", S.DOUBLE)])
    return Engine(spark, Schema({"t": t, "e": empty}, {"t": lambda _: df, "e": lambda s: s.createDataFrame([], "time timestamp, A string, d double")}), now=lambda: T0 + timedelta(days=1))


@pytest.fixture
def q(engine, rows):
    return lambda sql, *p: rows(engine.sql(sql, p))


def test_conditions_ignore_case_but_results_do_not(q):
    assert q(f"SELECT A FROM t WHERE {ALL} AND A = 'ONE'") == [("One",), ("one",)]
    assert q(f"SELECT A, count(B) AS n FROM t WHERE {ALL} AND A IN ('one', 'TWO') GROUP BY A") == [("One", 1), ("Two", 2), ("one", 1)]
    assert q(f"SELECT CASE WHEN s = 'ABC' THEN A ELSE 'no' AS r FROM t WHERE {ALL} AND s < 'B'") == [("One",), ("Two",), ("no",)]


def test_null_operands_drop_rows(q):
    assert q(f"SELECT B FROM t WHERE {ALL} AND d > -100 AND l <> 0") == [(1,), (1,), (2,)]
    assert q(f"SELECT l FROM t WHERE {ALL} AND not(l = 7)") == [(-7,), (10,), (3,)]


def test_global_aggregate_of_nothing_has_no_row(q):
    assert q(f"SELECT sum(d), count(d) FROM e WHERE {ALL}") == []
    assert q(f"SELECT sum(d) FROM t WHERE {ALL} AND A = 'none'") == []


def test_aggregates_with_nulls(q):
    assert q(f"SELECT sum(l), count(l), distinct_count(s), avg(n), min(s), max(time) - min(time) FROM t WHERE {ALL}") == [(13, 4, 4, Decimal("1.100000"), "", 25 * 3600000)]
    assert q(f"SELECT count(1) AS n, sum(l) AS x, count(l) AS y, distinct_count(l) AS z FROM t WHERE {ALL} AND l IS NULL") == [(1, None, 0, 0)]


def test_integer_and_decimal_division(q):
    assert q(f"SELECT l / 2 AS x FROM t WHERE {ALL} AND l IS NOT NULL") == [(-3,), (1,), (3,), (5,)]
    assert q(f"SELECT n / n AS x, n / 3 AS y FROM t WHERE {ALL} AND n > 1") == [(Decimal("1.00"), Decimal("0.42")), (Decimal("1.00"), Decimal("0.67"))]
    assert q(f"SELECT d / 0 AS x FROM t WHERE {ALL} AND d >= -2 AND d <> 0") == [(float("-inf"),), (float("inf"),), (float("inf"),)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
        q(f"SELECT l / 0 AS x FROM t WHERE {ALL} AND l = 10")


def test_money_is_cut_to_cents(q):
    assert q(f"SELECT c * 1.5 AS x, c / 2 AS y, c / c AS z FROM t WHERE {ALL} AND c = 0.99") == [(Decimal("1.48"), Decimal("0.49"), 1.0)]
    assert q(f"SELECT sum(c) AS x FROM t WHERE {ALL}") == [(Decimal("4.50"),)]
    assert q(f"SELECT CAST(c AS VARCHAR) AS x, CAST(c AS DOUBLE) AS y FROM t WHERE {ALL} AND c = 2.5") == [("2.50", 2.5)]


def test_literals_take_the_other_side_s_type(q):
    with pytest.raises(QueryError, match="Unsupported operation"):
        q(f"SELECT l + 1.5 AS x FROM t WHERE {ALL}")
    assert q(f"SELECT d + 1 AS x FROM t WHERE {ALL} AND l = 3.00") == [(5.0,)]
    with pytest.raises(QueryError, match="Cannot convert"):
        q(f"SELECT B FROM t WHERE {ALL} AND B = 100000")


def test_times(q):
    assert q(f"SELECT time - TIMESTAMP '2024-03-02' AS x FROM t WHERE {ALL} AND B = 1 AND d = 4") == [(3600000,)]
    assert q(f"SELECT B FROM t WHERE {ALL} AND now() - time <= INTERVAL '3' HOUR") == [(1,)]  # the distance has no sign
    assert q("SELECT A FROM t WHERE time > TIMESTAMP '2024-03-01' AND time <= TIMESTAMP '2024-03-01 02:00:00'") == [("Two",), ("one",)]
    with pytest.raises(QueryError, match="no length in milliseconds"):
        q(f"SELECT A FROM t WHERE {ALL} AND now() - time < INTERVAL '1' MONTH")


@pytest.mark.parametrize("where,message", [("time > TIMESTAMP '2024-01-01'", "TO time is not defined"), ("time < TIMESTAMP '2024-01-01'", "FROM time is not defined"), ("B = 1", "FROM time"), (f"({ALL}) OR B = 1", "FROM time"), ("", "Empty condition")])
def test_time_has_to_be_bounded(q, where, message):
    with pytest.raises(QueryError, match=message):
        q(f"SELECT A FROM t {'WHERE ' + where if where else ''}")


@pytest.mark.parametrize(
    "sql,message",
    [
        ("SELECT * FROM t WHERE " + ALL, "All fields matching"), ("SELECT x FROM t WHERE " + ALL, "Unknown field x"), ("SELECT A FROM x WHERE " + ALL, "Unknown table 'x'"), ("SELECT f(A) FROM t WHERE " + ALL, "Undefined function f"),
        ("SELECT A, sum(d) FROM t WHERE " + ALL, "without group by"), ("SELECT A, sum(d) FROM t WHERE " + ALL + " GROUP BY B", "Aggregate function is not defined"), ("SELECT lag(time), sum(d) FROM t WHERE " + ALL + " GROUP BY A", "together with window"),
        ("SELECT sum(sum(d)) FROM t WHERE " + ALL, "Invalid expression"), ("SELECT sum(A) FROM t WHERE " + ALL, "can not be applied"), ("SELECT B AS l FROM t WHERE " + ALL + " AND l = 1", "Ambiguous field l"), ("SELECT hll_count(d, 0.1) FROM t WHERE " + ALL, "not defined for given datatype"),
        ("SELECT hll_count(l, 0.5) FROM t WHERE " + ALL, "std_err must be in range"), ("SELECT A + l FROM t WHERE " + ALL, "Unsupported operation"), ("SELECT CAST(A AS BIGINT) FROM t WHERE " + ALL, "Cannot convert"), ("SELECT CAST(A AS X) FROM t WHERE " + ALL, "Unknown type X"), ("SET a = 1", "Unsupported query type"),
    ],
)
def test_rejected(q, sql, message):
    with pytest.raises(QueryError, match=message):
        q(sql)


def test_hll_small_errors_do_not_reach_the_unsafe_counter(q):
    assert q(f"SELECT hll_count(l, 0.00003) AS a, hll_count(s, 0.001) AS b, hll_count(time, 0.1) AS c FROM t WHERE {ALL}") == [(4, 4, 5)]


def test_lag_keeps_all_rows(q):
    assert q(f"SELECT B, l, lag(l) AS p FROM t WHERE {ALL} GROUP BY B") == sorted([(1, 10, None), (1, None, 10), (1, 3, None), (2, 7, None), (2, -7, 7)], key=repr)
    assert q(f"SELECT A, lag(l) AS p FROM t WHERE {ALL} AND B = 2 HAVING p = 7") == [("Two", 7)]


@pytest.mark.parametrize("groups", ["", "GROUP BY A", "GROUP BY A, B"])
def test_lag_over_many_slices(spark, monkeypatch, groups):
    """The previous value may lie many time slices back, in any group, null ones included."""
    import random

    from chronolake.operators import slices
    from chronolake.plans import select

    monkeypatch.setattr(select, "slice_of", lambda df, time: slices.slice_of(df, time, 20))
    r = random.Random(8)
    data = [(T0 + timedelta(hours=r.randrange(24 * 200)), r.choice(["a", "a", "a", "b"]), r.choice([1, None]), i, r.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(data, "time timestamp, A string, B bigint, id bigint, x bigint").repartition(5)
    t = Table("t", [Dimension("A"), Dimension("id", S.BIGINT)], [Metric("B", S.BIGINT), Metric("x", S.BIGINT)], span_ms=DAY_MS)
    got = Engine(spark, Schema({"t": t}, {"t": lambda _: df})).sql(f"SELECT id, lag(id) AS p, lag(x) AS y, time - lag(time) AS gap FROM t WHERE {ALL} {groups}")
    last, want = {}, {}
    for at, a, b, i, x in sorted(data, key=lambda d: (d[0], d[1], d[3])):
        key = {"": (), "GROUP BY A": (a,), "GROUP BY A, B": (a, b)}[groups]
        p = last.get(key)
        want[i] = (p[1], p[2], int((at - p[0]).total_seconds() * 1000)) if p else (None, None, None)
        last[key] = (at, i, x)
    assert {r.id: (r.p, r.y, r.gap) for r in got.collect()} == want


def test_slices_hold_few_rows(spark, monkeypatch):
    """Nine tenths of the rows lie within a minute; slices ascend with time and none holds many rows."""
    from chronolake.operators import slices

    df = spark.range(5000).select((F.lit(T0) + F.make_dt_interval(secs=F.when(F.col("id") % 10 > 0, F.col("id") / 100).otherwise(F.col("id") * 5000))).alias("time"))
    for side in (slices.SIDE, 4):
        monkeypatch.setattr(slices, "SIDE", side)
        got = df.withColumn("s", slices.slice_of(df, "time", 100)).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).orderBy("a").collect()
        assert max(x.n for x in got) <= (250 if side > 4 else 700) and len(got) > (40 if side > 4 else 12)
        assert all(x.b <= y.a and x.s < y.s for x, y in zip(got, got[1:], strict=False))
    nothing = spark.createDataFrame([(None,)], "time timestamp")
    assert nothing.select(slices.slice_of(nothing, "time", 1).alias("s")).first().s is None


def test_link_lookup_semi_anti(q):
    assert q(f"SELECT B, Info_f AS f FROM t WHERE {ALL} AND A <> 'three'") == sorted([(1, "x"), (2, "x"), (1, "Y"), (2, "Y")], key=repr)
    assert q(f"SELECT A, Info_g AS g FROM t WHERE {ALL} AND B = 1 AND d > 3") == [("Three", None)]
    assert q(f"SELECT A FROM t WHERE {ALL} AND Info_f = 'y'") == [("Two",), ("Two",)]
    assert q(f"SELECT A FROM t WHERE {ALL} AND Info_f <> 'Y'") == [("One",), ("Three",), ("one",)]
    assert q(f"SELECT A FROM t WHERE {ALL} AND Info_f = 'x' AND Info_g IN (2)") == []
    assert q(f"SELECT A FROM t WHERE {ALL} AND (Info_g = 1 OR d = 4)") == [("One",), ("Three",), ("one",)]


def test_as_of_link_takes_the_first_value_before_any(q):
    assert q(f"SELECT A, B, Val_v AS v FROM t WHERE {ALL}") == sorted([("One", 1, "first"), ("one", 2, None), ("Two", 1, "only"), ("Two", 2, "only"), ("Three", 1, None)], key=repr)


def test_as_of_with_ties_nulls_and_no_rows(spark, rows):
    facts = spark.createDataFrame([(1, T0), (1, T0 + timedelta(1)), (None, T0), (2, T0)], "k int, time timestamp")
    rows_ = spark.createDataFrame([(1, T0, "a"), (1, T0, "b"), (1, None, "z"), (None, T0, "n")], "k int, time timestamp, v string")
    assert rows(links.as_of(facts, rows_, "k", "time", ["v"])) == sorted([(1, T0.replace(tzinfo=None), "b"), (1, datetime(2024, 3, 2), "b"), (None, datetime(2024, 3, 1), None), (2, datetime(2024, 3, 1), None)], key=repr)
    assert links.as_of(facts, rows_.limit(0), "k", "time", ["v"]).where("v IS NULL").count() == 4


@pytest.mark.parametrize("small", [False, True])
def test_as_of_over_many_slices(spark, monkeypatch, small):
    import random

    if not small:
        monkeypatch.setattr(links, "BROADCAST_BYTES", -1)

    r = random.Random(3)
    t = lambda: T0 + timedelta(hours=r.randrange(24 * 300))
    facts = [(i, r.choice([1, 1, 1, 2, 3]), t()) for i in range(300)]
    values_ = [(r.choice([1, 1, 2, 9]), t(), r.choice([None, f"v{i}"])) for i in range(25)]
    f, v = spark.createDataFrame(facts, "id bigint, k int, time timestamp"), spark.createDataFrame(values_, "k int, time timestamp, v string")
    got = {x.id: x.v for x in links.as_of(f.repartition(3), v, "k", "time", ["v"], slice_rows=40).collect()}
    for i, k, at in facts:
        mine = sorted((x[1], x[2] is not None, x[2] or "") for x in values_ if x[0] == k)
        hit = [x for x in mine if x[0] <= at] or mine[:1]
        first = [x for x in mine if x[0] == hit[0][0]] if hit and hit[-1][0] > at else None
        want = (max(first) if first else hit[-1])[2] or None if hit else None
        assert got[i] == want


def test_words_of_items():
    assert raw_tokens("к5") == ["к", "5", "к5"]
    assert raw_tokens("х/к") == ["х", "к", "х/к"]
    assert raw_tokens("п/п/к") == ["п", "п", "п/п", "к", "п/п/к"]
    assert raw_tokens("аи-95аи") == ["аи", "95", "аи", "95аи"]
    assert raw_tokens("3,2% 0.5") == ["3,2", "0.5"]
    assert tokens("молоко 3,2%") == ["molok", "3,2"] and tokens("") == [] and tokens(None) is None


def test_phrases(spark, rows):
    items = spark.createDataFrame([("красное яблоко",), ("красный чай",), ("яблочный сок",), (None,), ("",)], "item string")
    find = lambda *p, **k: {r[0] for r in links.filter_phrases(items, "item", [list(x) for x in p], **k).collect()}
    assert find(["красное яблоко"]) == {"красное яблоко"}
    assert find(["яблоч%", "чай"]) == {"яблочный сок", "красный чай"}
    assert find(["красный"], ["чай"]) == {"красный чай"}
    assert find(["красный"], exclude=["чай"]) == {"красное яблоко"}
    assert find(["нет"]) == set()


def test_word_links(spark):
    df = spark.createDataFrame([(T0, "красное яблоко", 1, 1), (T0, "чай", 1, 2), (T0, "чай", 2, 3), (T0, None, 2, 4), (T0, "яблочный сок ╕ж", 3, 5)], "time timestamp, item string, dev int, id int")
    t = Table("t", [Dimension("item"), Dimension("dev", S.INTEGER)], [Metric("id", S.INTEGER)], [phrase_link("item"), related_link("item", ("time", "dev"))])
    e = Engine(spark, Schema({"t": t}, {"t": lambda _: df}))
    ids = lambda where: sorted(r.id for r in e.sql(f"SELECT id FROM t WHERE {ALL} AND {where}").collect())
    assert ids("ItemsInvertedIndex_phrase = 'яблоки красный'") == [1]
    assert ids("ItemsInvertedIndex_phrase IN ('яблоч%', 'чай')") == [2, 3, 5]
    assert ids("ItemsInvertedIndex_phrase = 'ёж'") == [5]  # the broken letter is put right
    assert ids("ItemsInvertedIndex_phrase <> 'чай'") == [1, 4, 5]
    assert ids("RelatedItemsCatalog_item = 'Чай'") == [1, 2, 3, 4]
    assert ids("RelatedItemsCatalog_phrase = 'чай' AND RelatedItemsCatalog_item = 'красное яблоко'") == [1, 2]
    assert ids("RelatedItemsCatalog_phrase <> 'яблоко'") == [3, 4, 5]
    assert ids("RelatedItemsCatalog_item = 'чай' AND dev = 1") == [1, 2]
    assert e.sql(f"SELECT ItemsInvertedIndex_phrase AS p FROM t WHERE {ALL}").where("p IS NULL").count() == 5
    with pytest.raises(QueryError, match="can only stand beside others"):
        ids("(ItemsInvertedIndex_phrase = 'чай' OR dev = 3)")


def test_store_upserts_replace_and_are_logged(spark, rows, tmp_path):
    table = Table("t", [Dimension("A")], [Metric("x", S.BIGINT), Metric("y", S.VARCHAR)])
    store = Store(spark, f"file://{tmp_path}/s")
    e = Engine(spark, Schema({"t": table}, {"t": lambda _: store.read(table)}), store, now=lambda: T0)
    assert rows(e.sql("SELECT A FROM t WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2025-01-01'")) == []
    e.sql("UPSERT INTO t (time, A, x) VALUES (TIMESTAMP '2024-03-01', 'a', 1), (TIMESTAMP '2024-03-02', 'b', 2), (TIMESTAMP '2024-03-01', 'a', 5)")
    e.sql("UPSERT INTO t (time, A, x, y) VALUES (TIMESTAMP '2024-03-02', 'b', 3, 'new')")
    e.batch("UPSERT INTO t (time, A, x) VALUES (?, ?, ?)", [(datetime(2024, 3, 3), "c", 7), (datetime(2024, 3, 3), "d", 8)])
    assert rows(e.sql("SELECT A, x, y FROM t WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2025-01-01'")) == sorted([("a", 5, None), ("b", 3, "new"), ("c", 7, None), ("d", 8, None)], key=repr)
    log = e.sql("SHOW UPDATES_INTERVALS WHERE table = 't'")
    assert sorted(r["from"].day for r in log.collect()) == [1, 2, 3]
    plan = e.sql("SELECT A FROM t WHERE time >= TIMESTAMP '2024-03-02' AND time < TIMESTAMP '2024-03-03'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(base_time" in plan
    for sql, message in (("UPSERT INTO t (A, x) VALUES ('a', 1)", "Time field is not defined"), ("UPSERT INTO t (time, x) VALUES (TIMESTAMP '2024-03-01', 1)", "A is not defined"), ("UPSERT INTO t (time, A, z) VALUES (TIMESTAMP '2024-03-01', 'a', 1)", "Unknown field z"), ("UPSERT INTO t (time, A, x) VALUES (TIMESTAMP '2024-03-01', 'a', 'b')", "Cannot convert")):
        with pytest.raises(QueryError, match=message):
            e.sql(sql)


def test_changelog_filters(spark):
    h = lambda n: T0 + timedelta(hours=n)
    log = spark.createDataFrame([("a", h(1), h(0), h(4), "u"), ("a", h(2), h(0), h(4), "v"), ("b", h(3), h(8), h(12), None)], "table string, updated_at timestamp, `from` timestamp, `to` timestamp, updated_by string")
    log = latest_intervals(log)
    assert log.count() == 2 and filter_changelog(log, updated_by="u").count() == 0 and filter_changelog(log, table="b").count() == 1
    assert filter_changelog(log, recalculated=(h(2), h(9))).count() == 2 and filter_changelog(log, recalculated=(h(5), h(7))).count() == 0
    assert filter_changelog(log, recalculated_after=h(8)).count() == 1 and filter_changelog(log, updated=(h(2), h(2))).count() == 1


def test_stream_of_data_points(spark, rows, tmp_path):
    table = Table("t", [Dimension("A")], [Metric("x", S.BIGINT)])
    store = Store(spark, f"file://{tmp_path}/s")
    shape = "time timestamp, A string, x bigint"
    for i, batch in enumerate([[(T0, "a", 1)], [(T0 - timedelta(days=40), "late", 2), (T0, "a", 3)]]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        save_data_points(stream, store, table, f"{tmp_path}/check", once=True).awaitTermination()
        assert store.read(table).count() == 1 + i
    assert rows(store.read(table).select("A", "x")) == [("a", 3), ("late", 2)]


def test_rollup_into_targets(spark, rows, tmp_path):
    source = Table("s", [Dimension("A")], [Metric("x", S.BIGINT)])
    target = Table("by_day", [Dimension("A")], [Metric("total", S.BIGINT), Metric("n", S.BIGINT)], span_ms=30 * DAY_MS)
    data = spark.createDataFrame([(T0, "a", 1), (T0 + timedelta(hours=3), "a", 2), (T0 + timedelta(days=1), "a", 4), (T0, "b", None)], "time timestamp, A string, x bigint")
    store = Store(spark, f"file://{tmp_path}/r")
    r = Rollup("daily", "s", ("by_day",), {"A": "A", "total": "sum(x)", "n": "count(1)"}, ("A",), where="A <> 'z'")
    schema = Schema({"s": source, "by_day": target}, {"s": lambda _: data, "by_day": lambda _: store.read(target)}, [r])
    for _ in range(2):  # again changes nothing
        rollup.run(spark, schema, r, store, T0, T0 + timedelta(days=5))
    assert rows(store.read(target).select("A", "total", "n")) == sorted([("a", 3, 2), ("a", 4, 1), ("b", None, 1)], key=repr)
    custom = Rollup("own", "s", ("by_day",), {}, (), custom=lambda df: df.groupBy("time", "A").agg(F.sum("x").alias("total")))
    assert rollup.compute(spark, schema, custom, T0, T0 + timedelta(hours=1)).count() == 2
    tables = {x.TABLE_NAME: (x.TABLE_TYPE, x.REMARKS) for x in Engine(spark, schema).sql("SHOW TABLES").collect()}
    assert tables["by_day"] == ("ROLLUP", "Rollup from s WHERE A <> 'z' GROUP BY trunc_day(time), A") and tables["s"] == ("TABLE", None)


def test_users_and_rights(spark, engine):
    e = Engine(spark, engine.schema)
    e.sql("CREATE USER 'ann' WITH PASSWORD 'secret' WITH ROLE 'READ_ONLY'")
    ann = e.users.login("ann", "secret")
    assert e.sql(f"SELECT A FROM t WHERE {ALL}", user=ann).count() == 5
    for sql in ("UPSERT INTO t (time) VALUES (NULL)", "CREATE USER 'bob'", "KILL QUERY WHERE QUERY_ID = 'x'"):
        with pytest.raises(QueryError, match="enough permissions"):
            e.sql(sql, user=ann)
    with pytest.raises(QueryError, match="Invalid user or password"):
        e.users.login("ann", "wrong")
    e.sql("ALTER USER 'ann' SET ROLE = 'ADMIN'")
    assert [tuple(r) for r in e.sql("SHOW USERS", user=e.users.login("ann", "secret")).collect()] == [("ann", "ADMIN")]
    e.sql("DROP USER 'ann'")
    with pytest.raises(QueryError, match="doesn't exists"):
        e.sql("DROP USER 'ann'")


def test_query_log(spark, engine):
    """A query is RUNNING until one of its actions has ended, whatever was planned in between."""
    e = Engine(spark, engine.schema)
    a, b = e.sql("SELECT 1 AS x"), e.sql("SELECT 2 AS y")
    with pytest.raises(QueryError):
        e.sql("SELECT x FROM t")
    assert [r.state for r in e.sql("SHOW QUERIES").collect()] == ["RUNNING", "RUNNING", "CANCELLED"]
    groups = []
    first = next(iter(e.log.values()))
    a.foreachPartition(lambda _: None)
    a._logged(lambda: groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id")))
    assert groups == [first.query_id] and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert [r.state for r in e.sql("SHOW QUERIES").collect()] == ["FINISHED", "RUNNING", "CANCELLED"] and first.total_duration > 0
    b.write.format("noop").mode("overwrite").save()
    assert e.sql("SHOW QUERIES WHERE STATE = 'FINISHED' LIMIT 5").count() == 2
    assert e.sql("DELETE QUERIES WHERE STATE = 'CANCELLED'").collect()[0][0] == 1 and len(e.log) == 2
    assert e.sql("KILL QUERY WHERE QUERY_ID = 'none'").collect()[0][0] == "QUERY NOT FOUND"
    assert e.sql("SHOW VERSION").collect()[0].MAJOR == 0


def test_kill_stops_the_query_meant(spark, engine, monkeypatch):
    """Two queries are planned and the first runs; killing it stops it, and not the other."""
    import threading
    import time

    slow = F.udf(lambda x: time.sleep(60) or x, "bigint")
    df = spark.range(4).select(F.lit(T0).alias("time"), F.lit("a").alias("A"), slow("id").cast("double").alias("d"))
    e = Engine(spark, Schema({"e": engine.schema.tables["e"]}, {"e": lambda _: df}))
    a, b, failed = e.sql(f"SELECT d FROM e WHERE {ALL}"), e.sql("SELECT 2 AS y"), []

    def run():
        try:
            a.collect()
        except Exception as x:
            failed.append(x)

    thread = threading.Thread(target=run)
    thread.start()
    ids = list(e.log)
    end = time.time() + 30
    while not spark.sparkContext.statusTracker().getJobIdsForGroup(ids[0]) and time.time() < end:
        time.sleep(0.1)
    assert e.sql(f"KILL QUERY WHERE QUERY_ID = '{ids[0]}'").collect()[0][0] == "OK"
    thread.join(30)
    assert failed and [q.state for q in e.log.values()] == ["CANCELLED", "RUNNING"]
    assert b.collect()[0].y == 2 and e.log[ids[1]].state == "FINISHED"


def test_the_log_has_a_limit(spark, engine, monkeypatch):
    from chronolake import engine as module

    monkeypatch.setattr(module, "LOG_SIZE", 3)
    e = Engine(spark, engine.schema)
    for i in range(5):
        e.sql(f"SELECT {i} AS x")
    assert [q.query for q in e.log.values()] == ["SELECT 2 AS x", "SELECT 3 AS x", "SELECT 4 AS x"]


def test_a_user_without_a_password_has_the_empty_one(spark, engine):
    e = Engine(spark, engine.schema)
    e.sql("CREATE USER 'ann' WITH ROLE 'ADMIN'")
    assert e.users.login("ann", None).role == e.users.login("ann", "").role == "ADMIN"
    with pytest.raises(QueryError, match="Invalid user or password"):
        e.users.login("ann", "anything")


def test_having_needs_keys_or_aggregates(q):
    assert q(f"SELECT B FROM t WHERE {ALL} GROUP BY B HAVING B > 1") == [(2,)]
    assert q(f"SELECT B, sum(l) AS x FROM t WHERE {ALL} GROUP BY B HAVING x > 0 AND B = 1") == [(1, 13)]
    assert q(f"SELECT B, sum(l) AS x FROM t WHERE {ALL} GROUP BY B HAVING max(l) + sum(l) > 100") == []
    for having in ("l > 5", "sum(l) > 0 AND d > 1", "l + l > 3"):
        with pytest.raises(QueryError, match="neither an aggregate nor a key"):
            q(f"SELECT B, sum(l) AS x FROM t WHERE {ALL} GROUP BY B HAVING {having}")


def test_any_value_of_a_group(spark):
    df = spark.range(4000).select(F.lit(T0).alias("time"), F.lit("a").alias("A"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("d"))
    e = Engine(spark, Schema({"e": Table("e", [Dimension("A")], [Metric("d", S.DOUBLE)])}, {"e": lambda _: df}))
    seen = {e.sql(f"SELECT distinct_random(d) AS r FROM e WHERE {ALL}").collect()[0].r for _ in range(25)}
    assert seen <= set(map(float, range(7))) and len(seen) > 2
    plan = e.sql(f"SELECT distinct_random(d) AS r FROM e WHERE {ALL}")._jdf.queryExecution().toString()
    assert "collect_set" not in plan
    assert e.sql(f"SELECT distinct_random(d) AS r FROM e WHERE {ALL} AND d IS NULL").collect()[0].r is None


def test_alternatives_of_time_are_pruned_apart(spark, tmp_path):
    table = Table("t", [Dimension("A")], [Metric("x", S.BIGINT)])
    store = Store(spark, f"file://{tmp_path}/s")
    e = Engine(spark, Schema({"t": table}, {"t": lambda _: store.read(table)}), store)
    store.put(table, spark.range(40).select((F.lit(T0) + F.make_dt_interval("id")).alias("time"), F.lit("a").alias("A"), F.col("id").alias("x")))
    df = e.sql("SELECT x FROM t WHERE (time >= TIMESTAMP '2024-03-02' AND time < TIMESTAMP '2024-03-03') OR time = TIMESTAMP '2024-03-30'")
    assert sorted(r.x for r in df.collect()) == [1, 29]
    files = {r.f for r in df._jdf and df.select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 3
    assert "((base_time" in df._jdf.queryExecution().toString() and " OR " in df._jdf.queryExecution().toString()


def test_a_put_reads_only_the_partitions_it_touches(spark, tmp_path, monkeypatch):
    """The scan of a put names its partitions; the changelog has the intervals even if the put dies halfway."""
    from chronolake.operators import ingest

    table = Table("t", [Dimension("A")], [Metric("x", S.BIGINT)])
    store = Store(spark, f"file://{tmp_path}/s", wait_seconds=0.5)
    day = lambda n: T0 + timedelta(days=n)
    shape = "time timestamp, A string, x bigint"
    store.put(table, spark.createDataFrame([(day(i), "a", i) for i in range(12)], shape))
    for few in (ingest.FEW_SPANS, 0):
        monkeypatch.setattr(ingest, "FEW_SPANS", few)
        spans = spark.createDataFrame([(int(day(i).timestamp() * 1000),) for i in (3, 4)], "base_time bigint")
        old = store._touched(table, spans)
        assert sorted(r.x for r in old.collect()) == [3, 4]
        plan = old._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and (" IN (" in plan if few else ">=" in plan)
    with monkeypatch.context() as m:
        m.setattr(ingest.Store, "_touched", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(RuntimeError, match="dies"):
            store.put(table, spark.createDataFrame([(day(50), "a", 1)], shape), "ann")
    assert store.changelog().where("updated_by = 'ann'").count() == 1 and store.read(table).count() == 12
    with store._holding(table), pytest.raises(ingest.StoreBusy):
        store.put(table, spark.createDataFrame([(day(50), "a", 1)], shape))
    (tmp_path / "s" / "_put-t").touch()  # of a put that died
    store.lease_seconds = 0
    store.put(table, spark.createDataFrame([(day(50), "a", 1)], shape))
    assert store.read(table).count() == 13 and not (tmp_path / "s" / "_put-t").exists()


def test_updates_filters_take_operands_in_either_order(spark, tmp_path):
    table = Table("t", [Dimension("A")], [Metric("x", S.BIGINT)])
    store = Store(spark, f"file://{tmp_path}/s")
    e = Engine(spark, Schema({"t": table}, {"t": lambda _: store.read(table)}), store, now=lambda: T0)
    e.sql("UPSERT INTO t (time, A, x) VALUES (TIMESTAMP '2024-03-01', 'a', 1), (TIMESTAMP '2024-03-05', 'a', 1)")
    n = lambda where: e.sql(f"SHOW UPDATES_INTERVALS WHERE {where}").count()
    assert n("'t' = table") == n("table = 't'") == 2 and n("'x' = table") == 0
    assert n("TIMESTAMP '2024-03-02' <= recalculated_at AND 't' = table") == 1
    with pytest.raises(QueryError, match="Unsupported condition"):
        n("TIMESTAMP '2024-03-02' >= recalculated_at")


def test_words_are_stored_and_new_items_added(spark, tmp_path):
    from chronolake.operators.links import TokenIndex

    items = spark.createDataFrame([("красное яблоко",), ("чай",), (None,), ("",)], "item string")
    index = TokenIndex(spark, f"file://{tmp_path}/i", "item")
    assert index.read().count() == 0
    index.add(items.where("item LIKE 'к%'"))
    index.add(items)
    index.add(items)
    assert sorted((r.token, r.item) for r in index.read().collect()) == [("chaj", "чай"), ("krasn", "красное яблоко"), ("yablok", "красное яблоко")]
    assert [r.item for r in links.filter_phrases(items, "item", [["яблоки"]], index=index.read()).collect()] == ["красное яблоко"]


def test_word_search_by_another_tokenizer(spark):
    from chronolake.functions.tokens import Tokenizer

    own = Tokenizer(words=lambda t: None if t is None else t.upper().split("-"), fix=lambda c: F.replace(c, F.lit("_"), F.lit("-")), spell=str.upper)
    df = spark.createDataFrame([(T0, "red_tea", 1), (T0, "green-tea", 2), (T0, None, 3)], "time timestamp, item string, id int")
    t = Table("t", [Dimension("item")], [Metric("id", S.INTEGER)], [phrase_link("item")])
    e = Engine(spark, Schema({"t": t}, {"t": lambda _: df}, tokenizer=own))
    ids = lambda phrase: sorted(r.id for r in e.sql(f"SELECT id FROM t WHERE {ALL} AND ItemsInvertedIndex_phrase = '{phrase}'").collect())
    assert ids("tea") == [1, 2] and ids("re%") == [1] and ids("red-tea") == [1] and ids("te") == []


def test_scans_go_on_where_they_stopped(spark, tmp_path):
    from chronolake.streaming.progress import Progress, resumable

    df = spark.range(10).select((F.lit(T0) + F.make_dt_interval("id")).alias("time"), F.lit("a").alias("A"), F.col("id").cast("double").alias("d"))
    schema = Schema({"e": Table("e", [Dimension("A")], [Metric("d", S.DOUBLE)])}, {"e": lambda _: df})
    progress, seen = Progress(spark, f"file://{tmp_path}/p"), []

    def sink(rows, name):
        if len(seen) == 2:
            seen.append(None)
            raise InterruptedError
        seen.append(sorted(r.d for r in rows.collect()))

    scan = (spark, schema, "e", T0, T0 + timedelta(days=10), timedelta(days=4), progress, sink)
    with pytest.raises(InterruptedError):
        resumable(*scan)
    assert resumable(*scan) == 1 and resumable(*scan) == 0
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], None, [8, 9]]


def test_prepare_hook(spark, engine):
    from dataclasses import replace

    e = Engine(spark, engine.schema, prepare=lambda q: replace(q, limit=2))
    assert e.sql(f"SELECT A FROM t WHERE {ALL}").count() == 2


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(DATA, SHAPE).withColumn("time", F.lit(T0)).write.parquet(f"{tmp_path}/p")
    schema = Schema({"t": Table("t", *COLUMNS)}, {"t": lambda s: s.read.parquet(f"{tmp_path}/p")})
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = Engine(spark, schema).sql(f"SELECT B, sum(d) AS x FROM t WHERE {ALL} AND B = 1 GROUP BY B")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(B,1)" in plan and "GreaterThanOrEqual(time,2024-01-01 00:00:00.0)" in plan and "LessThan(time,202" in plan and "ReadSchema: struct<B:smallint,d:double,time:timestamp>" in plan


def test_time_bounds_of_zoneless_times_and_of_constants_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 3, 1, 23, 0, 0, 999), "a"), (datetime(2024, 3, 2, 1), "b")], "ts timestamp_ntz, A string")
    rows.write.parquet(f"{tmp_path}/p")
    schema = Schema({"t": Table("t", [Dimension("A")], [], time="ts")}, {"t": lambda s: s.read.parquet(f"{tmp_path}/p")})
    e = Engine(spark, schema, now=lambda: T0 + timedelta(days=1))
    df = e.sql("SELECT A FROM t WHERE time >= now() - INTERVAL '1' MONTH AND time <= now()")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-02-02T00:00)" in plan and "LessThan(ts,2024-03-02T00:00:00.001)" in plan
    assert [r.A for r in df.collect()] == ["a"]
    assert [r.A for r in e.sql("SELECT A FROM t WHERE time = TIMESTAMP '2024-03-01 23:00:00'").collect()] == ["a"]


def test_link_declarations(engine):
    assert snake("someFieldName") == "some_field_name"
    text = '{"externalLinks": [{"description": {"linkName": "Org", "dimensionName": "A", "fieldsNames": ["orgName"], "tables": ["t"]}, "connection": {"url": "jdbc:x"}}]}'
    (link, tables), = declared(text, engine.schema)
    assert link.name == "Org" and list(tables) == ["t"]
    for bad in ("{", '{"externalLinks": [{}]}', text.replace('"A"', '"Z"'), text.replace('["t"]', '["z"]')):
        with pytest.raises(QueryError):
            declared(bad, engine.schema)


def test_jdbc_link_reads_only_its_columns(spark, rows):
    seen = []
    reader = lambda s, relation: seen.append(relation) or s.createDataFrame([("k", "v", 1)], "dim_key string, org_name string, other int")
    link = from_jdbc("Org", "dimKey", {"orgName": S.VARCHAR}, "orgs", "jdbc:x", reader=reader)
    assert rows(link.rows(spark)) == [("k", "v")] and seen == ["orgs"]


def test_files_and_results(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert concatenated([a, b]).count() == 2
    to_csv(a, f"{tmp_path}/c")
    assert next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv").read_text() == "x\n1\n"
    arrays = spark.createDataFrame([(1, ["a", "a", "b"]), (2, [])], "k int, v array<string>")
    assert exploded_index(arrays, "k", "v").count() == 2


def test_drift():
    old = Table("t", [Dimension("A")], [Metric("x", S.BIGINT), Metric("y", S.BIGINT)])
    assert drift(old, old) == ([], [])
    assert drift(old, Table("t", [Dimension("A")], [*old.metrics, Metric("z", S.DOUBLE)])) == (["t: metric z is new"], [])
    warnings, errors = drift(old, Table("t", [Dimension("B")], [Metric("x", S.DOUBLE)], span_ms=1))
    assert not warnings and len(errors) == 4


def test_types():
    assert S.by_name("array[bigint]").spark == "array<bigint>" and S.by_name("x") is None
    assert S.widens(S.TINYINT, S.BIGINT) and not S.widens(S.DOUBLE, S.BIGINT) and S.castable(S.DOUBLE, S.BIGINT)
