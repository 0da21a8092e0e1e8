"""The operators of problems 1, 2, 3, 5 and 7 against brute force, with nulls, ties, repeats and empty tables."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import bitemporal, incremental, intervals, rolling, tree
from chronolake.plans import problems

T0 = datetime(2025, 1, 1, tzinfo=UTC)
RECEIPT = "row_id bigint, dp_time timestamp, kkm_id int, operation_type tinyint, shift int, total_sum bigint, put_at timestamp, entity string, day int, total double"


def receipts(n, seed, devices=3, days=50):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + timedelta(days=r.randrange(days) if r.random() < 0.3 else r.choice([0, 1, days - 1]), hours=r.choice([0, 23]))
        out.append((i, None if r.random() < 0.03 else at, None if r.random() < 0.03 else r.choice([1] * 3 + list(range(devices))), r.choice([1, None]), r.choice([1, 2]), r.choice([None, 0, 0, 5, 100]), T0 + timedelta(minutes=r.randrange(3)) if r.random() < 0.9 else None, "clash", 7, 0.5))
    return out


def low(x):
    return (x is not None, x) if x is not None else (False, 0)


def brute_rolling(data, periods):
    best = {}
    for row_id, at, dev, op, shift, total, put, *_ in data:
        k = (at, dev, op, shift)
        v = (low(put), low(row_id), total)
        if k not in best or v[:2] > best[k][:2]:
            best[k] = v
    daily = {}
    for (at, dev, _, _), v in best.items():
        if at is not None and dev is not None:
            day = (at - datetime(1970, 1, 1, tzinfo=UTC)).days
            daily.setdefault(dev, {}).setdefault(day, 0)
            daily[dev][day] += v[2] or 0
    out = []
    for dev, by_day in daily.items():
        for day in range(min(by_day), max(by_day) + 1):
            row = [dev, day]
            for n in periods:
                s = sum(by_day.get(d, 0) for d in range(day - n + 1, day + 1))
                row += [s, s / n]
            out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (60, 2), (400, 3)])
def test_rolling_totals(spark, rows, n, seed):
    data = receipts(n, seed)
    df = spark.createDataFrame(data, RECEIPT)
    assert rows(rolling.receipt_rolling(df, (7, 30))) == brute_rolling(data, (7, 30))


def test_rolling_other_periods(spark, rows):
    data = receipts(120, 9)
    assert rows(rolling.receipt_rolling(spark.createDataFrame(data, RECEIPT), (1, 3, 11))) == brute_rolling(data, (1, 3, 11))


@pytest.mark.parametrize("n,partitions,chunk,fan", [(0, 1, 4, 2), (1, 1, 4, 2), (500, 7, 16, 2), (500, 3, 1, 3)])
def test_tree_aggregate(spark, rows, n, partitions, chunk, fan):
    r = random.Random(n)
    data = [(r.choice(["hot", "hot", "hot", "a", None, ""]), r.choice([1, 2]), r.choice([None, 5, -3])) for _ in range(n)]
    df = spark.createDataFrame(data, "k string, j int, v bigint").repartition(partitions)
    got = tree.tree_aggregate(df, ["k", "j"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, chunk, fan)
    want = {}
    for k, j, v in data:
        want.setdefault((k, j), []).append(v)
    want = [(*k, len(x), sum(y) if (y := [v for v in x if v is not None]) else None, min(y, default=None), max(y, default=None)) for k, x in want.items()]
    assert rows(got) == sorted(want, key=repr)


def test_heavy_values_count_null_rows_but_not_null(spark, rows):
    items = spark.createDataFrame([(1, "x", 1, T0)] * 4 + [(2, None, 1, T0)] * 95 + [(3, "y", 1, T0)], "kkm_id int, item string, sum_cents bigint, dp_time timestamp")
    receipt = spark.createDataFrame([], "kkm_id int, total_sum bigint, dp_time timestamp")
    assert rows(tree.heavy_values({"kkm_items": items, "receipt": receipt})) == [("kkm_items", "item", "x"), ("kkm_items", "kkm_id", "1"), ("kkm_items", "kkm_id", "2")]


def test_persistent_tree_floor():
    import numpy as np

    r = np.random.default_rng(1)
    for n, size in ((1, 1), (2, 2), (40, 7), (300, 64), (300, 65)):
        ranks = r.integers(0, size, n)
        t = bitemporal.PersistentTree(ranks, size)
        versions, wanted = r.integers(-1, n, 500), r.integers(-1, size, 500)
        got = t.floor(versions, wanted)
        for v, q, g in zip(versions, wanted, got, strict=True):
            seen = {}
            for i in range(v + 1):
                seen[ranks[i]] = i
            below = [k for k in seen if k <= q]
            assert g == (seen[max(below)] if below else -1)


def brute_bitemporal(events, facts):
    out = []
    for row, ent, at in events:
        if ent is None or at is None:
            continue
        ok = [(vt, ka, a) for e, vt, ka, a in facts if e == ent and None not in (vt, ka, a) and vt <= at and ka <= at]
        if ok:
            out.append((row, max(ok)[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,m,per", [(0, 0, 10), (5, 0, 10), (0, 5, 10), (200, 60, 1000), (400, 150, 20)])
def test_known_attributes(spark, rows, n, m, per):
    """With 20 rows a group both the hot entity's events and its facts are cut."""
    r = random.Random(n + m)
    t = lambda: None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(12))
    ent = lambda: r.choice([None, 1, 1, 1, 1, 2, 3, 9])
    events = [(i, ent(), t()) for i in range(n)]
    facts = [(ent(), t(), t(), i if r.random() > 0.03 else None, {"owner": str(i)} if r.random() > 0.2 else None) for i in range(m)]
    e = spark.createDataFrame(events, "row bigint, entity int, time timestamp")
    f = spark.createDataFrame(facts, "entity int, value_time timestamp, known_at timestamp, attr bigint, field_values map<string,string>")
    got = bitemporal.known_attributes(e, f, ("field_values",), rows_per_group=per)
    want = brute_bitemporal(events, [x[:4] for x in facts])
    assert rows(got.select("row", "attr")) == want
    values = {x[3]: x[4] for x in facts}
    assert all(x.field_values == values[x.attr] for x in got.collect())


UPDATES = "entry_id bigint, table_name string, from_ts timestamp, to_ts timestamp, updated_at timestamp, updated_by string, landed_at timestamp"
RUNS = "run_id bigint, table_name string, recalculated_after timestamp, started_at timestamp, finished_at timestamp, run_status string"


def changelog(n, m, seed):
    r = random.Random(seed)
    t = lambda p=0.0, k=30: None if r.random() < p else T0 + timedelta(hours=r.randrange(k))
    updates = [(i, r.choice(["a", "a", "a", "b", None]), t(0.1, 4), t(0.2, 4), t(0.1, 3), r.choice(["etl", "ETL", None]), t(0.05)) for i in range(n)]
    runs = [(i, r.choice(["a", "a", "b", "c", None]), t(0.4, 4), t(0.05), t(0.5), r.choice(["SUCCEEDED", "SUCCEEDED", "FAILED", "LOST", None])) for i in range(m)]
    return updates, runs


def brute_runs(updates, runs, done=()):
    first = {}
    for e in updates:
        if e[6] is not None:
            k = e[1:6]
            if k not in first or (e[6], e[0]) < (first[k][6], first[k][0]):
                first[k] = e
    good = sorted([x for x in runs if x[5] == "SUCCEEDED" and x[3] is not None], key=lambda x: (x[3], x[0]))
    taken = {}
    for e in first.values():
        for x in good:
            if x[1] is not None and x[1] == e[1] and x[3] >= e[6] and (x[2] is None or (e[2] is not None and x[2] <= e[2])):
                taken.setdefault((x[0], e[2], e[3]), []).append(e)
                break
    return sorted((k[0], e[0], e is max(es, key=lambda y: (low(y[4]), y[0]))) for k, es in taken.items() for e in es)


@pytest.mark.parametrize("n,m,seed", [(0, 0, 1), (10, 0, 2), (0, 10, 3), (300, 40, 4), (150, 300, 5)])
def test_changes_go_to_their_runs(spark, rows, tmp_path, n, m, seed):
    updates, runs = changelog(n, m, seed)
    state = incremental.ChangeState(spark, f"file://{tmp_path}/state")
    got = incremental.advance(state, spark.createDataFrame(updates, UPDATES), spark.createDataFrame(runs, RUNS))
    assert sorted((x.run_id, x.entry_id, x.current) for x in got.collect()) == brute_runs(updates, runs)


def test_hot_tables_are_cut(spark, tmp_path, monkeypatch):
    updates, runs = changelog(400, 120, 6)
    wide = incremental.search_join
    monkeypatch.setattr(incremental, "search_join", lambda *a: wide(*a, rows_per_group=25))
    got = incremental.advance(incremental.ChangeState(spark, f"file://{tmp_path}/s"), spark.createDataFrame(updates, UPDATES), spark.createDataFrame(runs, RUNS))
    assert sorted((x.run_id, x.entry_id, x.current) for x in got.collect()) == brute_runs(updates, runs)


def test_state_survives_a_run_that_dies(spark, tmp_path):
    """What is not committed is taken again, what is committed never."""
    state = incremental.ChangeState(spark, f"file://{tmp_path}/state")
    row = ("t", T0, T0 + timedelta(hours=1), T0, "etl", T0)
    updates = spark.createDataFrame([(1, *row)], UPDATES)
    run = lambda i, status: spark.createDataFrame([(i, "t", None, T0 + timedelta(hours=i), None, status)], RUNS)
    assert incremental.advance(state, updates, run(1, "FAILED")).count() == 0
    before = state.deltas()
    (tmp_path / "state" / "delta-of-a-dead-run").mkdir()  # written but never swapped in
    assert state.deltas() == before
    assert [(x.run_id, x.entry_id) for x in incremental.advance(state, updates, run(2, "SUCCEEDED")).collect()] == [(2, 1)]
    more = spark.createDataFrame([(1, *row), (2, *row[:3], T0 + timedelta(hours=2), "etl", T0), (3, *row)], UPDATES)
    assert [(x.run_id, x.entry_id) for x in incremental.advance(state, more, run(3, "SUCCEEDED")).collect()] == [(3, 2)]
    assert incremental.advance(state, more, run(4, "SUCCEEDED")).count() == 0
    assert state.read().count() == 2
    state.compact()
    assert len(state.deltas()) == 1 and state.read().count() == 2
    assert incremental.advance(state, more, run(5, "SUCCEEDED")).count() == 0


def test_of_two_writers_only_the_first_commits(spark, tmp_path):
    """Both select against one version; the second gets an error and, run again, finds nothing left to take."""
    state = incremental.ChangeState(spark, f"file://{tmp_path}/state")
    a, b = (spark.createDataFrame([x], "k bigint, h bigint") for x in ((1, 1), (2, 2)))
    state.commit(a, state.version())
    other, seen = incremental.ChangeState(spark, f"file://{tmp_path}/state"), state.version()
    assert state.fresh(b, seen).count() == other.fresh(b, seen).count() == 1
    state.commit(b, seen)
    with pytest.raises(incremental.StateChanged):
        other.commit(b, seen)
    with pytest.raises(incremental.StateChanged):
        other._advance([], seen)
    assert other.fresh(b).count() == 0 and sorted(map(tuple, other.read().collect())) == [(1, 1), (2, 2)]


def test_slices_of_a_dense_entity_hold_few_starts(spark, monkeypatch):
    """One entity with all its starts within a second, between two others."""
    kept = []
    monkeypatch.setattr(intervals, "written", lambda df, what: kept.append(df.cache()) or kept[-1])
    data = [("hot", i, i + 2 + 40 * (i % 97 == 0)) for i in range(0, 4000, 3)] + [("a", 1, 2), ("z", 5, 6), (None, 5, 6)]
    got = intervals.islands(spark.createDataFrame(data, "entity string, start bigint, stop bigint"), 100)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_islands(data)
    assert kept[0].groupBy("slice").count().agg(F.max("count")).first()[0] < 250


def test_groups_of_a_search_are_bounded(spark):
    """A key with half of all rows on either side: no group gets more rows of a side than the limit and a little."""
    import pyarrow as pa

    from chronolake.operators.shards import search_join

    left = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("int").alias("key"), "id")
    right = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("int").alias("key"), F.col("id").alias("r"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        keys = set(b["key"].to_pylist())
        hit = [i for i, k in zip(a["id"].to_pylist(), a["key"].to_pylist(), strict=True) if k in keys]
        return pa.table({"id": pa.array(hit, pa.int64()), "a": pa.array([a.num_rows] * len(hit), pa.int64()), "b": pa.array([b.num_rows] * len(hit), pa.int64())})

    got, several = search_join(left, right, "key", "id", search, "id bigint, a bigint, b bigint", rows_per_group=200)
    a, b, n = got.agg(F.max("a"), F.max("b"), F.count_distinct("id")).first()
    assert several and a <= 450 and b <= 450
    assert n == left.join(right.select("key").distinct(), "key", "left_semi").count()


def test_digest_tells_nulls_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), (None, None), ("x", "x")], "a string, b string")
    assert df.select(incremental.digest(F.col("a"), F.col("b"))).distinct().count() == 4


def brute_islands(data):
    out = []
    by = {}
    for ent, a, b in data:
        if a is not None and b is not None and a < b:
            by.setdefault(ent, []).append((a, b))
    for ent, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(ent, "period", a, b) for a, b in merged]
        out += [(ent, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,span,slice_rows", [(0, 10, 5), (1, 10, 5), (60, 200, 7), (300, 3000, 50), (300, 3000, 100000)])
def test_islands(spark, rows, n, span, slice_rows):
    r = random.Random(n)
    data = []
    for _ in range(n):
        a = None if r.random() < 0.05 else r.randrange(-span, span)
        b = None if a is None or r.random() < 0.05 else a + r.choice([-1, 0, 1, 2, 5, 20, span // 3])
        data.append((r.choice(["hot", "hot", "x", None]), a, b))
    assert rows(intervals.islands(spark.createDataFrame(data, "entity string, start bigint, stop bigint"), slice_rows)) == brute_islands(data)


@pytest.mark.parametrize("n,m,seed", [(0, 10, 3), (300, 40, 4), (150, 300, 5)])
def test_replayed_batches_meet_the_committed_state(spark, tmp_path, monkeypatch, n, m, seed):
    """Each batch but the first joins the state, which holds what earlier runs took; the runs' rows stay the same."""
    updates, runs = changelog(n, m, seed)
    met, fresh = [], incremental.ChangeState.fresh
    monkeypatch.setattr(incremental.ChangeState, "fresh", lambda self, df, v: met.append((len(self.deltas()), df.count() - fresh(self, df, v).count())) or fresh(self, df, v))
    got = incremental.replay(incremental.ChangeState(spark, f"file://{tmp_path}/state"), spark.createDataFrame(updates, UPDATES), spark.createDataFrame(runs, RUNS))
    assert sorted((x.run_id, x.entry_id, x.current) for x in got.collect()) == brute_runs(updates, runs)
    assert [d for d, _ in met] == list(range(len(met))) and len(met) > 1
    assert not n or met[-1][1] > 0


def test_registered_runs_are_replayed(spark, monkeypatch):
    seen, fresh = [], incremental.ChangeState.fresh
    monkeypatch.setattr(incremental.ChangeState, "fresh", lambda self, df, v: seen.append(len(self.deltas())) or fresh(self, df, v))
    problems.p5_found(spark, "/root/testdata/sf0.001")
    assert max(seen) > 0


@pytest.mark.parametrize("partitions", [1, 3])
def test_no_merge_gets_more_states_of_a_key_than_the_fan_in(spark, monkeypatch, partitions):
    """A hot key in 64 chunks of four rows, merged four at a time."""
    most, merge = [], tree._merge

    def counted(state, keys, aggs, node):
        most.append(state.groupBy(*keys, node.alias("_to")).count().agg(F.max("count")).first()[0])
        return merge(state, keys, aggs, node)

    monkeypatch.setattr(tree, "_merge", counted)
    df = spark.range(0, 256 * partitions, 1, partitions).select((F.col("id") % 50 == 49).alias("k"), "id")
    got = tree.tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}, chunk_rows=4, fan_in=4)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(most) <= 4 and len(most) >= 3
