"""Distinct counts and percentiles: bounds, merging in any order, and the defined results of odd inputs."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.llm import digest, expsketch

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def test_registers_estimate_within_their_interval():
    r = np.random.default_rng(7)
    inside = 0
    for k in range(40):
        n = int(10 ** r.uniform(0.5, 5.5))
        hashes = r.integers(-(2**63), 2**63 - 1, n)
        mins = expsketch.registers(hashes)
        est, low, high = expsketch.estimate(np.array([mins.astype(np.float64).sum()]))
        assert abs(est[0] / n - 1) < 0.1
        inside += low[0] <= n <= high[0]
    assert inside >= 34


def test_registers_merge_by_minimum_and_ignore_repeats():
    r = np.random.default_rng(3)
    a, b = r.integers(-(2**63), 2**63 - 1, 5000), r.integers(-(2**63), 2**63 - 1, 3000)
    both = np.concatenate([a, b, a[:100]])
    assert np.array_equal(np.minimum(expsketch.registers(a), expsketch.registers(b)), expsketch.registers(both))


def items(n, seed):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [(None if r.random() < 0.05 else T0 + timedelta(days=r.randrange(3)), pick(1, 1, 1, 2, None), pick(1, 2, None), None if r.random() < 0.1 else f"item {r.randrange(4000)}", pick(None, None, "", f"c{r.randrange(50)}")) for _ in range(n)]


SHAPE = "dp_time timestamp, kkm_id int, operation_type tinyint, item string, customer_code string"


def exact(data, dim, keys):
    out = {}
    for t, kkm, op, item, code in data:
        value = {"item": item, "customer_code": code, "kkm_id": kkm}[dim]
        row = {"day": t and t.strftime("%Y-%m-%d"), "kkm_id": kkm, "operation_type": op}
        if value is not None:
            out.setdefault(tuple(row[k] for k in keys), set()).add(value)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("n,partitions", [(0, 1), (1, 1), (300, 3), (20000, 5)])
def test_distinct_counts(spark, n, partitions):
    data = items(n, n)
    df = spark.createDataFrame(data, SHAPE).repartition(partitions)
    receipt = spark.createDataFrame(data[: n // 2], SHAPE).select("dp_time", "kkm_id", "operation_type")
    got = expsketch.distinct_counts(expsketch.receipt_distinct(df, receipt)).collect()
    for dim in ("item", "customer_code"):
        for keys in ((), ("day",), ("kkm_id",), ("day", "kkm_id", "operation_type"), ("day", "operation_type")):
            name = ",".join(keys) or "total"
            mine = {tuple({"day": x.day_utc, "kkm_id": x.kkm_id, "operation_type": x.operation_type}[k] for k in keys): x for x in got if x.dim_name == dim and x.table_name == "kkm_items" and x.grouped_by == name}
            want = exact(data, dim, keys)
            assert mine.keys() == want.keys()
            for k, x in mine.items():
                assert not x.exact and abs(x.estimate / want[k] - 1) < 0.17 and x.ci_low <= x.estimate <= x.ci_high
    listed = expsketch.distinct_counts(expsketch.receipt_distinct(df, receipt), exact_lists=True).where("exact AND dim_name = 'item' AND grouped_by = 'kkm_id'").collect()
    want = exact(data, "item", ("kkm_id",))
    assert {(x.kkm_id,): x.estimate for x in listed} == {k: n for k, n in want.items() if n <= expsketch.SEEDS}
    both = [x for x in got if x.table_name == "all" and x.grouped_by == "total"]
    want = exact(data, "kkm_id", ())
    assert len(both) == len(want) and all(abs(x.estimate / sum(want.values()) - 1) < 0.17 for x in both)


def test_partial_sketches_merge_over_days_and_runs(spark):
    """Merging the days' merged sketches again gives the sketch of all days."""
    data = items(20000, 5)
    df = spark.createDataFrame(data, SHAPE)
    none = df.limit(0).select("dp_time", "kkm_id", "operation_type")
    whole = expsketch.receipt_distinct(df, none)
    parts = [expsketch.receipt_distinct(df.where(F.coalesce(F.dayofmonth("dp_time"), F.lit(0)) == d), none) for d in (0, 1, 2, 3)]
    again = expsketch.merge_sketches(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    key = lambda x: (x.src, x.dim, x.kept, x.code)
    a, b = {key(x): (x.seeds, x.mins) for x in whole.collect()}, {key(x): (x.seeds, x.mins) for x in again.collect()}
    assert a == b and any(m is not None for _, m in a.values())


def test_merging_in_small_steps(spark, monkeypatch):
    """Groups that lie across many batches are carried on."""
    monkeypatch.setattr(expsketch, "SEEDS", 4)
    rows = [pa.record_batch([pa.array([0]), pa.array([0], pa.int8()), pa.array([0], pa.int8()), pa.array([0], pa.int8()), pa.array([g]), pa.array([np.arange(i, i + 3).tobytes()]), pa.nulls(1, pa.binary())], names=["node", "src", "dim", "kept", "code", "seeds", "mins"]) for g in (1, 2) for i in range(g * 3)]
    carry, done = None, []
    for b in rows:
        t = expsketch._plain([b])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        out, carry = expsketch._fold(t, final=False)
        done += out
    done += expsketch._fold(carry, final=True)[0]
    got = {x["code"]: x for b in done for x in b.to_pylist()}
    assert np.array_equal(np.frombuffer(got[1]["mins"], np.float32), expsketch.registers(np.arange(5)))
    assert np.array_equal(np.frombuffer(got[2]["mins"], np.float32), expsketch.registers(np.arange(8)))


def test_sets_of_single_hashes_have_the_registers_of_the_whole():
    r = np.random.default_rng(4)
    hashes, sizes = r.integers(-(2**63), 2**63 - 1, 900), np.array([1, 2, 1, 40, 500, 300, 56])
    sets = np.split(hashes, np.cumsum(sizes)[:-1])
    assert np.array_equal(expsketch.vectors(sets[3]).min(axis=0), expsketch.registers(sets[3]))
    assert np.allclose(expsketch.Vectors().sums(hashes, sizes), [expsketch.registers(x).sum(dtype=np.float64) for x in sets], rtol=1e-9)


def test_intervals_hold_small_counts_too():
    r, inside = np.random.default_rng(6), 0
    for k in range(400):
        n = int(r.choice([1, 2, 5, 30]))
        total = expsketch.Vectors().sums(r.integers(-(2**63), 2**63 - 1, n), np.array([n]))
        est, low, high = expsketch.estimate(total)
        inside += low[0] <= n <= high[0]
    assert 0.91 <= inside / 400 <= 0.985


def test_coarse_groups_merge_in_rounds(spark, monkeypatch):
    """More tasks than may meet in one merge: the counts are those of a single round."""
    monkeypatch.setattr(expsketch, "FAN_IN", 2)
    df = spark.createDataFrame(items(6000, 8), SHAPE).repartition(7)
    none = df.limit(0).select("dp_time", "kkm_id", "operation_type")
    rounds = {tuple(x) for x in expsketch.receipt_distinct(df, none).collect()}
    monkeypatch.setattr(expsketch, "FAN_IN", 64)
    assert rounds == {tuple(x) for x in expsketch.receipt_distinct(df, none).collect()}


def test_cluster_bounds():
    r = np.random.default_rng(1)
    for values in (r.normal(size=50000), np.zeros(1000), r.integers(0, 5, 10000).astype(float), np.array([1.0])):
        values = np.sort(values)
        means, weights = digest.cluster(values, np.ones(len(values)))
        assert weights.sum() == len(values) and (np.diff(means) >= 0).all() and len(means) <= 1.1 * digest.DELTA + 2
        q = (np.cumsum(weights) - weights / 2) / len(values)
        assert (weights[weights > 1] / len(values) <= np.pi * np.sqrt(q * (1 - q))[weights > 1] / digest.DELTA * 1.5 + 2 / len(values)).all()


def test_merged_digests_keep_their_rank_error():
    r = np.random.default_rng(2)
    values = np.concatenate([r.lognormal(5, 2, 60000), np.full(20000, 600000.0), r.integers(0, 10, 20000)])
    r.shuffle(values)
    parts = [digest.cluster(np.sort(p), np.ones(len(p))) for p in np.array_split(values, 97)]
    while len(parts) > 1:
        parts = [digest._merge(parts[i : i + 3]) for i in range(0, len(parts), 3)]
    for q, v in zip((0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999), digest.quantiles(*parts[0], (0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)), strict=True):
        low, high = (values < v).mean(), (values <= v).mean()
        assert max(0, low - q, q - high) < 0.01


def test_groups_of_few_values_are_held_value_by_value():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50, digest.EXACT):
        values = np.sort(r.lognormal(5, 2, n).round())
        parts = [digest.cluster(np.sort(p), np.ones(len(p))) for p in np.array_split(r.permutation(values), min(n, 5))]
        means, weights = digest._merge(parts)
        assert (weights == 1).all() or len(set(values)) < n
        got = digest.quantiles(means, weights, (0.01, 0.25, 0.5, 0.99, 1.0))
        assert got.tolist() == [values[max(0, int(np.ceil(q * n - 1e-9)) - 1)] for q in (0.01, 0.25, 0.5, 0.99, 1.0)]


METRICS = "query_id string, partition_id string, start_date timestamp, total_duration bigint, state string, engine string, extra int"


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_percentiles(spark, n):
    r = random.Random(n)
    data = [(f"q{r.randrange(n)}", r.choice([None, "p0"]), r.choice([None, T0, T0 + timedelta(days=1)]), r.choice([None, -1, 0, 5, int(10 ** r.uniform(0, 6))]), r.choice(["OK ", "ok", None]), r.choice(["A", "a", None]), 1) for _ in range(n)]
    got = digest.percentiles(spark.createDataFrame(data, METRICS), (0.1, 0.5, 0.99)).collect()
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    best = {}
    for row in data:
        k = row[:2]
        v = (low(row[3]), (row[4] is not None, row[4] or ""), (row[5] is not None, row[5] or ""), (row[2] is not None, row[2] or T0))
        if k not in best or v > best[k][0]:
            best[k] = (v, row)
    log = [(e and e.strip().upper(), s and s.strip().upper(), t and (t - datetime(1970, 1, 1, tzinfo=UTC)).days, d) for _, (_, _, t, d, s, e, _) in best.values() if d is not None and d >= 0]
    want = {}
    for e, s, day, d in log:
        for kept in range(8):
            want.setdefault((kept, e if kept & 1 else None, s if kept & 2 else None, day if kept & 4 else None), []).append(d)
    assert {(x.kept, x.engine, x.state, x.day): x.n for x in got} == {k: len(v) for k, v in want.items()}
    for x in got:
        values = np.array(want[x.kept, x.engine, x.state, x.day], float)
        assert max(x.rank_errors) <= 0.01
        for q, v, e in zip((0.1, 0.5, 0.99), x.estimates, x.rank_errors, strict=True):
            assert e == pytest.approx(max(0, ((values < v).sum() - q * len(values)) / len(values), (q * len(values) - (values <= v).sum()) / len(values)))
            if len(values) <= digest.EXACT:
                assert v == np.sort(values)[max(0, int(np.ceil(q * len(values) - 1e-9)) - 1)]
