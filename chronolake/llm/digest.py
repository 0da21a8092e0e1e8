"""Percentiles from merging centroid digests, with the rank error counted in a second pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.session import shuffle_tasks, written

#: A digest has at most about DELTA centroids, and none holds more than pi * sqrt(q (1 - q)) / DELTA * 2 of the values.
DELTA = 400
CHUNK_ROWS = 250_000
KEYS = ("engine", "state", "day")
STATE = "engine string, state string, day int, n double, means binary, weights binary"
#: What no estimate's rank is off by, as a share of its group. Groups of up to EXACT values are held value by value.
MAX_RANK_ERROR, EXACT = 0.01, 200


def cluster(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted weighted values: neighbours are joined while their span on the arcsine scale stays below 1.

    On the scale k(q) = DELTA / (2 pi) asin(2q - 1) a step is short near the tails and long in the middle. Values fall
    into the cell of the scale that holds their middle rank, all at once.
    """
    total = weights.sum()
    q = (np.cumsum(weights) - weights / 2) / total
    cell = np.floor(DELTA / np.pi * np.arcsin(np.clip(2 * q - 1, -1, 1)))
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    w = np.add.reduceat(weights, starts)
    return np.add.reduceat(values * weights, starts) / w, w


def quantiles(means: np.ndarray, weights: np.ndarray, qs: Sequence[float]) -> np.ndarray:
    """Values at the ranks ``qs``, of which the k-th value holds those from (k - 1) / n, exclusive, to k / n.

    Where a rank falls into a centroid of one value it is that value; else it is interpolated between the centroids'
    middle ranks.
    """
    upto, rank = np.cumsum(weights), np.asarray(qs) * weights.sum()
    at = np.minimum(np.searchsorted(upto, rank, "left"), len(means) - 1)
    return np.where(weights[at] == 1, means[at], np.interp(rank, upto - weights / 2, means))


#: Digests that a task holds at most before it hands them on.
HELD = 4096
Key = tuple[int, str | None, str | None, int | None]
Digest = tuple[np.ndarray, np.ndarray]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each group that a task meets (or a few, if it meets very many groups)."""
    rows: list[pa.RecordBatch] = []
    held: dict[Key, list[Digest]] = {}

    def absorb() -> None:
        for key, d in _chunk(pa.Table.from_batches(rows)):
            parts = held.setdefault(key, [])
            parts.append(d)
            if len(parts) == 16:
                held[key] = [_merge(parts)]
        rows.clear()

    for batch in batches:
        rows.append(batch)
        if sum(b.num_rows for b in rows) >= CHUNK_ROWS:
            absorb()
            if len(held) > HELD:
                yield _batch(held)
                held.clear()
    if rows:
        absorb()
    if held:
        yield _batch(held)


def _batch(held: dict[Key, list[Digest]]) -> pa.RecordBatch:
    digests = [_merge(parts) for parts in held.values()]
    columns = [pa.array([k[i] for k in held], t) for i, t in enumerate((pa.int8(), pa.string(), pa.string(), pa.int32()))]
    return pa.record_batch([*columns, pa.array([float(w.sum()) for _, w in digests]), pa.array([m.tobytes() for m, _ in digests], pa.binary()), pa.array([w.tobytes() for _, w in digests], pa.binary())], names=["kept", *KEYS, "n", "means", "weights"])


def _chunk(t: pa.Table) -> Iterator[tuple[Key, Digest]]:
    """A digest for each group of rows under each combination of the keys."""
    if not t.num_rows:
        return
    codes = [t[k].combine_chunks().dictionary_encode(null_encoding="encode") for k in KEYS]
    codes = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in codes]
    names = [c.dictionary.to_pylist() for c in codes]
    indices = [c.indices.to_numpy().astype(np.int64) for c in codes]
    value = t["value"].to_numpy().astype(np.float64)
    by_value = np.argsort(value, kind="stable")
    value = value[by_value]
    for kept in range(1 << len(KEYS)):
        group = np.zeros(len(value), np.int64)
        for i, (index, name) in enumerate(zip(indices, names, strict=True)):
            if kept >> i & 1:
                group = group * len(name) + index[by_value]
        order = np.argsort(group, kind="stable")  # values stay in order within their group
        g, v = group[order], value[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(g)], strict=True):
            code, key = int(g[a]), [None] * len(KEYS)
            for i in reversed(range(len(KEYS))):
                if kept >> i & 1:
                    code, at = divmod(code, len(names[i]))
                    key[i] = names[i][at]
            yield (kept, *key), cluster(v[a:b], np.ones(b - a))


def partial_digests(rows: DataFrame) -> DataFrame:
    """Digests of ``rows`` (engine, state, day, value) for every combination of the keys, ``kept`` telling which are kept.

    No row is shuffled: a task hands on one digest for each group it met.
    """
    return rows.where(F.col("value").isNotNull()).select(*KEYS, F.col("value").cast("double").alias("value")).mapInArrow(_digests, f"kept tinyint, {STATE}")


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    means, weights = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(means, kind="stable")
    return cluster(means[order], weights[order])


def _merged(qs: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            keys = list(zip(*[b[k].to_pylist() for k in ("kept", *KEYS)], strict=True))
            means, weights = b["means"], b["weights"]
            out = []
            for i, key in enumerate(keys):
                if key != now:
                    if parts:
                        out.append((now, _merge(parts)))
                    now, parts = key, []
                parts.append((np.frombuffer(means[i].as_buffer(), np.float64), np.frombuffer(weights[i].as_buffer(), np.float64)))
                if len(parts) == 32:  # a group with digests of very many chunks is merged as they come
                    parts = [_merge(parts)]
            if out:
                yield result(out)
        if parts:
            yield result([(now, _merge(parts))])

    def result(done: list) -> pa.RecordBatch:
        base = _batch({k: [d] for k, d in done})
        est = pa.array([list(map(float, quantiles(m, w, qs))) for _, (m, w) in done], pa.list_(pa.float64()))
        return pa.record_batch([*base.columns, est], names=[*base.schema.names, "estimates"])

    return run


def merge_digests(partials: DataFrame, qs: Sequence[float]) -> DataFrame:
    """One digest for each (kept, engine, state, day) and its ``estimates`` at ``qs``; the digests can be merged on."""
    by = ("kept", *KEYS)
    return partials.repartition(shuffle_tasks(partials.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(_merged(tuple(qs)), f"kept tinyint, {STATE}, estimates array<double>")


def _masked(df: DataFrame, kept: Column, prefix: str = "") -> DataFrame:
    """``df`` with the keys that ``kept`` does not keep set to null."""
    return df.withColumns({f"{prefix}{k}": F.when(kept.bitwiseAND(F.lit(1 << i)) != 0, F.col(k)) for i, k in enumerate(KEYS)})


def _on(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def certify(estimates: DataFrame, rows: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Count for each estimate the values below and up to it, in a second pass over ``rows``.

    A rank error is how far q n lies outside [count below, count up to] the estimate, over n. Adds ``rank_errors`` (one a
    q) and drops the digests. Equal values of a finest group are counted together, meet the estimates of the eight groups
    they belong to in one join row, and are summed per finest group before anything is shuffled again.
    """
    sets, n = 1 << len(KEYS), len(qs)
    named = estimates.select(*[F.col(c).alias(f"_{c}") for c in ("kept", *KEYS)], "estimates")
    finest = estimates.where(F.col("kept") == sets - 1).select(*KEYS, F.explode(F.array(*[F.lit(i).cast("tinyint") for i in range(sets)])).alias("kept"))
    wide = _masked(finest, F.col("kept"), "m_").join(named, (F.col("kept") == F.col("_kept")) & _on([f"m_{k}" for k in KEYS], [f"_{k}" for k in KEYS]))
    cuts = wide.groupBy(*KEYS).agg(F.collect_list(F.struct("kept", "estimates")).alias("cuts")).select(*[F.col(k).alias(f"_{k}") for k in KEYS], "cuts")
    counts = rows.where(F.col("value").isNotNull()).groupBy(*KEYS, F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("w"))
    hit = counts.join(cuts, _on(KEYS, [f"_{k}" for k in KEYS])).select(*KEYS, "value", "w", F.explode("cuts").alias("x"))
    names = [f"{name}_{i}" for i in range(n) for name in ("lt", "le")]
    sums = [F.sum(F.when(test(F.col("value"), F.col("x.estimates")[i]), F.col("w")).otherwise(0)).alias(f"{name}_{i}") for i in range(n) for name, test in (("lt", lambda a, b: a < b), ("le", lambda a, b: a <= b))]
    own = hit.groupBy(*KEYS, F.col("x.kept").alias("kept")).agg(*sums)
    total = _masked(own, F.col("kept")).groupBy("kept", *KEYS).agg(*[F.sum(c).alias(c) for c in names]).select(*[F.col(c).alias(f"_{c}") for c in ("kept", *KEYS)], *names)
    got = estimates.join(total, (F.col("kept") == F.col("_kept")) & _on(KEYS, [f"_{k}" for k in KEYS]))
    errors = [F.greatest(F.lit(0.0), F.col(f"lt_{i}") - q * F.col("n"), q * F.col("n") - F.col(f"le_{i}")) / F.col("n") for i, q in enumerate(qs)]
    return got.select("kept", *KEYS, F.col("n").cast("bigint").alias("n"), "estimates", F.array(*errors).alias("rank_errors"))


def query_log(metrics: DataFrame) -> DataFrame:
    """Rows engine, state, day, value of the query log.

    A report saved twice (equal query_id and partition_id, null being a value) counts once, with the greatest
    total_duration, then state, engine and start_date. Spellings differing in case or outer blanks are one. Null and
    negative durations are no durations; a report without start_date has the day null.
    """
    key = F.max(F.struct("total_duration", "state", "engine", "start_date")).alias("r")
    once = metrics.groupBy("query_id", "partition_id").agg(key).select("r.*")
    return once.where(F.col("total_duration") >= 0).select(
        F.upper(F.trim("engine")).alias("engine"), F.upper(F.trim("state")).alias("state"),
        F.unix_date(F.col("start_date").cast("date")).alias("day"), F.col("total_duration").alias("value"),
    )


def percentiles(metrics: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles of total_duration for each combination of engine, state and day, with counted rank errors."""
    rows = written(query_log(metrics), "query-log")
    merged = written(merge_digests(partial_digests(rows), qs), "digests")
    return certify(merged, rows, qs)
