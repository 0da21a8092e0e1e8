"""Distinct counts from registers of minimum exponential hash values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.session import shuffle_tasks, written

#: Registers of a sketch. A distinct count has the relative standard error 1 / sqrt(REGISTERS - 2), 3.1 %.
REGISTERS = 1024
#: A sketch of up to so many hashes is carried as these, from which its registers follow without loss: up to here they
#: take no more bytes than the registers. This is a form of storage only; counts are made from the registers.
SEEDS = REGISTERS // 2
CHUNK_ROWS = 250_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SCALE = 1.0 / (REGISTERS - np.arange(REGISTERS))


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(seed: np.ndarray, first: int, last: int) -> np.ndarray:
    """Registers of each hash's points first..last-1: a permutation of all registers, drawn by the hash."""
    key, top = _mix(seed ^ _GOLDEN), np.uint16(REGISTERS - 1)
    part = lambda shift: (key >> np.uint64(shift)).astype(np.uint16)[:, None]
    v = np.arange(first, last, dtype=np.uint16)[None, :] ^ (part(0) & top)
    v = (v * (part(10) | np.uint16(1))) & top
    v ^= v >> np.uint16(5)
    v = (v * (part(26) | np.uint16(1)) + part(42)) & top
    v ^= v >> np.uint16(5)
    return (v * (part(48) | np.uint16(1))) & top


#: The first points, which alone matter to large sets, are drawn from 53 bits, the others from 24.
FINE = 64


def _points(seed: np.ndarray, t: np.ndarray, first: int, last: int) -> np.ndarray:
    """A hash's points first..last-1 behind its point ``t``; both of a range lie below FINE or neither."""
    if first < FINE:
        bits = _mix(seed[:, None] + (_GOLDEN * np.arange(first + 1, last + 1, dtype=np.uint64))[None, :])
        gaps = -np.log(((bits >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) * _SCALE[first:last]
    else:
        key = _mix(seed + _GOLDEN)
        low, odd = key.astype(np.uint32)[:, None], (key >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        x = low + odd * np.arange(first, last, dtype=np.uint32)[None, :]
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        gaps = ((x >> np.uint32(8)) + np.uint32(1)).astype(np.float32)
        gaps *= np.float32(2.0**-24)
        np.log(gaps, out=gaps)
        gaps *= -_SCALE[first:last].astype(np.float32)
    gaps[:, 0] += t.astype(gaps.dtype)
    return np.cumsum(gaps, axis=1, out=gaps)  # one after another, so that ranges do not matter to the sums


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, float32.

    A hash gives every register an exponential value of rate 1, and a register holds the least over all hashes, so over
    n distinct hashes the registers are exponentials of rate n. A hash's values are made in ascending order (of k values
    left the least is an exponential of rate k, and falls to a register drawn at random), so the hash is done once it has
    passed the largest register. Repeated hashes change nothing.
    """
    out = np.full(REGISTERS, np.inf, np.float32)
    with np.errstate(over="ignore"):
        seed = hashes.astype(np.int64).view(np.uint64)
        t, k = np.zeros(len(seed)), 0
        while len(seed) and k < REGISTERS:
            last = min(REGISTERS if k >= FINE else FINE, k + max(1, min(FINE, 2 * REGISTERS // len(seed))))
            at = _points(seed, t, k, last)
            np.minimum.at(out, _places(seed, k, last).ravel().astype(np.int64), at.astype(np.float32).ravel())
            t, k = at[:, -1], last
            going = t < out.max()
            seed, t = seed[going], t[going]
    return out


def vectors(hashes: np.ndarray) -> np.ndarray:
    """The registers of each hash alone, a row each; a set's sketch is their minimum."""
    out = np.empty((len(hashes), REGISTERS), np.float32)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), 128):
            seed = hashes[a : a + 128].astype(np.int64).view(np.uint64)
            n = len(seed)
            fine = _points(seed, np.zeros(n), 0, FINE)
            rest = _points(seed, fine[:, -1], FINE, REGISTERS)
            at = _places(seed, 0, REGISTERS).astype(np.int64) + (np.arange(n) * REGISTERS)[:, None]
            out[a : a + n].reshape(-1)[at] = np.concatenate([fine.astype(np.float32), rest], axis=1)
    return out


class Vectors:
    """The registers of single hashes, of which the first met are kept for later use (64 MB at most)."""

    KEPT = 16_384

    def __init__(self) -> None:
        self.keys, self.rows, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.table = np.empty((self.KEPT, REGISTERS), np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Rows for distinct hashes."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(self.n - 1, 0))
        known = self.keys[at] == hashes if self.n else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), REGISTERS), np.float32)
        out[known] = self.table[self.rows[at[known]]]
        if not known.all():
            new = hashes[~known]
            out[~known] = made = vectors(new)
            room = min(self.KEPT - self.n, len(new))
            if room:
                self.table[self.n : self.n + room] = made[:room]
                keys, rows = np.r_[self.keys, new[:room]], np.r_[self.rows, self.n + np.arange(room)]
                order = np.argsort(keys)
                self.keys, self.rows, self.n = keys[order], rows[order], self.n + room
        return out

    def sums(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the registers of sets, given one after another with their sizes (of at least 1)."""
        out = np.empty(len(sizes))
        ends = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            begin = int(ends[a] - sizes[a])
            b = max(a + 1, int(np.searchsorted(ends, begin + 4096, "right")))
            own, inverse = np.unique(hashes[begin : ends[b - 1]], return_inverse=True)
            rows, size = self.of(own), sizes[a:b]
            order = np.argsort(-size, kind="stable")
            start, size = (ends[a:b] - size - begin)[order], size[order]
            least = rows[inverse[start]]
            for nth in range(1, int(size[0])):
                n = int(np.searchsorted(-size, -nth, "left"))  # sets that have another one
                np.minimum(least[:n], rows[inverse[start[:n] + nth]], out=least[:n])
            out[a + order] = least.sum(axis=1, dtype=np.float64)
            a = b
        return out


def estimate(total: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbiased count and its confidence interval from the sums of sketches' registers.

    The sum over n distinct values is Gamma(m, 1 / n), whence E[(m - 1) / sum] = n; the bounds are its quantiles (Wilson
    and Hilferty's cube, which at this shape is exact to 1e-5).
    """
    m, z = REGISTERS, NormalDist().inv_cdf((1 + level) / 2)
    cube = lambda s: m * (1 - 1 / (9 * m) + s * z / (3 * np.sqrt(m))) ** 3
    return (m - 1) / total, cube(-1) / total, cube(1) / total


# Grouping keys in one integer: day, kkm_id, operation_type; 0 in a part stands for null.
_PARTS = {"day": (42, 20, 1 << 19), "kkm_id": (9, 33, (1 << 31) + 1), "operation_type": (0, 9, 129)}
KEYS = tuple(_PARTS)


def _mask(kept: int) -> int:
    return sum(((1 << bits) - 1) << shift for i, (shift, bits, _) in enumerate(_PARTS.values()) if kept >> i & 1)


def _code(columns: dict[str, pa.ChunkedArray]) -> np.ndarray:
    out = 0
    for name, (shift, _, offset) in _PARTS.items():
        v = columns[name].cast(pa.int64())
        out = out | (pa.compute.fill_null(pa.compute.add(v, offset), 0).to_numpy().astype(np.int64) << shift)
    return out


def _blob(values: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary array over consecutive pieces of ``values``."""
    ends = np.r_[0, np.cumsum(lengths * values.itemsize)]
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of partial sketches exceeds 2 GB")
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [mask, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


PARTIAL = "dim tinyint, kept tinyint, code bigint, seeds binary, mins binary"
_PARTIAL = pa.schema([("dim", pa.int8()), ("kept", pa.int8()), ("code", pa.int64()), ("seeds", pa.binary()), ("mins", pa.binary())])


def _states(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, hash) pairs in order: hashes, the groups, their starts and sizes."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    keep = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
    g, v = g[keep], v[keep]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return v, g[starts], starts, np.diff(np.r_[starts, len(g)])


#: Full sketches that a task holds at most before it hands them on.
HELD = 2048


def _full(held: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
    keys, n = list(held), len(held)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int8(), pa.int8(), pa.int64()))]
    return pa.record_batch([*columns, pa.nulls(n, pa.binary()), pa.array([m.tobytes() for m in held.values()], pa.binary())], schema=_PARTIAL)


def _partials(ids: tuple[str, ...], finest: dict[str, int]):
    """Short lists of hashes go on as they come; registers are merged within the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held: dict[tuple[int, int, int], np.ndarray] = {}
        n = 0
        for batch in batches:
            rows.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield from chunk(pa.Table.from_batches(rows), held)
                rows, n = [], 0
                if len(held) > HELD:
                    yield _full(held)
                    held.clear()
        if rows:
            yield from chunk(pa.Table.from_batches(rows), held)
        if held:
            yield _full(held)

    def chunk(t: pa.Table, held: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        code = _code({k: t[k] for k in KEYS})
        for d, name in enumerate(ids):
            there = t[name].is_valid().to_numpy()
            value = t[name].fill_null(0).to_numpy()[there]
            kept = finest[name]
            yield from _forms(held, d, kept, *_states(code[there] & _mask(kept), value))

    return run


def _forms(held: dict, dim: int, kept: int, v: np.ndarray, groups: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Short lists as a batch; the registers of longer ones are merged into ``held``."""
    few = sizes <= SEEDS
    inside = np.repeat(few, sizes)
    n = int(few.sum())
    if n:
        yield pa.record_batch([pa.array(np.full(n, dim, np.int8)), pa.array(np.full(n, kept, np.int8)), pa.array(groups[few]), _blob(v[inside], sizes[few]), pa.nulls(n, pa.binary())], schema=_PARTIAL)
    for i in np.flatnonzero(~few):
        _hold(held, (dim, kept, int(groups[i])), registers(v[starts[i] : starts[i] + sizes[i]]))


def _hold(held: dict, key: tuple[int, int, int], mins: np.ndarray) -> None:
    held[key] = np.minimum(held[key], mins) if key in held else mins


def partial_sketches(rows: DataFrame, ids: tuple[str, ...], finest: dict[str, int]) -> DataFrame:
    """Sketches of the chunks of ``rows`` in the finest grouping of every identifier; a row for each (dim, kept, code).

    ``rows``: day (int), kkm_id, operation_type and a 64-bit hash column for each of ``ids``. ``finest``: the grouping
    of each identifier as a bit mask over KEYS. Null identifiers aren't counted; null keys are keys. Nothing is
    shuffled: a chunk's rows become its sketches where they were read.
    """
    return rows.select(*KEYS, *ids).mapInArrow(_partials(ids, finest), PARTIAL)


def _rolled(sets: dict[int, tuple[int, ...]]):
    """Coarser sketches from a task's finest ones, merged within the task as far as they are registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[int, int, int], np.ndarray]] = {}
        rows: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            rows.append(batch)
            size += batch.nbytes
            if size >= 8 << 20:
                yield from chunk(_plain(rows), held)
                rows, size = [], 0
                if sum(map(len, held.values())) > HELD:
                    yield from flush(held)
        if rows:
            yield from chunk(_plain(rows), held)
        yield from flush(held)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for src, full in held.items():
            if full:
                yield tagged(src, _full(full))
        held.clear()

    def tagged(src: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(b.num_rows, src, np.int8)), *b.columns], names=["src", *b.schema.names])

    def chunk(t: pa.Table, held: dict) -> Iterator[pa.RecordBatch]:
        src, dim, code = (t[c].to_numpy() for c in ("src", "dim", "code"))
        seeds, lengths = _pieces(t["seeds"].fill_null(b""), np.int64)
        mins, full = _pieces(t["mins"].fill_null(b""), np.float32)
        row, number = np.repeat(np.arange(len(src)), lengths), np.cumsum(full > 0) - 1
        for s, d in sorted(set(zip(src.tolist(), dim.tolist(), strict=True))):
            own = (src == s) & (dim == d)
            mine = own[row]
            into = held.setdefault(s, {})
            for kept in sets[d]:
                for b in _forms(into, d, kept, *_states(code[row[mine]] & _mask(kept), seeds[mine])):
                    yield tagged(s, b)
                for r in np.flatnonzero(own & (full > 0)):
                    _hold(into, (d, kept, int(code[r]) & _mask(kept)), mins[number[r] * REGISTERS : (number[r] + 1) * REGISTERS])

    return run


#: Partial sketches of a group that meet in one task of a merge at most come from so many tasks of the step before.
FAN_IN = 64


def coarser(finest: DataFrame, sets: dict[int, tuple[int, ...]]) -> DataFrame:
    """Sketches of the groupings ``sets`` (by dim) from merged finest ones, ``finest`` being a written table.

    A coarse group has a partial from every task, so merging goes in rounds of at most FAN_IN tasks each.
    """
    partials, tasks = finest.mapInArrow(_rolled(sets), MERGED), finest.rdd.getNumPartitions()
    node = F.spark_partition_id().cast("bigint")
    while tasks > FAN_IN:
        partials = _merge(partials.withColumn("node", F.floor(node / FAN_IN)))
        node, tasks = F.col("node"), -(-tasks // FAN_IN)
    return merge_sketches(partials)


_HEAD = ("node", "src", "dim", "kept", "code")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of equal (node, src, dim, kept, code), which come sorted, carrying the last group to the next batch."""
    carry: pa.Table | None = None
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < 20_000 and size < 32 << 20:
            continue
        t = _plain(held)
        t = pa.concat_tables([carry, t]) if carry is not None else t
        held, n, size = [], 0, 0
        done, carry = _fold(t, final=False)
        yield from done
    if held or carry is not None:
        tables = ([carry] if carry is not None else []) + ([_plain(held)] if held else [])
        done, _ = _fold(pa.concat_tables(tables), final=True)
        yield from done


def _plain(batches: list[pa.RecordBatch]) -> pa.Table:
    """The batches as a table in the form in which groups are carried."""
    t = pa.Table.from_batches(batches)
    return pa.table({c: t[c] for c in (*_HEAD, "seeds", "mins") if c in t.schema.names})


def _pieces(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another, and how many each row has."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // size


def _fold(t: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
    if not t.num_rows:
        return [], None
    head = [t[c].to_numpy() for c in _HEAD]
    new = np.r_[True, np.any([h[1:] != h[:-1] for h in head], axis=0)]
    starts = np.flatnonzero(new)
    group, n = np.cumsum(new) - 1, len(starts)
    seeds, lengths = _pieces(t["seeds"].fill_null(b""), np.int64)
    mins, full = _pieces(t["mins"].fill_null(b""), np.float32)
    v, groups, vstarts, sizes = _states(np.repeat(group, lengths), seeds)
    size, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[groups], at[groups] = sizes, vstarts
    dense = size > SEEDS
    dense[group[full > 0]] = True
    state: dict[int, np.ndarray] = {}
    rows = np.flatnonzero(full > 0)
    for i, r in enumerate(rows):
        g = int(group[r])
        m = mins[i * REGISTERS : (i + 1) * REGISTERS]
        state[g] = np.minimum(state[g], m) if g in state else m
    for g in np.flatnonzero(dense):
        if size[g]:
            m = registers(v[at[g] : at[g] + size[g]])
            state[int(g)] = np.minimum(state[int(g)], m) if int(g) in state else m
    out_sizes = np.where(dense, 0, size)
    keep = np.repeat(~dense[groups], sizes)
    full_sizes = np.where(dense, REGISTERS, 0)
    all_mins = np.concatenate([state[int(g)] for g in np.flatnonzero(dense)]) if dense.any() else np.zeros(0, np.float32)
    merged = pa.table({**{k: pa.array(h[starts]) for k, h in zip(_HEAD, head, strict=True)}, "seeds": _blob(v[keep], out_sizes, ~dense), "mins": _blob(all_mins, full_sizes, dense)})
    if final:
        return merged.to_batches(), None
    return merged.slice(0, n - 1).to_batches(), merged.slice(n - 1)


MERGED = "src tinyint, " + PARTIAL


def _merge(partials: DataFrame) -> DataFrame:
    shuffled = partials.select(*_HEAD, "seeds", "mins").repartition(shuffle_tasks(partials.sparkSession), *_HEAD).sortWithinPartitions(*_HEAD)
    return shuffled.mapInArrow(_merged, "node bigint, " + MERGED)


def merge_sketches(partials: DataFrame) -> DataFrame:
    """One sketch for each (src, dim, kept, code): registers merged elementwise by minimum, short lists united.

    The result has the form of its input, so sketches of days, tables or runs merge again at any time. A group's
    partial sketches, one from each chunk at most, pass through one by one; none are gathered.
    """
    return _merge(partials.withColumn("node", F.lit(0).cast("bigint"))).drop("node")


def _counted(exact_lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = Vectors()
        for b in batches:
            if not b.num_rows:
                continue
            listed = b["mins"].is_null().to_numpy(zero_copy_only=False)
            seeds, lengths = _pieces(b["seeds"].fill_null(b""), np.int64)
            total = np.empty(b.num_rows)
            if exact_lists:
                total[listed] = 1.0
            elif listed.any():
                total[listed] = single.sums(seeds, lengths[listed])
            if not listed.all():
                mins, _ = _pieces(b["mins"].fill_null(b""), np.float32)
                total[~listed] = mins.reshape(-1, REGISTERS).sum(axis=1, dtype=np.float64)
            n, low, high = estimate(total)
            if exact_lists:
                n[listed] = low[listed] = high[listed] = lengths[listed]
            yield pa.record_batch([b["src"], b["dim"], b["kept"], b["code"], pa.array(n), pa.array(low), pa.array(high), pa.array(listed & exact_lists)], names=["src", "dim", "kept", "code", "estimate", "ci_low", "ci_high", "exact"])

    return run


SOURCES = ("kkm_items", "receipt", "all")
IDS = ("customer_code", "item", "kkm_id")
#: Names of the groupings by their bit masks.
SETS = tuple(",".join(k for i, k in enumerate(KEYS) if s >> i & 1) or "total" for s in range(8))


def receipt_distinct(items: DataFrame, receipt: DataFrame) -> DataFrame:
    """Merged sketches of the distinct customer_code, item and kkm_id, as written, of both tables.

    Per day (UTC, of dp_time), kkm_id, operation_type and every combination of them; kkm_id also over both tables
    together (src 2). The distinct kkm_id per kkm_id is 1 and left out. Rows are sketched once, in the finest grouping;
    all others come from merging its sketches.
    """
    day = F.unix_date(F.col("dp_time").cast("date")).alias("day")
    every, no_kkm = tuple(range(8)), (0, 1, 4, 5)
    hashed = lambda c, name: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(name)
    from_items = items.select(day, "kkm_id", "operation_type", hashed("customer_code", "c"), hashed("item", "i"), hashed("kkm_id", "k"))
    a = partial_sketches(from_items, ("c", "i", "k"), {"c": 7, "i": 7, "k": 5}).withColumn("src", F.lit(0).cast("tinyint"))
    from_receipt = receipt.select(day, "kkm_id", "operation_type", hashed("kkm_id", "k"))
    b = partial_sketches(from_receipt, ("k",), {"k": 5}).withColumn("dim", F.lit(2).cast("tinyint")).withColumn("src", F.lit(1).cast("tinyint"))
    sources = F.when(F.col("dim") == 2, F.array("src", F.lit(2).cast("tinyint"))).otherwise(F.array("src"))
    finest = written(merge_sketches(a.unionByName(b).select(F.explode(sources).alias("src"), "dim", "kept", "code", "seeds", "mins")), "sketches")
    return finest.unionByName(coarser(finest, {0: every[:-1], 1: every[:-1], 2: no_kkm[:-1]}))


def distinct_counts(sketches: DataFrame, exact_lists: bool = False) -> DataFrame:
    """Readable counts: table_name, dim_name, grouped_by, day_utc, kkm_id, operation_type, estimate, ci_low, ci_high (95 %), exact.

    ``grouped_by`` names the keys kept; a null in one of these is a null key, in the others "all". Every count is the
    registers' estimate, unless ``exact_lists`` asks for the lengths of the lists that hold short sketches (``exact``).
    """
    got = sketches.mapInArrow(_counted(exact_lists), "src tinyint, dim tinyint, kept tinyint, code bigint, estimate double, ci_low double, ci_high double, exact boolean")

    def part(name: str, i: int):
        shift, bits, offset = _PARTS[name]
        raw = F.shiftright("code", shift).bitwiseAND(F.lit((1 << bits) - 1))
        return F.when((F.col("kept").bitwiseAND(F.lit(1 << i)) != 0) & (raw != 0), raw - offset).cast("int")

    name = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(c) + 1)
    return got.select(
        name(SOURCES, "src").alias("table_name"), name(IDS, "dim").alias("dim_name"), name(SETS, "kept").alias("grouped_by"),
        F.date_format(F.date_from_unix_date(part("day", 0)), "yyyy-MM-dd").alias("day_utc"), part("kkm_id", 1).alias("kkm_id"), part("operation_type", 2).alias("operation_type"),
        "estimate", "ci_low", "ci_high", "exact",
    )


def exact_counts(items: DataFrame, receipt: DataFrame) -> DataFrame:
    """The same groups with their exact count ``n``, to hold estimates against: what the sketches are made to avoid."""
    day = F.date_format("dp_time", "yyyy-MM-dd").alias("day_utc")
    keys = ("day_utc", "kkm_id", "operation_type")
    a, b = (df.select(day, "kkm_id", F.col("operation_type").cast("int").alias("operation_type"), *[c for c in IDS[:2] if c in df.columns]) for df in (items, receipt.select("dp_time", "kkm_id", "operation_type")))
    parts = []
    for source, dim, df in ((0, 0, a), (0, 1, a), (0, 2, a), (1, 2, b), (2, 2, a.select(*keys).unionByName(b))):
        by = keys if dim < 2 else ("day_utc", "operation_type")
        pairs = df.select(*by, F.col(IDS[dim]).alias("x")).where("x IS NOT NULL").distinct()
        kept = sum((1 - F.grouping(k)) * (1 << keys.index(k)) for k in by).cast("int")
        got = pairs.cube(*by).agg(F.count_distinct("x").alias("n"), kept.alias("kept"))
        kkm = F.col("kkm_id") if dim < 2 else F.lit(None).cast("int")
        parts.append(got.select(F.lit(SOURCES[source]).alias("table_name"), F.lit(IDS[dim]).alias("dim_name"), F.element_at(F.array(*[F.lit(x) for x in SETS]), F.col("kept") + 1).alias("grouped_by"), "day_utc", kkm.alias("kkm_id"), "operation_type", "n"))
    return reduce(DataFrame.unionAll, parts)
