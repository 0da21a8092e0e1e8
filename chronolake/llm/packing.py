"""Filling containers of fixed capacity with whole texts."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.session import spread, written

#: Tokens in a container.
CAPACITY = 4096
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Parts of the hot numbering windows: items of one length are numbered in so many parts.
PARTS = 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path or tokenizer_path()).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of the whole text of every row; null and empty texts have 0.

    ``path``: a vocabulary file for tiktoken, by default the multilingual byte-level one.
    """
    return spread(documents.select("doc_id", "text")).mapInArrow(_counter(path), "doc_id bigint, n_tokens bigint")


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> tuple[int, dict[int, int]]:
    """The multiset of remaining lengths whose sum comes closest to ``room`` without exceeding it.

    Bit s of a bitset says that some multiset sums to s. Lengths join longest first, each as many times as there are
    items, in copies of 1, 2, 4, ... at a time; ``lengths`` are the keys of ``counts``, descending. As soon as the room
    is filled exactly the rest need not join. How many of each length the best sum takes is read off backwards.
    """
    reach, before, full = 1, [], (1 << (room + 1)) - 1
    for size in lengths:
        left = min(counts[size], room // size)
        if not left:
            continue
        before.append((size, reach))
        step = 1
        while left:
            n = min(step, left)
            reach |= (reach << (n * size)) & full
            left -= n
            step *= 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for size, reach in reversed(before):
        n = 0
        while not reach >> at & 1:  # the fewest copies that lead back to a sum of the lengths before
            at -= size
            n += 1
        if n:
            taken[size] = n
    return total, taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Containers as (how many, lengths in each) that use up the histogram of lengths 1..capacity.

    Every container starts with the longest length left, and the rest of it is the best fill. A pattern repeats as long
    as all its lengths last, so each one uses up a length: there are at most about as many patterns as lengths, however
    many items there are.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        _, taken = best_fill(counts, lengths, capacity - first)
        counts[first] += 1
        pattern = Counter(taken)
        pattern[first] += 1
        times = min(counts[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            counts[s] -= n * times
        out.append((times, dict(pattern)))
        lengths = [s for s in lengths if counts[s]]
    return out


def _slots(plans: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """For each length its items' numbers in runs: length, first number, copies a container, first container."""
    used: Counter = Counter()
    rows, container = [], 0
    for times, pattern in plans:
        for size, copies in pattern.items():
            rows.append((size, used[size], copies, container))
            used[size] += times * copies
        container += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def _placer(slots: tuple[np.ndarray, ...], base: int):
    size, start, copies, container = slots
    shift = 44
    keys = (size << shift) | start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b["n_tokens"].to_numpy(), b["number"].to_numpy()
            i = np.searchsorted(keys, (length << shift) | number, "right") - 1
            where = base + container[i] + (number - start[i]) // copies[i]
            yield pa.record_batch([b["doc_id"], b["piece_no"], b["n_tokens"], pa.array(where)], names=["doc_id", "piece_no", "n_tokens", "container_id"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Put every text into a container: ``doc_id``, ``piece_no``, ``n_tokens``, ``container_id``.

    ``sizes``: doc_id, n_tokens. A text longer than the capacity is cut into pieces of full capacity, each a container of
    its own, and a last piece that is packed like any other item. A text without tokens takes no space and has no
    container. Rows with equal doc_id are different items.
    What is gathered is the number of items of each length, at most ``capacity`` rows however many texts there are; the
    containers are planned from it (minimum bin slack). Items are then numbered within their length, in parts so that a
    length that very many have is not one window, and find their container by their number.
    """
    sizes = written(sizes.withColumn("_id", F.monotonically_increasing_id()), "token-counts")
    items = sizes.withColumn("whole", F.floor(F.col("n_tokens") / capacity)).withColumn("rest", F.col("n_tokens") - F.col("whole") * capacity)
    part = F.pmod(F.xxhash64("_id"), F.lit(PARTS))
    rest = items.where("rest > 0").withColumn("part", part)
    by_part = rest.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plans = plan(histogram, capacity)
    containers = sum(t for t, _ in plans)
    offset = by_part.select(F.col("rest").alias("_rest"), F.col("part").alias("_part"), (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("offset"))
    numbered = rest.join(offset, (F.col("rest") == F.col("_rest")) & (F.col("part") == F.col("_part"))).withColumn("number", F.col("offset") + F.row_number().over(Window.partitionBy("rest", "part").orderBy("_id")) - 1)
    schema = "doc_id bigint, piece_no bigint, n_tokens bigint, container_id bigint"
    packed = numbered.select("doc_id", F.col("whole").alias("piece_no"), F.col("rest").alias("n_tokens"), F.col("number").cast("bigint")).mapInArrow(_placer(_slots(plans), 0), schema)
    # full pieces: numbered over the rows that have any, by partition of the written table
    long = items.where("whole > 0").withColumn("part", part)
    full = long.groupBy("part").agg(F.sum("whole").alias("n"))
    starts = full.select(F.col("part").alias("_part"), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n") + containers).alias("base"))
    before = F.sum("whole").over(Window.partitionBy("part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    pieces = long.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(starts), F.col("part") == F.col("_part"))  # at most PARTS rows
    pieces = pieces.select("doc_id", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("whole"))).alias("pos", "nth"), (F.col("base") + F.col("before")).alias("first"))
    pieces = pieces.select("doc_id", F.col("pos").cast("bigint").alias("piece_no"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.col("first") + F.col("pos")).cast("bigint").alias("container_id"))
    empty = items.where("n_tokens = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece_no"), F.col("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return packed.unionAll(pieces).unionAll(empty)
