"""Attributes as they were known at the time of an event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators.shards import search_join


class PersistentTree:
    """A path-copied persistent search tree over ranks 0..size-1, one version for each insertion.

    Insertion i copies the path from the root to leaf ``ranks[i]``: its node on level L covers the ranks that share
    their leading bits with it, keeps the copy one level down as one child and the newest older node of the other half
    as the other. A node is thus named by (level, insertion), and version i is the root copied by insertion i. All
    paths are built level by level with array operations. ``best`` is the insertion that holds a node's greatest rank.
    """

    def __init__(self, ranks: np.ndarray, size: int):
        n, self.ranks = len(ranks), ranks
        self.depth = max(1, int(size - 1).bit_length()) if size > 1 else 1
        self.other: list[np.ndarray] = []
        at = np.arange(n)
        for level in range(self.depth):
            shift = self.depth - level - 1
            prefix, bit = ranks >> (shift + 1), (ranks >> shift) & 1
            order = np.argsort(prefix, kind="stable")
            p, b = prefix[order], bit[order]
            first = np.zeros(n, dtype=np.int64)
            if n:
                new = np.r_[True, p[1:] != p[:-1]]
                first = np.maximum.accumulate(np.where(new, at, 0))
            last = [np.maximum.accumulate(np.where(b == side, at, -1)) if n else at for side in (0, 1)]
            opposite = np.where(b == 0, last[1], last[0])
            found = np.where(opposite >= first, order[np.maximum(opposite, 0)], -1) if n else at
            other = np.empty(n, dtype=np.int64)
            other[order] = found
            self.other.append(other)
        self.best = [at]
        for level in reversed(range(self.depth)):
            bit, below, other = (ranks >> (self.depth - level - 1)) & 1, self.best[0], self.other[level]
            upper = below[np.maximum(other, 0)] if n else below
            self.best.insert(0, np.where((bit == 0) & (other >= 0), upper, below))

    def floor(self, version: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each (version, rank): the insertion that holds the greatest rank <= rank in that version, or -1."""
        node = np.where(rank >= 0, version, -1)
        found = np.full(len(node), -1, dtype=np.int64)
        if not len(self.ranks):
            return found
        for level in range(self.depth):
            shift, alive, safe = self.depth - level - 1, node >= 0, np.maximum(node, 0)
            own, other = (self.ranks[safe] >> shift) & 1, self.other[level][safe]
            low, high = np.where(own == 0, node, other), np.where(own == 1, node, other)
            right = (rank >> shift) & 1 == 1
            found = np.where(alive & right & (low >= 0), self.best[level + 1][np.maximum(low, 0)], found)
            node = np.where(alive, np.where(right, high, low), -1)
        return np.where(node >= 0, self.best[self.depth][np.maximum(node, 0)], found)


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_numpy()


def _search(events: pa.Table, facts: pa.Table) -> pa.Table:
    """Columns row, value_time, known_at, attr and the payload of the fact found, for events that have one."""
    entity, names = facts["entity"].to_numpy(), [c for c in facts.column_names if c.startswith("f_")]
    valid, known, attr = _micros(facts["value_time"]), _micros(facts["known_at"]), facts["attr"].to_numpy()
    order = np.lexsort((attr, known))  # of equal value_time the last insertion rules: the greatest known_at, then attr
    entity, valid, known = entity[order], valid[order], known[order]
    ids, times = np.unique(entity), np.unique(valid)
    place = np.searchsorted(ids, entity) * (len(times) + 1) + np.searchsorted(times, valid, "right")
    places = np.unique(place)
    tree = PersistentTree(np.searchsorted(places, place), len(places))
    who, when = events["entity"].to_numpy(), _micros(events["time"])
    code = np.searchsorted(ids, who)
    there = (code < len(ids)) & (ids[np.minimum(code, max(len(ids) - 1, 0))] == who) if len(ids) else np.zeros(len(who), bool)
    rank = np.searchsorted(places, code * (len(times) + 1) + np.searchsorted(times, when, "right"), "right") - 1
    found = tree.floor(np.searchsorted(known, when, "right") - 1, np.where(there, rank, -1))
    hit = found >= 0
    hit[hit] = entity[found[hit]] == who[hit]
    take = pa.array(order[found[hit]])
    return pa.table([events["row"].filter(pa.array(hit)), *[facts[c].take(take) for c in ("value_time", "known_at", "attr", *names)]], names=["row", "value_time", "known_at", "attr", *names])


def known_attributes(events: DataFrame, facts: DataFrame, payload: tuple[str, ...] = (), rows_per_group: int = 200_000) -> DataFrame:
    """For each event the fact of its entity that was valid and known at its time.

    ``events``: ``row`` (unique), ``entity``, ``time``. ``facts``: ``entity``, ``value_time``, ``known_at``, ``attr``
    (unique) and the ``payload`` columns. Among the facts with value_time <= time and known_at <= time the greatest
    value_time, then known_at, then attr is taken; an event without any gives no row, nor does one with a null entity
    or time; facts with a null in entity, value_time, known_at or attr are never valid.
    Result: ``row``, ``attr`` and the payload.
    A shard's facts form one persistent tree over (entity, value_time), one version for each fact in the order in which
    it became known; an event picks the version of its time and descends to its place in it.
    """
    events = events.select("row", "entity", "time").where(F.col("time").isNotNull())
    facts = facts.select("entity", "value_time", "known_at", "attr", *[F.col(c).alias(f"f_{c}") for c in payload]).dropna(subset=["value_time", "known_at", "attr"])
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    schema = f"row {events.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in ("value_time", "known_at", "attr", *[f"f_{c}" for c in payload]))
    got, several = search_join(events, facts, "entity", "row", _search, schema, rows_per_group)
    if several:  # an entity's facts were cut: its events have one answer from each part
        got = got.select("row", F.struct("value_time", "known_at", "attr").alias("o"), F.struct("attr", *[f"f_{c}" for c in payload]).alias("v"))
        got = got.groupBy("row").agg(F.max_by("v", "o").alias("v")).select("row", "v.*")
    return got.select("row", "attr", *[F.col(f"f_{c}").alias(c) for c in payload])


def receipt_attributes(receipt: DataFrame, link: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """The row of the time-sensitive link in force for each stored receipt row."""
    events = receipt.select(F.col("row_id").alias("row"), F.col("kkm_id").alias("entity"), F.col("dp_time").alias("time"))
    facts = link.select(F.col("kkm_id").alias("entity"), "value_time", "known_at", F.col("attr_id").alias("attr"), *payload)
    return known_attributes(events, facts, payload).select(F.col("row").alias("row_id"), F.col("attr").alias("attr_id"), *payload)
