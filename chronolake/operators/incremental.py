"""Processing only new or changed records, over runs that may fail."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators.bitemporal import _micros
from chronolake.operators.shards import search_join
from chronolake.session import written

STATE_SCHEMA = "k bigint, h bigint"


def digest(*columns: Column) -> Column:
    """A 64-bit hash in which a null differs from a missing neighbour."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


class StateChanged(RuntimeError):
    """Another run committed since the state was read: nothing was taken, and the run may be repeated."""


class ChangeState:
    """Key and content hashes of all records taken so far, in a folder; each commit adds one delta.

    The file ``version-N`` with the greatest N lists the deltas that count. A commit first writes its delta in full, then
    puts the next version beside the one it was made from, by one atomic rename that never replaces a file. A run that
    dies at any point leaves the old state, so its records stay to be taken; of two runs made from one version only the
    first commits, the other gets StateChanged.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = self._path("")
        self._fs, self._fc = self._folder.getFileSystem(conf), self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the newest version, 0 before the first commit."""
        if not self._fs.exists(self._folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return max((int(n.removeprefix("version-")) for n in names if n.startswith("version-")), default=0)

    def deltas(self, version: int | None = None) -> list[str]:
        """Names of a version's deltas, oldest first."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"version-{version}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.split()

    def read(self, version: int | None = None) -> DataFrame:
        """The state: columns k and h."""
        names = self.deltas(version)
        if not names:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def fresh(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """Rows (with k and h) whose key is new or whose content changed: those that a join with the state does not meet."""
        return rows.join(self.read(version), ["k", "h"], "left_anti")

    def commit(self, taken: DataFrame, version: int | None = None) -> DataFrame:
        """Make ``taken`` (with k and h, and whatever else) part of the state; returns it as read back.

        ``version``: the one that ``taken`` was made from, by default the newest.
        """
        version = self.version() if version is None else version
        name = f"delta-{uuid.uuid4().hex}"
        taken.write.parquet(f"{self.path}/{name}")
        self._advance([*self.deltas(version), name], version)
        return self.spark.read.schema(taken.schema).parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Put all deltas into one, which holds just k and h; the old ones stay until someone removes them."""
        version = self.version()
        if len(self.deltas(version)) > 1:
            name = f"delta-{uuid.uuid4().hex}"
            self.read(version).distinct().write.parquet(f"{self.path}/{name}")
            self._advance([name], version)

    def _advance(self, names: list[str], version: int) -> None:
        """Put the next version in place, unless one is there."""
        new = self._path(f".{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            self._fc.rename(new, self._path(f"version-{version + 1}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise StateChanged(f"version {version} of {self.path} is no longer the newest") from None


_CARRIED = ("entry_id", "from_ts", "to_ts", "updated_at", "k", "h")
_LOWEST = np.iinfo(np.int64).min


def _bound(column: pa.ChunkedArray) -> np.ndarray:
    """Microseconds, null as lower than any."""
    return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).fill_null(_LOWEST).to_numpy()


def _first_run(entries: pa.Table, runs: pa.Table) -> pa.Table:
    """For each entry the first run of its table from landed_at on whose lower bound admits it.

    Runs lie sorted by (table, start); a table of minima over 2^k neighbours lets all entries skip at once the runs
    that do not admit them, in log2(runs) steps.
    """
    if not entries.num_rows or not runs.num_rows:
        return pa.table({**{c: entries[c].slice(0, 0) for c in _CARRIED}, "run_id": runs["run_id"].slice(0, 0), "started_at": runs["started_at"].slice(0, 0)})
    names = pa.chunked_array([*entries["table_name"].chunks, *runs["table_name"].chunks]).combine_chunks().dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64)
    own, theirs = code[: entries.num_rows], code[entries.num_rows :]
    start, run, bound = _micros(runs["started_at"]), runs["run_id"].to_numpy(), _bound(runs["recalculated_after"])
    order = np.lexsort((run, start, theirs))
    theirs, start, bound = theirs[order], start[order], bound[order]
    times = np.unique(start)
    at = np.searchsorted(theirs * (len(times) + 1) + np.searchsorted(times, start), own * (len(times) + 1) + np.searchsorted(times, _micros(entries["landed_at"])))
    end = np.searchsorted(theirs, own, "right")
    least, wanted, n = [bound], _bound(entries["from_ts"]), len(bound)
    while 2 << (len(least) - 1) <= n:
        step = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))
    for k in reversed(range(len(least))):
        inside = at < len(least[k])
        skip = inside & (least[k][np.minimum(at, len(least[k]) - 1)] > wanted)
        at = np.where(skip, at + (1 << k), at)
    hit = at < end
    take = pa.array(order[at[hit]])
    return pa.table({**{c: entries[c].filter(pa.array(hit)) for c in _CARRIED}, "run_id": runs["run_id"].take(take), "started_at": runs["started_at"].take(take)})


def changelog_rows(updates: DataFrame) -> DataFrame:
    """Changelog entries with their key hash k (table and interval) and content hash h (when and by whom).

    Equal entries are one: the first by landed_at, then entry_id. An entry that has not landed can't be read.
    """
    c = F.col
    rows = updates.where(c("landed_at").isNotNull() & c("entry_id").isNotNull())
    same = ("table_name", "from_ts", "to_ts", "updated_at", "updated_by")
    first = rows.groupBy(*same).agg(F.min(F.struct("landed_at", "entry_id")).alias("f"))
    return first.select(*same, "f.landed_at", "f.entry_id", digest(c("table_name"), c("from_ts"), c("to_ts")).alias("k"), digest(c("updated_at"), c("updated_by")).alias("h"))


def advance(state: ChangeState, updates: DataFrame, runs: DataFrame) -> DataFrame:
    """Let ``runs`` take what is new or changed in ``updates`` against ``state``, and commit it.

    Only runs with run_status SUCCEEDED and a start take entries; others leave them to later runs. An entry goes to the
    first run (by started_at, then run_id) of its table that started at or after it landed and whose
    recalculated_after is null or <= from_ts. Result: ``run_id``, ``entry_id``, ``current`` (whether it is the one
    entry for its interval in its run: the greatest updated_at, then entry_id). All of them join the state.
    Tables holding a third of the entries are split; see ``search_join``.
    """
    return _advance(state, changelog_rows(updates), runs)


def _advance(state: ChangeState, entries: DataFrame, runs: DataFrame) -> DataFrame:
    version = state.version()
    rows = state.fresh(entries, version).select("table_name", "landed_at", *_CARRIED)
    good = runs.where((F.col("run_status") == "SUCCEEDED") & F.col("started_at").isNotNull()).select("table_name", "run_id", "started_at", "recalculated_after")
    kind = "entry_id bigint, from_ts timestamp, to_ts timestamp, updated_at timestamp, k bigint, h bigint, run_id bigint, started_at timestamp"
    found, several = search_join(rows, good, "table_name", "entry_id", _first_run, kind)
    if several:
        rest = [c for c in _CARRIED if c != "entry_id"]
        found = found.groupBy("entry_id").agg(F.min(F.struct("started_at", "run_id", *rest)).alias("r")).select("entry_id", "r.*")
    taken = found.select("entry_id", "run_id", "from_ts", "to_ts", "updated_at", "k", "h")
    newest = taken.groupBy("run_id", "from_ts", "to_ts").agg(F.max(F.struct("updated_at", "entry_id")).alias("m")).select(F.col("m.entry_id").alias("newest_id"))
    taken = taken.join(newest, F.col("entry_id") == F.col("newest_id"), "left")
    return state.commit(taken.select("k", "h", "run_id", "entry_id", F.col("newest_id").isNotNull().alias("current")), version)


#: Rounds in which a log of runs is replayed.
ROUNDS = 4


def replay(state: ChangeState, updates: DataFrame, runs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Let a whole log of ``runs`` take from ``updates``, in rounds by started_at, each against what those before committed.

    The changelog's entries are made once. A round sees those that had landed by its last start, and its runs take of
    these what the state lacks, as in ``advance``. Runs with one start are in one round, so every entry goes to the same
    run as in a single round.
    """
    entries = written(changelog_rows(updates), "changelog")
    start = F.unix_micros("started_at")
    shares = [i / rounds for i in range(1, rounds)]
    cuts = runs.where(F.col("run_status") == "SUCCEEDED").agg(F.percentile_approx(start, shares)).first()[0] if shares else None
    parts, low = [], None
    for high in [*sorted(set(cuts or [])), None]:
        own, landed = runs, entries
        if low is not None:
            own = own.where(F.col("started_at") > F.timestamp_micros(F.lit(low)))
        if high is not None:
            own, landed = own.where(F.col("started_at") <= F.timestamp_micros(F.lit(high))), landed.where(F.col("landed_at") <= F.timestamp_micros(F.lit(high)))
        parts.append(_advance(state, landed, own))
        low = high
    return reduce(DataFrame.unionAll, parts)
