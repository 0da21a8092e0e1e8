"""The data model: tables with a time column, dimensions and metrics, lookup links and rollups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake import types as S
from chronolake.functions.tokens import Tokenizer
from chronolake.types import SqlType

DAY_MS = 86_400_000


class QueryError(ValueError):
    """A statement that the dialect does not allow."""


@dataclass(frozen=True)
class Dimension:
    """Part of a table's key. ``column`` is its name in the source; ids of dimensions are hashes of their values."""

    name: str
    type: SqlType = S.VARCHAR
    column: str = ""


@dataclass(frozen=True)
class Metric:
    """A nullable measure."""

    name: str
    type: SqlType
    column: str = ""
    group: str = "default"


@dataclass(frozen=True)
class Link:
    """A lookup source on a dimension; its fields appear in queries as ``name_field``.

    ``rows(spark)`` gives the dimension's column under the dimension's name, the fields, and for a time-sensitive link
    the column ``time`` from which a row's values hold.

    A link of the kind ``phrase`` has no rows: conditions on its one field search the words of the dimension's values.
    One of the kind ``related`` has the fields ``item`` and ``phrase``: conditions on them keep (or drop) rows that share
    the columns ``on`` with any row of that item or phrase. Both may only be tested, one condition beside others.
    ``index(spark)`` gives their stored words, (token, dimension); without it the values are taken apart in each query.
    """

    name: str
    dimension: str
    fields: Mapping[str, SqlType]
    rows: Callable[[SparkSession], DataFrame]
    time_sensitive: bool = False
    ignore_case: bool = False
    kind: str = "lookup"
    on: Sequence[str] = ()
    index: Callable[[SparkSession], DataFrame] | None = None


def phrase_link(dimension: str, name: str = "ItemsInvertedIndex", index: Callable[[SparkSession], DataFrame] | None = None) -> Link:
    """Word search in a dimension's values: ``name_phrase``."""
    return Link(name, dimension, {"phrase": S.VARCHAR}, _no_rows, kind="phrase", index=index)


def related_link(dimension: str, on: Sequence[str], name: str = "RelatedItemsCatalog", index: Callable[[SparkSession], DataFrame] | None = None) -> Link:
    """Rows next to those of an item: ``name_item`` and ``name_phrase``."""
    return Link(name, dimension, {"item": S.VARCHAR, "phrase": S.VARCHAR}, _no_rows, kind="related", on=tuple(on), index=index)


def _no_rows(spark: SparkSession) -> DataFrame:
    raise QueryError("Words can only be searched for")


@dataclass(frozen=True)
class Table:
    """A table; ``span_ms`` is the width of its time partitions, ``time`` the source column of time."""

    name: str
    dimensions: Sequence[Dimension]
    metrics: Sequence[Metric]
    links: Sequence[Link] = ()
    span_ms: int = DAY_MS
    time: str = "time"

    @property
    def key(self) -> list[str]:
        return ["time", *[d.name for d in self.dimensions]]

    def column(self, name: str) -> Dimension | Metric | None:
        low = name.lower()
        return next((c for c in (*self.metrics, *self.dimensions) if c.name.lower() == low), None)

    def link_field(self, name: str) -> tuple[Link, str] | None:
        low = name.lower()
        return next(((k, f) for k in self.links for f in k.fields if f"{k.name}_{f}".lower() == low), None)

    def struct(self) -> T.StructType:
        """The Spark schema of the stored table."""
        rows = [T.StructField("time", T.TimestampType(), False)]
        rows += [T.StructField(d.name, T._parse_datatype_string(d.type.spark), False) for d in self.dimensions]
        return T.StructType([*rows, *[T.StructField(m.name, T._parse_datatype_string(m.type.spark), True) for m in self.metrics]])


@dataclass(frozen=True)
class Rollup:
    """A materialised aggregate: a query over ``source`` whose fields are the columns of ``targets``."""

    name: str
    source: str
    targets: Sequence[str]
    fields: Mapping[str, str]
    group_by: Sequence[str]
    time: str = "trunc_day(time)"
    where: str = ""
    custom: Callable[[DataFrame], DataFrame] | None = None

    def describe(self) -> str:
        if self.custom:
            return f"Custom rollup from {self.source}"
        where = f" WHERE {self.where}" if self.where else ""
        return f"Rollup from {self.source}{where} GROUP BY {', '.join([self.time, *self.group_by])}"


@dataclass
class Schema:
    """Named tables and rollups, where the tables' rows come from, and how word search takes names apart."""

    tables: Mapping[str, Table]
    sources: Mapping[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    rollups: Sequence[Rollup] = ()
    tokenizer: Tokenizer = Tokenizer()

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"Unknown table '{name}'")
        return self.tables[name]

    def rollup_of(self, table: str) -> Rollup | None:
        return next((r for r in self.rollups if table in r.targets), None)

    def rows(self, spark: SparkSession, name: str, spans: Sequence[tuple[datetime, datetime]] | None = None) -> DataFrame:
        """A table's rows under its own column names, times in whole milliseconds; other source columns are left out.

        ``spans``: only rows between the two times of any span are needed. The bounds are put on the source's own
        column, where they reach the Parquet scan, and on the time partitions if the source has such.
        """
        t = self.table(name)
        if name not in self.sources:
            raise QueryError(f"Table '{name}' has no source")
        df = self.sources[name](spark)
        if spans is not None:
            df = self._within(df, t, spans)
        time = F.timestamp_millis(F.unix_millis(F.col(t.time).cast("timestamp")))
        out = [time.alias("time")]
        out += [F.col(c.column or c.name).cast(c.type.spark).alias(c.name) for c in (*t.dimensions, *t.metrics)]
        return df.select(*out)

    #: More spans than so many are replaced by the one that holds them all.
    MANY_SPANS = 64

    @classmethod
    def _within(cls, df: DataFrame, t: Table, spans: Sequence[tuple[datetime, datetime]]) -> DataFrame:
        if len(spans) > cls.MANY_SPANS:
            spans = [(min(a for a, _ in spans), max(b for _, b in spans))]
        bounds = [(a, b + timedelta(milliseconds=1)) for a, b in spans]  # times are cut to milliseconds later on
        kind = df.schema[t.time].dataType.typeName()

        def at(x: datetime) -> Column:
            return F.lit(x) if kind == "timestamp" else F.lit(x.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")

        if kind in ("timestamp", "timestamp_ntz"):
            df = df.where(reduce(lambda x, y: x | y, [(F.col(t.time) >= at(a)) & (F.col(t.time) < at(b)) for a, b in bounds]))
        if "base_time" in df.columns:
            low = lambda a: int(a.timestamp() * 1000) // t.span_ms * t.span_ms
            df = df.where(reduce(lambda x, y: x | y, [(F.col("base_time") >= low(a)) & (F.col("base_time") <= int(b.timestamp() * 1000)) for a, b in bounds]))
        return df


def drift(stored: Table, wanted: Table) -> tuple[list[str], list[str]]:
    """(warnings, errors) of a declared table against a stored one: only added metrics are harmless."""
    warnings, errors = [], []
    if stored.span_ms != wanted.span_ms:
        errors.append(f"{wanted.name}: time span changed from {stored.span_ms} to {wanted.span_ms}")
    if [(d.name, d.type) for d in stored.dimensions] != [(d.name, d.type) for d in wanted.dimensions]:
        errors.append(f"{wanted.name}: dimensions changed")
    had, has = {m.name: m for m in stored.metrics}, {m.name: m for m in wanted.metrics}
    for name in had.keys() | has.keys():
        if name not in has:
            errors.append(f"{wanted.name}: metric {name} is missing")
        elif name not in had:
            warnings.append(f"{wanted.name}: metric {name} is new")
        elif (had[name].type, had[name].group) != (has[name].type, has[name].group):
            errors.append(f"{wanted.name}: metric {name} changed")
    return sorted(warnings), sorted(errors)
