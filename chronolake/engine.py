"""The engine: statements of the dialect over a schema."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from itertools import islice
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import types as T

from chronolake import types as S
from chronolake.access import User, Users
from chronolake.dialect.parser import Command, Node, Select, parse
from chronolake.dialect.resolve import _TURNED
from chronolake.functions.registry import const_as, literal
from chronolake.operators.ingest import CHANGELOG, Store, filter_changelog
from chronolake.plans import metadata
from chronolake.plans.select import Planner
from chronolake.schema import QueryError, Schema, Table

# States of a query, weakest first; of a query's parts the strongest state counts.
STATES = ("RUNNING", "FINISHED", "CANCELLED")


@dataclass
class LoggedQuery:
    query_id: str
    user: str | None
    query: str
    start_date: datetime
    state: str = "RUNNING"
    total_duration: float = 0.0


class LoggedFrame(DataFrame):
    """A query's result whose actions run under the query's name, so that the log follows them and KILL QUERY stops them.

    The query is RUNNING until an action has ended. Frames made from this one are ordinary and not logged.
    """

    _entry: LoggedQuery
    _now: Callable[[], datetime]

    @classmethod
    def of(cls, df: DataFrame, entry: LoggedQuery, now: Callable[[], datetime]) -> LoggedFrame:
        made = cls(df._jdf, df.sparkSession)
        made._entry, made._now = entry, now
        return made

    def _logged(self, action: Callable[[], Any]) -> Any:
        context, entry = self.sparkSession.sparkContext, self._entry
        names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
        before = [context.getLocalProperty(n) for n in names]
        entry.state, entry.start_date, began = "RUNNING", self._now(), time.monotonic()
        context.setJobGroup(entry.query_id, entry.query[:200], interruptOnCancel=True)
        try:
            got = action()
            entry.state = max(entry.state, "FINISHED", key=STATES.index)
            return got
        except BaseException:
            entry.state = "CANCELLED"
            raise
        finally:
            entry.total_duration = time.monotonic() - began
            for n, value in zip(names, before, strict=True):
                context.setLocalProperty(n, value)

    @property
    def write(self) -> Any:
        return _LoggedWriter(super().write, self._logged)


class _LoggedWriter:
    """A writer whose settings give such a writer again and whose saving is an action."""

    def __init__(self, writer: Any, logged: Callable[[Callable[[], Any]], Any]):
        self._writer, self._logged = writer, logged

    def __getattr__(self, name: str) -> Any:
        member = getattr(self._writer, name)

        def call(*args: Any, **named: Any) -> Any:
            got = self._logged(lambda: member(*args, **named)) if name in ("save", "saveAsTable", "insertInto", "parquet", "csv", "json", "orc", "text", "jdbc") else member(*args, **named)
            return _LoggedWriter(got, self._logged) if got is not None else None

        return call


def _action(name: str) -> Callable[..., Any]:
    def run(self: LoggedFrame, *args: Any, **named: Any) -> Any:
        return self._logged(lambda: getattr(DataFrame, name)(self, *args, **named))

    run.__name__ = name
    return run


for _name in ("collect", "count", "toPandas", "toArrow", "head", "take", "first", "tail", "show", "isEmpty", "foreach", "foreachPartition", "toLocalIterator"):
    setattr(LoggedFrame, _name, _action(_name))


#: Queries that the log keeps at most; the oldest are dropped.
LOG_SIZE = 10_000


@dataclass
class Engine:
    """Runs statements; every result is a DataFrame.

    ``store`` takes upserts; ``prepare`` may rewrite a parsed query before it is planned; ``now`` gives the time of a query.
    """

    spark: SparkSession
    schema: Schema
    store: Store | None = None
    users: Users = field(default_factory=Users)
    prepare: Callable[[Select], Select] = lambda q: q
    now: Callable[[], datetime] = lambda: datetime.now(UTC)
    log: dict[str, LoggedQuery] = field(default_factory=dict)

    def sql(self, text: str, params: Sequence[Any] = (), user: User | None = None) -> DataFrame:
        statement = parse(text, params)
        if isinstance(statement, Select):
            self._need(user, "read table" if statement.table else "read metadata", f"SELECT from {statement.table}")
            return self._logged(text, user, statement)
        kind = statement.kind
        handler = getattr(self, "_" + kind.replace(" ", "_"), None)
        if handler is None:
            raise QueryError("Unsupported query type")
        return handler(statement, user)

    def batch(self, text: str, rows: Sequence[Sequence[Any]], user: User | None = None) -> DataFrame:
        """An UPSERT whose placeholders are bound once for each of ``rows``, put at once."""
        made = [parse(text, r) for r in rows]
        if not made or any(not isinstance(m, Command) or m.kind != "upsert" for m in made):
            raise QueryError("Only UPSERT statements can be run in batches")
        return self._upsert(Command("upsert", {**made[0].args, "rows": [r for m in made for r in m.args["rows"]]}), user)

    def _need(self, user: User | None, right: str, what: str) -> None:
        if not self.users.allowed(user, right):
            raise QueryError(f"User {user.name if user else 'anonymous'} doesn't have enough permissions for {what}")

    def _logged(self, text: str, user: User | None, q: Select) -> DataFrame:
        entry = LoggedQuery(uuid.uuid4().hex, user.name if user else None, text, self.now())
        self.log[entry.query_id] = entry
        for old in list(islice(self.log, max(0, len(self.log) - LOG_SIZE))):
            del self.log[old]
        try:
            return LoggedFrame.of(Planner(self.spark, self.schema, self.now()).plan(self.prepare(q)), entry, self.now)
        except Exception:
            entry.state = "CANCELLED"
            raise

    # statements

    def _show_tables(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read metadata", "SHOW TABLES")
        return metadata.tables(self.spark, self.schema)

    def _show_columns(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read metadata", "SHOW COLUMNS")
        return metadata.columns(self.spark, self.schema, c.args["table"])

    def _show_functions(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read metadata", "SHOW FUNCTIONS")
        return metadata.functions(self.spark, c.args["type"])

    def _show_version(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read metadata", "SHOW VERSION")
        return metadata.version(self.spark)

    def _chosen(self, args: dict[str, Any]) -> list[LoggedQuery]:
        found = [q for q in self.log.values() if args.get("query_id") in (None, q.query_id) and args.get("state") in (None, q.state)]
        return found[: args.get("limit")]

    def _show_queries(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read queries", "SHOW QUERIES")
        rows = [(q.query_id, "SPARK", q.user, q.state, q.query, q.start_date, q.total_duration) for q in self._chosen(c.args)]
        return self.spark.createDataFrame(rows, "query_id string, engine string, user string, state string, query string, start_date timestamp, total_duration double")

    def _kill_query(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write queries", "KILL QUERY")
        entry = self.log.get(c.args["query_id"])
        if entry is not None:
            self.spark.sparkContext.cancelJobGroup(entry.query_id)
            entry.state = max(entry.state, "CANCELLED", key=STATES.index)
        return self._result("RESULT", "OK" if entry else "QUERY NOT FOUND")

    def _delete_queries(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write queries", "DELETE QUERIES")
        gone = self._chosen(c.args)
        for q in gone:
            del self.log[q.query_id]
        return self.spark.createDataFrame([(len(gone),)], "DELETED int")

    def _result(self, name: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{name} string")

    def _show_users(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read users", "SHOW USERS")
        return self.spark.createDataFrame([(u.name, u.role) for u in self.users.by_name.values()], "NAME string, ROLE string")

    def _create_user(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write users", "CREATE USER")
        self.users.create(**c.args)
        return self._result("STATUS", "OK")

    def _alter_user(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write users", "ALTER USER")
        self.users.alter(**c.args)
        return self._result("STATUS", "OK")

    def _drop_user(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write users", "DROP USER")
        self.users.drop(c.args["name"])
        return self._result("STATUS", "OK")

    def _show_updates(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "read metadata", "SHOW UPDATES_INTERVALS")
        rows = self.store.changelog() if self.store else self.spark.createDataFrame([], CHANGELOG)
        return filter_changelog(rows, **changelog_filter(c.args["where"]))

    def _upsert(self, c: Command, user: User | None) -> DataFrame:
        self._need(user, "write table", f"UPSERT INTO {c.args['table']}")
        if self.store is None:
            raise QueryError("No store to put data points into")
        table = self.schema.table(c.args["table"])
        self.store.put(table, upsert_rows(self.spark, table, c.args["fields"], c.args["rows"]), user.name if user else None, self.now())
        return self._result("RESULT", "OK")


def changelog_filter(where: Node | None) -> dict[str, Any]:
    """WHERE of SHOW UPDATES_INTERVALS: table =, updated_by =, updated_at BETWEEN, recalculated_at BETWEEN or >=, ANDed; operands in either order."""
    out: dict[str, Any] = {}
    parts = [] if where is None else list(where.args) if where.op == "and" else [where]
    for p in parts:
        args = p.args[::-1] if p.op in _TURNED and len(p.args) == 2 and p.args[1].op == "field" else p.args
        p = Node(_TURNED.get(p.op, p.op) if args is not p.args else p.op, tuple(args))
        name = p.args[0].value.lower() if p.args and p.args[0].op == "field" else ""
        values = [a.value for a in p.args[1:]]
        if p.op == "=" and name in ("table", "updated_by"):
            out[name] = values[0]
        elif p.op == "between" and name == "updated_at":
            out["updated"] = tuple(values)
        elif p.op == "between" and name == "recalculated_at":
            out["recalculated"] = tuple(values)
        elif p.op == ">=" and name == "recalculated_at":
            out["recalculated_after"] = values[0]
        else:
            raise QueryError("Unsupported condition in SHOW UPDATES_INTERVALS")
    return out


def upsert_rows(spark: SparkSession, table: Table, fields: Sequence[str], rows: Sequence[Sequence[Node]]) -> DataFrame:
    """Data points of an UPSERT: time and all dimensions have to be given, link fields cannot be."""
    names, kinds = [], []
    for f in fields:
        c = table.column(f)
        if f.lower() == "time":
            names.append("time")
            kinds.append(S.TIMESTAMP)
        elif c is not None:
            names.append(c.name)
            kinds.append(c.type)
        elif table.link_field(f) is not None:
            raise QueryError(f"External link field {f} cannot be upserted")
        else:
            raise QueryError(f"Unknown field {f}")
    for need in table.key:
        if need not in names:
            raise QueryError(f"{'Time field' if need == 'time' else need} is not defined")
    made = []
    for row in rows:
        if any(v.op != "const" for v in row):
            raise QueryError("Only constant values can be upserted")
        typed = [const_as(literal(v.value), t) if v.value is not None else None for v, t in zip(row, kinds, strict=True)]
        made.append(tuple(None if t is None else t.value for t in typed))
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t.spark)) for n, t in zip(names, kinds, strict=True)])
    return spark.createDataFrame(made, schema)
