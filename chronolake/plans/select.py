"""A resolved SELECT as a DataFrame."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake import types as S
from chronolake.dialect.parser import Node, Select
from chronolake.dialect.resolve import Bounds, Resolver, check_bounds, field_names, time_branches, validate
from chronolake.functions.registry import Typed
from chronolake.operators import links
from chronolake.operators.slices import slice_of
from chronolake.schema import Link, QueryError, Schema, Table


def _fields(node: Node) -> set[str]:
    own = {node.value.lower()} if node.op == "field" else set()
    return own.union(*[_fields(a) for a in node.args]) if node.args else own


def _conjuncts(node: Node | None) -> list[Node]:
    if node is None:
        return []
    return [c for a in node.args for c in _conjuncts(a)] if node.op == "and" else [node]


class Planner:
    """Plans one SELECT over a schema. ``now`` is the time of the query."""

    def __init__(self, spark: SparkSession, schema: Schema, now: datetime | None = None, tie_break: bool = True):
        self.spark, self.schema, self.now, self.tie_break = spark, schema, now or datetime.now(UTC), tie_break

    def plan(self, q: Select) -> DataFrame:
        if q.fields is None:
            raise QueryError("All fields matching is not supported")
        table = self.schema.table(q.table) if q.table else None
        plain = Resolver(self._columns(table), self.now, table)
        names = field_names(q)
        fields = [plain(node) for node, _ in q.fields]
        refs = {n: f for n, f in zip(names, fields, strict=True)}
        with_refs = Resolver(self._or_ref(table, refs), self.now, table)
        groups = [self._group(g, refs, plain) for g in q.group_by]
        validate(names, fields, groups)
        if table is None:
            return self._no_table(q, names, fields, with_refs)
        if q.where is None:
            raise QueryError("Empty condition")
        by_alias = {n: node for n, (node, _) in zip(names, q.fields, strict=True)}
        where = self._substitute(q.where, by_alias, table)
        branches = time_branches(where)
        check_bounds(branches)
        df = self._scan(table, branches, plain)
        df = self._filter(df, table, where, with_refs, self._link_needs(q, table, by_alias))
        condition = with_refs.boolean(q.having) if q.having is not None else None
        if condition is not None and condition.kind == "invalid":
            raise QueryError(f"Invalid expression '{condition.key}' in HAVING")
        if any(f.kind == "window" for f in fields) or (condition is not None and condition.kind == "window"):
            df = self._windowed(df, table, q, names, fields, groups, with_refs)
        elif groups or any(f.kind == "aggregate" for f in fields):
            if q.having is not None:
                self._check_having(q.having, {g.key for g in groups}, with_refs)
            df = self._grouped(df, names, fields, groups, condition)
        else:
            if condition is not None:
                df = df.where(condition.column)
            df = df.select(*[self._shown(f).alias(n) for n, f in zip(names, fields, strict=True)])
        return df if q.limit is None else df.limit(q.limit)

    # names

    def _columns(self, table: Table | None):
        def find(name: str) -> Typed:
            if table is None:
                raise QueryError(f"Unknown field {name}")
            if name.lower() == "time":
                return Typed(F.col("time"), S.TIMESTAMP, "simple", "time")
            c = table.column(name)
            if c is not None:
                return Typed(F.col(f"`{c.name}`"), c.type, "simple", c.name)
            linked = table.link_field(name)
            if linked is not None:
                link, field = linked
                return Typed(F.col(f"`{link.name}_{field}`"), link.fields[field], "simple", f"{link.name}_{field}")
            raise QueryError(f"Unknown field {name}")

        return find

    def _or_ref(self, table: Table | None, refs: dict[str, Typed]):
        columns = self._columns(table)

        def find(name: str) -> Typed:
            ref = refs.get(name)
            try:
                own = columns(name)
            except QueryError:
                if ref is None:
                    raise
                return ref
            if ref is not None and ref.key != own.key:
                raise QueryError(f"Ambiguous field {name}")
            return own

        return find

    @staticmethod
    def _group(node: Node, refs: dict[str, Typed], plain: Resolver) -> Typed:
        if node.op == "field" and node.value in refs:
            return refs[node.value]
        return plain(node)

    def _substitute(self, node: Node, by_alias: dict[str, Node], table: Table) -> Node:
        """The condition with aliases of fields put in place, so that bounds of time and links are seen through them."""
        if node.op == "field" and node.value in by_alias and table.column(node.value) is None and table.link_field(node.value) is None and node.value.lower() != "time":
            return by_alias[node.value]
        return Node(node.op, tuple(self._substitute(a, by_alias, table) for a in node.args), node.value)

    # stages

    def _no_table(self, q: Select, names: list[str], fields: list[Typed], resolver: Resolver) -> DataFrame:
        df = self.spark.range(1)
        for condition in (q.where, q.having):
            if condition is not None:
                df = df.where(resolver.boolean(condition).column)
        df = df.select(*[self._shown(f).alias(n) for n, f in zip(names, fields, strict=True)])
        return df if q.limit is None else df.limit(q.limit)

    def _scan(self, table: Table, branches: list[Bounds], plain: Resolver) -> DataFrame:
        """The table's rows within the bounds of time of any alternative."""
        spans = [(plain(a).value, plain(b).value) for a, b in branches]
        known = all(isinstance(v, datetime) for span in spans for v in span)
        return self.schema.rows(self.spark, table.name, spans if known else None)

    def _link_needs(self, q: Select, table: Table, by_alias: dict[str, Node]) -> set[str]:
        """Links whose values the result shows, groups by or tests in HAVING."""
        used = set().union(*[_fields(node) for node, _ in q.fields or []], *[_fields(g) for g in q.group_by])
        if q.having is not None:
            used |= _fields(self._substitute(q.having, by_alias, table))
        return {k.name for k in table.links if any(f"{k.name}_{f}".lower() in used for f in k.fields)}

    def _filter(self, df: DataFrame, table: Table, where: Node, resolver: Resolver, needed: set[str]) -> DataFrame:
        """WHERE, with plain conditions first and then conditions on links as semi and anti joins.

        A condition on one link's field alone selects keys of the link: = and IN keep them, <> and NOT IN drop them, so
        rows without any link row stay in the latter case. Fields of one link in several such conditions have to agree
        in one row to keep a key, and any of them drops it. Where a condition mixes links with other things or stands
        under OR, the link's values are joined and compared.
        """
        plain, alone, mixed = [], {}, []
        for c in _conjuncts(where):
            names = {table.link_field(n)[0].name for n in _fields(c) if table.link_field(n) is not None and table.column(n) is None}
            if not names:
                plain.append(c)
                continue
            only_field = c.op in ("=", "<>", "in", "not in") and sum(table.link_field(a.value) is not None for a in c.args if a.op == "field") == 1 and len(_fields(c)) == 1 and c.op and c.args[0].op in ("field", "const")
            link = table.link_field(next(iter(_fields(c))))
            if only_field and link is not None and not link[0].time_sensitive:
                alone.setdefault((link[0].name, c.op in ("<>", "not in")), []).append(c)
            else:
                mixed.append((c, names))
        by_name = {k.name: k for k in table.links}
        scanned = df
        for c in plain:
            df = df.where(resolver.boolean(c).column)
        for (name, exclude), conditions in alone.items():
            link = by_name[name]
            if link.kind != "lookup":
                df = self._searched(df, scanned, link, conditions, exclude)
                continue
            df = links.restrict(df, link, links.matching_keys(link.rows(self.spark), link, self._link_condition(link, conditions, exclude)), exclude)
        for name in sorted(needed.union(*[n for _, n in mixed])):
            if by_name[name].kind != "lookup":
                if name not in needed:
                    raise QueryError(f"Conditions on {name} can only stand beside others, with = or IN, <> or NOT IN")
                df = df.withColumns({f"{name}_{f}": F.lit(None).cast("string") for f in by_name[name].fields})
                continue
            df = links.lookup(df, by_name[name], by_name[name].rows(self.spark), f"{name}_")
        for c, _ in mixed:
            df = df.where(resolver.boolean(self._null_keeps(c, table)).column)
        return df

    def _searched(self, df: DataFrame, scanned: DataFrame, link: Link, conditions: list[Node], exclude: bool) -> DataFrame:
        """Rows whose item has the phrases looked for, or that are related to rows of an item or phrase."""
        wanted = []
        for c in conditions:
            field = next(a.value for a in c.args if a.op == "field")[len(link.name) + 1 :].lower()
            wanted.append((field, [str(a.value) for a in c.args if a.op == "const" and a.value is not None]))
        index = link.index(self.spark) if link.index else None
        if link.kind == "phrase":
            found = [values for _, values in wanted]
            return links.filter_phrases(df, link.dimension, exclude=[v for x in found for v in x], index=index, tokenizer=self.schema.tokenizer) if exclude else links.filter_phrases(df, link.dimension, include=found, index=index, tokenizer=self.schema.tokenizer)
        for field, values in wanted:
            rows = scanned.where(F.lower(link.dimension).isin([v.lower() for v in values])) if field == "item" else links.filter_phrases(scanned, link.dimension, include=[values], index=index, tokenizer=self.schema.tokenizer)
            df = links.related(df, rows, link.on, exclude)
        return df

    def _link_condition(self, link: Link, conditions: list[Node], exclude: bool):
        def find(name: str) -> Typed:
            field = next(f for f in link.fields if f"{link.name}_{f}".lower() == name.lower())
            return Typed(F.col(f"`{field}`"), link.fields[field], "simple", name)

        resolver = Resolver(find, self.now)
        turned = {"<>": "=", "not in": "in"}
        made = [resolver.boolean(Node(turned.get(c.op, c.op), c.args)).column for c in conditions]
        column = made[0]
        for m in made[1:]:
            column = (column | m) if exclude else (column & m)
        return column

    def _null_keeps(self, node: Node, table: Table) -> Node:
        """Under OR too a row without a link row counts as different from any value."""
        if node.op in ("and", "or"):
            return Node(node.op, tuple(self._null_keeps(a, table) for a in node.args))
        if node.op in ("<>", "not in"):
            field = next((a for a in node.args if a.op == "field" and table.link_field(a.value) is not None), None)
            if field is not None:
                return Node("or", (node, Node("is null", (field,))))
        return node

    @staticmethod
    def _shown(f: Typed):
        """Money leaves as a decimal of whole units."""
        if f.type == S.CURRENCY:
            return (f.column.cast("decimal(36,0)") * F.expr("0.01BD")).cast("decimal(38,2)")
        return f.column

    def _grouped(self, df: DataFrame, names: list[str], fields: list[Typed], groups: list[Typed], condition: Typed | None) -> DataFrame:
        """Aggregation; without rows there is no group, not even the global one."""
        keys = [g.column.alias(f"_g{i}") for i, g in enumerate(groups)]
        at = {g.key: i for i, g in enumerate(groups)}
        made = [F.count(F.lit(1)).alias("_rows")]
        made += [self._shown(f).alias(f"_f{i}") for i, f in enumerate(fields) if f.kind == "aggregate"]
        if condition is not None:
            made.append(self._having(condition, groups).alias("_having"))
        out = df.groupBy(*keys).agg(*made) if groups else df.agg(*made).where("_rows > 0")
        if condition is not None:
            out = out.where("_having")
        shown = []
        for i, (n, f) in enumerate(zip(names, fields, strict=True)):
            if f.kind == "aggregate":
                shown.append(F.col(f"_f{i}").alias(n))
            elif f.kind == "const":
                shown.append(self._shown(f).alias(n))
            else:
                shown.append(self._shown(Typed(F.col(f"_g{at[f.key]}"), f.type, f.kind, f.key)).alias(n))
        return out.select(*shown)

    def _check_having(self, node: Node, keys: set[str], resolver: Resolver) -> None:
        """What HAVING tests has one value in a group: a key, an aggregate or a constant."""
        if node.op in ("field", "call"):
            e = resolver(node)
            if e.kind in ("aggregate", "const") or e.key in keys:
                return
            if node.op == "field":
                raise QueryError(f"Field {e.key} in HAVING is neither an aggregate nor a key of the groups")
        for a in node.args:
            self._check_having(a, keys, resolver)

    @staticmethod
    def _having(condition: Typed, groups: list[Typed]):
        """A condition on keys alone is the same for all rows of a group."""
        return condition.column if condition.kind in ("aggregate", "const") else F.first(condition.column)

    def _windowed(self, df: DataFrame, table: Table, q: Select, names: list[str], fields: list[Typed], groups: list[Typed], resolver: Resolver) -> DataFrame:
        """lag: GROUP BY partitions, time orders, all rows stay; equal times follow the other dimensions."""
        if not any(f.kind == "window" for f in fields):
            raise QueryError("Window functions in HAVING need one among the fields")
        lagged: dict[str, tuple[str, Typed]] = {}

        def named(node: Node) -> Node:
            if node.op == "call" and node.value == "lag":
                inner = resolver(node.args[0])
                return Node("lagged", value=lagged.setdefault(inner.key, (f"_lag{len(lagged)}", inner)))
            return Node(node.op, tuple(named(a) for a in node.args), node.value)

        class WithLag(Resolver):
            def _expression(self, node: Node, cmp: bool) -> Typed:
                if node.op == "lagged":
                    name, inner = node.value
                    return Typed(F.col(name), inner.type, "window", f"lag({inner.key})")
                return super()._expression(node, cmp)

        nodes = [named(node) for node, _ in q.fields or []]
        having = named(q.having) if q.having is not None else None
        df = self._lagged(df, table, groups, list(lagged.values()))
        plain = WithLag(self._columns(table), self.now, table)
        made = [plain(n) for n in nodes]
        if having is not None:
            refs = WithLag(self._or_ref(table, dict(zip(names, made, strict=True))), self.now, table)
            df = df.where(refs.boolean(having).column)
        return df.select(*[self._shown(f).alias(n) for n, f in zip(names, made, strict=True)])

    def _lagged(self, df: DataFrame, table: Table, groups: list[Typed], wanted: list[tuple[str, Typed]]) -> DataFrame:
        """The rows with the previous values of their group.

        A group, or the whole table when there is none, may be too large for one task. Windows therefore span a group's
        rows of one slice of time, cut so that no slice holds many rows; a slice's first row takes its values from the
        last row of the slice before it, found over one summary row a slice.
        """
        order = [F.col(f"`{c}`") for c in ("time", *([d.name for d in table.dimensions] if self.tie_break else []))]
        keys = [f"_k{i}" for i in range(len(groups))]
        df = df.withColumns({"_slice": slice_of(df, "time"), **{k: g.column for k, g in zip(keys, groups, strict=True)}})
        df = df.withColumn("_own", F.struct(*[e.column.alias(n) for n, e in wanted]))
        ends = df.groupBy(*keys, "_slice").agg(F.max_by("_own", F.struct(*order)).alias("_end"))
        before = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))
        carry = ends.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_slice").alias("_slicec"), before.alias("_carry"))
        on = F.col("_slice") == F.col("_slicec")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}c"))
        inside = F.lag("_own").over(Window.partitionBy(*keys, "_slice").orderBy(*order))
        df = df.withColumn("_inside", inside).join(carry, on)
        return df.withColumn("_before", F.coalesce("_inside", "_carry")).withColumns({n: F.col(f"_before.{n}") for n, _ in wanted})
