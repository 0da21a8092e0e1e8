"""Rows of lookup links: in memory, from Parquet or JDBC, and links declared in JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from chronolake import types as S
from chronolake.schema import Link, QueryError, Schema, Table
from chronolake.types import SqlType


def in_memory(name: str, dimension: str, dimension_type: SqlType, fields: Mapping[str, SqlType], rows: Iterable[Mapping[str, Any]], ignore_case: bool = True) -> Link:
    """A link over a few given rows, each with the dimension and the fields."""
    held = [tuple(r.get(c) for c in (dimension, *fields)) for r in rows]
    schema = ", ".join([f"`{dimension}` {dimension_type.spark}", *[f"`{f}` {t.spark}" for f, t in fields.items()]])
    return Link(name, dimension, dict(fields), lambda spark: spark.createDataFrame(held, schema), ignore_case=ignore_case and dimension_type == S.VARCHAR)


def from_parquet(name: str, dimension: str, fields: Mapping[str, SqlType], path: str, columns: Mapping[str, str] | None = None, time: str | None = None) -> Link:
    """A link over a Parquet table; ``columns`` maps the dimension and fields to its columns."""
    names = dict(columns or {})

    def rows(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(path)
        wanted = [dimension, *fields, *([] if time is None else ["time"])]
        return df.selectExpr(*[f"`{time if c == 'time' else names.get(c, c)}` AS `{c}`" for c in wanted])

    return Link(name, dimension, dict(fields), rows, time_sensitive=time is not None)


def snake(name: str) -> str:
    """camelCase as snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def from_jdbc(name: str, dimension: str, fields: Mapping[str, SqlType], relation: str, url: str, user: str | None = None, password: str | None = None, columns: Mapping[str, str] | None = None, reader: Callable[..., DataFrame] | None = None) -> Link:
    """A link over a JDBC relation, with column names in snake case unless ``columns`` says otherwise.

    Only the named columns are read, and Spark pushes conditions on them into the database.
    """
    names = {c: (columns or {}).get(c, snake(c)) for c in (dimension, *fields)}

    def rows(spark: SparkSession) -> DataFrame:
        properties = {k: v for k, v in (("user", user), ("password", password)) if v is not None}
        df = reader(spark, relation) if reader else spark.read.jdbc(url, relation, properties=properties)
        return df.selectExpr(*[f"`{column}` AS `{c}`" for c, column in names.items()])

    return Link(name, dimension, dict(fields), rows)


def declared(text: str, schema: Schema) -> list[tuple[Link, Sequence[str]]]:
    """Links declared in JSON: (link, names of its tables).

    {"externalLinks": [{"description": {linkName, dimensionName, fieldsNames, tables, fieldsMapping?, relation?},
    "connection": {url, username?, password?}}]}. Fields are strings.
    """
    try:
        entries = json.loads(text)["externalLinks"]
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError(f"Invalid declaration of links: {e}") from None
    out = []
    for entry in entries:
        try:
            d, c = entry["description"], entry["connection"]
            name, dimension, fields, tables, url = d["linkName"], d["dimensionName"], d["fieldsNames"], d["tables"], c["url"]
        except (KeyError, TypeError) as e:
            raise QueryError(f"Invalid declaration of a link: {e} is missing") from None
        for t in tables:
            table: Table = schema.table(t)
            if dimension not in {x.name for x in table.dimensions}:
                raise QueryError(f"Table {t} has no dimension {dimension} for link {name}")
        types = {f: S.VARCHAR for f in fields}
        link = from_jdbc(name, dimension, types, d.get("relation") or snake(name), url, c.get("username"), c.get("password"), d.get("fieldsMapping"))
        out.append((link, tables))
    return out
