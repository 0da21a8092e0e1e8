"""Results of SHOW statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolake import types as S
from chronolake.functions.registry import functions_for
from chronolake.schema import QueryError, Schema

VERSION = (0, 1, "0.1.0")
# Columns of JDBC metadata, and those of them that are numbers.
TABLE_COLUMNS = "TABLE_CAT TABLE_SCHEM TABLE_NAME TABLE_TYPE REMARKS".split()
COLUMN_COLUMNS = (
    "TABLE_CAT TABLE_SCHEM TABLE_NAME COLUMN_NAME DATA_TYPE TYPE_NAME COLUMN_SIZE BUFFER_LENGTH DECIMAL_DIGITS NUM_PREC_RADIX NULLABLE REMARKS COLUMN_DEF "
    "SQL_DATA_TYPE SQL_DATETIME_SUB CHAR_OCTET_LENGTH ORDINAL_POSITION SCOPE_CATALOG SCOPE_SCHEMA SCOPE_TABLE IS_NULLABLE SOURCE_DATA_TYPE IS_AUTOINCREMENT IS_GENERATEDCOLUMN"
).split()
NUMBERS = {"DATA_TYPE", "SOURCE_DATA_TYPE", "NULLABLE"}
_NULLABLE = {"no": (0, "NO"), "yes": (1, "YES"), "unknown": (2, "")}


def tables(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = []
    for name in schema.tables:
        rollup = schema.rollup_of(name)
        rows.append((None, None, name, "ROLLUP" if rollup else "TABLE", rollup.describe() if rollup else None))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TABLE_COLUMNS))


def columns(spark: SparkSession, schema: Schema, name: str) -> DataFrame:
    """Metrics, time, dimensions and link fields of a table, described as JDBC does."""
    table, rollup = schema.table(name), schema.rollup_of(name)

    def row(column: str, t: S.SqlType, nullable: str, remark: str | None = None) -> tuple:
        code, (number, word) = S.JDBC_CODES.get(t.name, 2003), _NULLABLE[nullable]
        given = {"TABLE_NAME": name, "COLUMN_NAME": column, "DATA_TYPE": code, "TYPE_NAME": t.name, "NULLABLE": number, "REMARKS": remark, "IS_NULLABLE": word, "SOURCE_DATA_TYPE": code, "IS_AUTOINCREMENT": "NO", "IS_GENERATEDCOLUMN": "NO"}
        return tuple(given.get(c) for c in COLUMN_COLUMNS)

    fields = rollup.fields if rollup else {}
    rows = [row(m.name, m.type, "yes", fields.get(m.name)) for m in table.metrics]
    rows.append(row("time", S.TIMESTAMP, "yes", rollup.time if rollup else None))
    rows += [row(d.name, d.type, "no", fields.get(d.name)) for d in table.dimensions]
    rows += [row(f"{k.name}_{f}", t, "unknown") for k in table.links for f, t in k.fields.items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in NUMBERS else 'string'}" for c in COLUMN_COLUMNS))


def functions(spark: SparkSession, type_name: str) -> DataFrame:
    t = S.by_name(type_name)
    if t is None:
        raise QueryError(f"Unknown type {type_name}")
    return spark.createDataFrame([(n,) for n in functions_for(t)], "NAME string")


def version(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([VERSION], "MAJOR int, MINOR int, VERSION string")
