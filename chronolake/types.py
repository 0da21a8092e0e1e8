"""SQL types of the dialect and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class SqlType:
    """A type by its SQL name; ``element`` for arrays, ``parts`` for tuples."""

    name: str
    spark: str = ""
    ordered: bool = False
    numeric: bool = False
    element: SqlType | None = None

    def __str__(self) -> str:
        return self.name


BOOLEAN = SqlType("BOOLEAN", "boolean", ordered=True)
VARCHAR = SqlType("VARCHAR", "string", ordered=True)
TINYINT = SqlType("TINYINT", "tinyint", ordered=True, numeric=True)
SMALLINT = SqlType("SMALLINT", "smallint", ordered=True, numeric=True)
INTEGER = SqlType("INTEGER", "int", ordered=True, numeric=True)
BIGINT = SqlType("BIGINT", "bigint", ordered=True, numeric=True)
DOUBLE = SqlType("DOUBLE", "double", ordered=True, numeric=True)
DECIMAL = SqlType("DECIMAL", "decimal(38,2)", ordered=True, numeric=True)
#: Money as a count of cents.
CURRENCY = SqlType("CURRENCY", "bigint", ordered=True, numeric=True)
TIMESTAMP = SqlType("TIMESTAMP", "timestamp", ordered=True)
PERIOD = SqlType("PERIOD", "interval")
BLOB = SqlType("BLOB", "binary")
NULL = SqlType("NULL", "void")
TUPLE = SqlType("TUPLE", "struct")

SIMPLE = {t.name: t for t in (BOOLEAN, VARCHAR, TINYINT, SMALLINT, INTEGER, BIGINT, DOUBLE, DECIMAL, CURRENCY, TIMESTAMP, PERIOD, BLOB, NULL)}
INTEGERS = (TINYINT, SMALLINT, INTEGER, BIGINT)
RANGES = {TINYINT: 1 << 7, SMALLINT: 1 << 15, INTEGER: 1 << 31, BIGINT: 1 << 63, CURRENCY: 1 << 63}
#: java.sql.Types codes.
JDBC_CODES = {"BOOLEAN": 16, "VARCHAR": 12, "TINYINT": -6, "SMALLINT": 5, "INTEGER": 4, "BIGINT": -5, "DOUBLE": 8, "DECIMAL": 3, "CURRENCY": 3, "TIMESTAMP": 93, "PERIOD": 12, "BLOB": 2004, "NULL": 0}

_WIDER = {
    TINYINT: (SMALLINT, INTEGER, BIGINT, DECIMAL, DOUBLE),
    SMALLINT: (INTEGER, BIGINT, DECIMAL, DOUBLE),
    INTEGER: (BIGINT, DECIMAL, DOUBLE),
    BIGINT: (DECIMAL, DOUBLE),
    DOUBLE: (DECIMAL,),
}
_BY_HAND = {(DECIMAL, CURRENCY), (BIGINT, CURRENCY), (DOUBLE, CURRENCY), (DOUBLE, BIGINT), (CURRENCY, DECIMAL), (CURRENCY, BIGINT), (CURRENCY, DOUBLE)}


def array_of(element: SqlType) -> SqlType:
    return SqlType(f"ARRAY[{element.name}]", f"array<{element.spark}>", element=element)


def by_name(name: str) -> SqlType | None:
    """A type by its SQL name, ``ARRAY[T]`` included; case does not matter."""
    name = name.strip().upper()
    if name.startswith("ARRAY[") and name.endswith("]"):
        inner = by_name(name[6:-1])
        return array_of(inner) if inner else None
    return SIMPLE.get(name)


def widens(a: SqlType, b: SqlType) -> bool:
    """Whether a becomes b by itself."""
    return b in _WIDER.get(a, ())


def castable(a: SqlType, b: SqlType) -> bool:
    """Whether CAST(a AS b) exists."""
    return a == b or widens(a, b) or b == VARCHAR or (a, b) in _BY_HAND


def of_spark(t: T.DataType) -> SqlType:
    """The SQL type under which a Spark column of a source appears."""
    if isinstance(t, T.ArrayType):
        return array_of(of_spark(t.elementType))
    if isinstance(t, T.DecimalType):
        return DECIMAL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIMESTAMP
    return {"boolean": BOOLEAN, "string": VARCHAR, "tinyint": TINYINT, "smallint": SMALLINT, "int": INTEGER, "bigint": BIGINT, "float": DOUBLE, "double": DOUBLE, "binary": BLOB, "void": NULL}.get(t.simpleString(), VARCHAR)
