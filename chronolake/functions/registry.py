"""What the dialect's operators and functions accept, give and become in Spark."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal
from typing import Any
from random import randrange

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake import types as S
from chronolake.dialect.parser import Period
from chronolake.functions.tokens import tokens_column
from chronolake.schema import QueryError
from chronolake.types import SqlType


@dataclass(frozen=True)
class Typed:
    """A column with its type and kind: const, simple, aggregate, window or invalid.

    ``value`` is the value of a constant, ``key`` a text equal for equal expressions.
    """

    column: Column
    type: SqlType
    kind: str
    key: str
    value: Any = None
    is_id: bool = False


def joined_kind(*kinds: str) -> str:
    """The kind of an expression over others: aggregates mix with constants only, windows with anything but aggregates."""
    seen = set(kinds) - {"const"}
    if not seen:
        return "const"
    if len(seen) == 1:
        return seen.pop()
    return "window" if seen == {"window", "simple"} else "invalid"


# constants


def literal(value: Any) -> Typed:
    """A constant as it stands in a statement: numbers are DECIMAL until an operand says otherwise."""
    key = f"{type(value).__name__}:{value}"
    if value is None:
        return Typed(F.lit(None), S.NULL, "const", key)
    if isinstance(value, bool):
        return Typed(F.lit(value), S.BOOLEAN, "const", key, value)
    if isinstance(value, Decimal):
        return Typed(F.lit(value), S.DECIMAL, "const", key, value)
    if isinstance(value, str):
        return Typed(F.lit(value), S.VARCHAR, "const", key, value)
    if isinstance(value, Period):
        return Typed(F.expr(f"make_interval(0, {value.months}, 0, 0, 0, 0, {value.millis / 1000})"), S.PERIOD, "const", key, value)
    if isinstance(value, (bytes, bytearray)):
        return Typed(F.lit(bytes(value)), S.BLOB, "const", key, value)
    if hasattr(value, "isoformat"):
        return Typed(F.lit(value), S.TIMESTAMP, "const", key, value)
    raise QueryError(f"Unsupported value {value!r}")


def const_as(c: Typed, target: SqlType) -> Typed:
    """A constant as another type, if its value allows."""
    if c.type == target:
        return c
    v = c.value
    if c.type == S.NULL:
        return Typed(F.lit(None).cast(target.spark), target, "const", c.key)
    if c.type == S.DECIMAL:
        if target in S.INTEGERS and v == v.to_integral_value() and -S.RANGES[target] <= v < S.RANGES[target]:
            return Typed(F.lit(int(v)).cast(target.spark), target, "const", c.key, int(v))
        if target == S.DOUBLE:
            return Typed(F.lit(float(v)), target, "const", c.key, float(v))
        if target == S.CURRENCY:
            cents = int(v.quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)
            return Typed(F.lit(cents).cast("bigint"), target, "const", c.key, cents)
        if target == S.VARCHAR:
            return Typed(F.lit(format(v, "f")), target, "const", c.key, format(v, "f"))
    if c.type == S.PERIOD and target == S.BIGINT:
        if v.months:
            raise QueryError("A period with months or years has no length in milliseconds")
        return Typed(F.lit(v.millis).cast("bigint"), target, "const", c.key, v.millis)
    if S.castable(c.type, target):
        return Typed(cast_column(c.column, c.type, target), target, "const", c.key, v)
    raise QueryError(f"Cannot convert {v} of type {c.type} to {target}")


def cast_column(c: Column, a: SqlType, b: SqlType) -> Column:
    """CAST between types that have one; money is cents inside."""
    if a == b:
        return c
    if a == S.CURRENCY:
        if b == S.VARCHAR:
            return (c.cast("decimal(38,2)") / 100).cast("decimal(38,2)").cast("string")
        if b == S.DECIMAL:
            return (c.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)")
        return (c / F.lit(100.0)).cast(b.spark)
    if b == S.CURRENCY:
        return (c.cast("bigint") * 100) if a == S.BIGINT else F.round(c * 100, 0).cast("bigint") if a == S.DECIMAL else (c * 100).cast("bigint")
    if a == S.TIMESTAMP and b == S.VARCHAR:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return c.cast(b.spark)


def cast(e: Typed, target: SqlType) -> Typed:
    if e.type == target:
        return e
    if e.kind == "const":
        return const_as(e, target)
    if not S.castable(e.type, target):
        raise QueryError(f"Cannot convert {e.key} of type {e.type} to {target}")
    return Typed(cast_column(e.column, e.type, target), target, e.kind, f"cast({e.key} as {target})")


def align(a: Typed, b: Typed) -> tuple[Typed, Typed]:
    """Both sides under one type: constants follow the other side, columns widen."""
    if a.type == b.type:
        return a, b
    if a.kind == "const" and b.kind != "const":
        return const_as(a, b.type), b
    if b.kind == "const" and a.kind != "const":
        return a, const_as(b, a.type)
    if S.NULL in (a.type, b.type):
        return (const_as(a, b.type), b) if a.type == S.NULL else (a, const_as(b, a.type))
    if S.widens(a.type, b.type):
        return cast(a, b.type), b
    if S.widens(b.type, a.type):
        return a, cast(b, a.type)
    raise QueryError(f"Incompatible types {a.type}({a.key}) and {b.type}({b.key})")


# arithmetic


def _made(column: Column, t: SqlType, op: str, a: Typed, b: Typed) -> Typed:
    return Typed(column, t, joined_kind(a.kind, b.kind), f"({a.key} {op} {b.key})")


def _follow(a: Typed, b: Typed, targets: Callable[[SqlType], tuple[SqlType, ...]]) -> tuple[Typed, Typed]:
    """A constant next to a column becomes the first of the types that its value fits."""
    if a.kind == "const" and b.kind != "const" and a.type != b.type:
        return _first(a, targets(b.type)), b
    if b.kind == "const" and a.kind != "const" and a.type != b.type:
        return a, _first(b, targets(a.type))
    return a, b


def _first(c: Typed, targets: tuple[SqlType, ...]) -> Typed:
    for t in targets:
        try:
            return const_as(c, t)
        except QueryError:
            continue
    return c


def _shift(time: Column, period: Typed, sign: int) -> Column:
    p = period.value
    if p is None:
        return time + period.column if sign > 0 else time - period.column
    return time + F.expr(f"make_interval(0, {sign * p.months}, 0, 0, 0, 0, {sign * p.millis / 1000})")


def _moved(a: Typed, b: Typed, sign: int) -> Typed:
    """A time moved by a period; constants stay constants."""
    if a.kind == b.kind == "const" and a.value is not None and b.value is not None:
        month = a.value.year * 12 + a.value.month - 1 + sign * b.value.months
        year, month = divmod(month, 12)
        day = min(a.value.day, monthrange(year, month + 1)[1])
        return literal(a.value.replace(year=year, month=month + 1, day=day) + timedelta(milliseconds=sign * b.value.millis))
    return _made(_shift(a.column, b, sign), S.TIMESTAMP, "+" if sign > 0 else "-", a, b)


def _mixed(a: SqlType, b: SqlType) -> SqlType | None:
    """The type in which two numbers are added, subtracted or multiplied."""
    if a == b and a.numeric and a != S.CURRENCY:
        return a
    pair = {a, b}
    if pair == {S.DOUBLE, S.DECIMAL}:
        return S.DECIMAL
    return S.DOUBLE if pair == {S.DOUBLE, S.BIGINT} else None


def add(a: Typed, b: Typed) -> Typed:
    if a.type == b.type == S.PERIOD:
        if a.value is None or b.value is None:
            return _made(a.column + b.column, S.PERIOD, "+", a, b)
        both = Period(a.value.months + b.value.months, a.value.millis + b.value.millis)
        return literal(both)
    if (a.type, b.type) == (S.TIMESTAMP, S.PERIOD):
        return _moved(a, b, 1)
    a, b = _follow(a, b, lambda t: (t,))
    if a.type == b.type == S.VARCHAR:
        return _made(F.concat(a.column, b.column), S.VARCHAR, "+", a, b)
    if a.type == b.type == S.CURRENCY:
        return _made(a.column + b.column, S.CURRENCY, "+", a, b)
    t = _mixed(a.type, b.type)
    if t is None:
        raise QueryError(f"Unsupported operation + on {a.type} and {b.type}")
    return _made((a.column.cast(t.spark) + b.column.cast(t.spark)).cast(t.spark), t, "+", a, b)


def subtract(a: Typed, b: Typed) -> Typed:
    if (a.type, b.type) == (S.TIMESTAMP, S.PERIOD):
        return _moved(a, b, -1)
    a, b = _follow(a, b, lambda t: (t,))
    if a.type == b.type == S.TIMESTAMP:
        return _made(F.abs(F.unix_millis(a.column) - F.unix_millis(b.column)), S.BIGINT, "-", a, b)
    if a.type == b.type == S.CURRENCY:
        return _made(a.column - b.column, S.CURRENCY, "-", a, b)
    t = _mixed(a.type, b.type) if {a.type, b.type} != {S.DOUBLE, S.BIGINT} else None
    if t is None:
        raise QueryError(f"Unsupported operation - on {a.type} and {b.type}")
    return _made((a.column.cast(t.spark) - b.column.cast(t.spark)).cast(t.spark), t, "-", a, b)


def multiply(a: Typed, b: Typed) -> Typed:
    a, b = _follow(a, b, lambda t: (S.BIGINT, S.DOUBLE) if t == S.CURRENCY else (t, S.DOUBLE, S.DECIMAL))
    for money, other in ((a, b), (b, a)):
        if money.type == S.CURRENCY and other.type in (S.BIGINT, S.INTEGER, S.DOUBLE, S.DECIMAL):
            return _made((money.column * other.column).cast("bigint"), S.CURRENCY, "*", a, b)
    t = _mixed(a.type, b.type)
    if t is None:
        raise QueryError(f"Unsupported operation * on {a.type} and {b.type}")
    return _made((a.column.cast(t.spark) * b.column.cast(t.spark)).cast(t.spark), t, "*", a, b)


def _float_quotient(x: Column, y: Column) -> Column:
    """IEEE division: by zero it is infinite or no number."""
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def _whole_quotient(x: Column, y: Column) -> Column:
    """Quotient cut towards zero; division by zero is an error, as Spark raises it."""
    return F.call_function("div", x.cast("bigint"), y.cast("bigint"))


def divide(a: Typed, b: Typed) -> Typed:
    a, b = _follow(a, b, lambda t: (S.BIGINT, S.DOUBLE) if t == S.CURRENCY else (t, S.DOUBLE, S.DECIMAL))
    x, y = a.column, b.column
    if a.type == S.CURRENCY:
        if b.type == S.CURRENCY:
            return _made(_float_quotient(x.cast("double"), y.cast("double")), S.DOUBLE, "/", a, b)
        if b.type in (S.BIGINT, S.INTEGER):
            return _made(_whole_quotient(x, y), S.CURRENCY, "/", a, b)
        if b.type in (S.DOUBLE, S.DECIMAL):
            return _made((x / y).cast("bigint"), S.CURRENCY, "/", a, b)
    if a.type == b.type and a.type in S.INTEGERS:
        return _made(_whole_quotient(x, y).cast(a.type.spark), a.type, "/", a, b)
    if S.DECIMAL in (a.type, b.type) and _mixed(a.type, b.type) == S.DECIMAL:
        scale = 17 if a.type == S.DOUBLE else 2  # the left operand's
        quotient = F.bround(x.cast("decimal(38,18)") / y.cast("decimal(38,18)"), 2) if scale == 2 else F.bround(x.cast("decimal(38,17)") / y.cast("decimal(38,17)"), 17)
        return _made(quotient.cast(S.DECIMAL.spark) if scale == 2 else quotient, S.DECIMAL, "/", a, b)
    if a.type == b.type == S.DOUBLE or {a.type, b.type} in ({S.DOUBLE, S.BIGINT}, {S.DOUBLE, S.INTEGER}):
        return _made(_float_quotient(x.cast("double"), y.cast("double")), S.DOUBLE, "/", a, b)
    raise QueryError(f"Unsupported operation / on {a.type} and {b.type}")


ARITHMETIC = {"+": add, "-": subtract, "*": multiply, "/": divide}


# functions of one argument


@dataclass(frozen=True)
class Unary:
    """A function of one argument: which types it takes, what it gives, and how."""

    accepts: Callable[[SqlType], bool]
    gives: Callable[[SqlType], SqlType]
    build: Callable[[Column, SqlType], Column]
    kind: str = "simple"


def _is(*types: SqlType) -> Callable[[SqlType], bool]:
    return lambda t: t in types


def _any(t: SqlType) -> bool:
    return True


def _number(t: SqlType) -> bool:
    return t.numeric


def _ordered(t: SqlType) -> bool:
    return t.ordered


def _array(t: SqlType) -> bool:
    return t.element is not None


def _same(t: SqlType) -> SqlType:
    return t


def _sum_type(t: SqlType) -> SqlType:
    return S.INTEGER if t in (S.TINYINT, S.SMALLINT) else t


def _sum(c: Column, t: SqlType) -> Column:
    """Sums of whole numbers are made as BIGINT; what exceeds the declared type is null rather than wrapped."""
    total = F.sum(c)
    return total.try_cast("int") if t in (S.TINYINT, S.SMALLINT, S.INTEGER) else total.cast(t.spark)


def _avg(c: Column, t: SqlType) -> Column:
    mean = F.avg(cast_column(c, t, S.DECIMAL) if t == S.CURRENCY else c)
    return mean if t == S.DECIMAL else mean.cast("double").cast("decimal(38,18)")


def _any_of(c: Column) -> Column:
    """A value of the group, each distinct one with the same chance: that with the least hash under a seed of the query's own."""
    return F.min_by(c, F.when(c.isNotNull(), F.xxhash64(F.lit(randrange(1 << 62)), c)))


def _split(c: Column) -> Column:
    """Runs of other than letters and digits part; one in front leaves an empty word, one behind none."""
    parts = F.split(c, r"[^\p{L}\p{Nd}]+")
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def _text(c: Column, t: SqlType) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")


TRUNCATIONS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_EXTRACTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}

UNARY: dict[str, list[Unary]] = {
    "sum": [Unary(_number, _sum_type, _sum, "aggregate")],
    "min": [Unary(_ordered, _same, lambda c, t: F.min(c), "aggregate")],
    "max": [Unary(_ordered, _same, lambda c, t: F.max(c), "aggregate")],
    "avg": [Unary(_number, lambda t: S.DECIMAL, _avg, "aggregate")],
    "count": [Unary(_any, lambda t: S.BIGINT, lambda c, t: F.count(c), "aggregate")],
    "distinct_count": [Unary(_any, lambda t: S.INTEGER, lambda c, t: F.count_distinct(c).cast("int"), "aggregate")],
    "distinct_random": [Unary(_any, _same, lambda c, t: _any_of(c), "aggregate")],
    "lag": [Unary(_any, _same, lambda c, t: c, "window")],
    "abs": [Unary(_number, _same, lambda c, t: F.abs(c))],
    "-": [Unary(_number, _same, lambda c, t: -c)],
    "is_null": [Unary(_any, lambda t: S.BOOLEAN, lambda c, t: c.isNull())],
    "is_not_null": [Unary(_any, lambda t: S.BOOLEAN, lambda c, t: c.isNotNull())],
    "not": [Unary(_is(S.BOOLEAN), _same, lambda c, t: ~c)],
    "length": [Unary(_is(S.VARCHAR), lambda t: S.INTEGER, lambda c, t: F.length(c)), Unary(_array, lambda t: S.INTEGER, lambda c, t: F.size(c))],
    "lower": [Unary(_is(S.VARCHAR), _same, lambda c, t: F.lower(c))],
    "upper": [Unary(_is(S.VARCHAR), _same, lambda c, t: F.upper(c))],
    "split": [Unary(_is(S.VARCHAR), lambda t: S.array_of(S.VARCHAR), lambda c, t: _split(c))],
    "tokens": [
        Unary(_is(S.VARCHAR), lambda t: S.array_of(S.VARCHAR), lambda c, t: tokens_column(c)),
        Unary(_is(S.array_of(S.VARCHAR)), _same, lambda c, t: tokens_column(F.array_join(c, " "))),
    ],
    "array_to_string": [Unary(_array, lambda t: S.VARCHAR, _text)],
    **{name: [Unary(_is(S.TIMESTAMP), _same, lambda c, t, u=u: F.date_trunc(u, c))] for u in TRUNCATIONS for name in (u, f"trunc_{u}")},
    **{f"extract_{u}": [Unary(_is(S.TIMESTAMP), lambda t: S.INTEGER, lambda c, t, f=f: f(c).cast("int"))] for u, f in _EXTRACTS.items()},
}


def unary(name: str, e: Typed) -> Typed:
    rules = UNARY.get(name)
    if not rules:
        raise QueryError(f"Undefined function {name}")
    rule = next((r for r in rules if r.accepts(e.type)), None)
    if rule is None:
        raise QueryError(f"Function {name} can not be applied to {e.key} of type {e.type}")
    kind = e.kind
    if rule.kind != "simple":
        kind = rule.kind if e.kind in ("const", "simple") else "invalid"
    return Typed(rule.build(e.column, e.type), rule.gives(e.type), kind, f"{name}({e.key})")


def functions_for(t: SqlType) -> list[str]:
    """Names of the functions of one argument that take a type."""
    return sorted(n for n, rules in UNARY.items() if n != "id" and any(r.accepts(t) for r in rules))


# functions of two arguments

#: Below this error the sparse counter is not safe to run; a sketch with 2^lg registers takes over, then exact counting.
_SAFE_RSD = 0.01
HLL_TYPES = ("VARCHAR", "BIGINT", "TIMESTAMP")


def hll_count(e: Typed, error: Typed) -> Typed:
    if error.kind != "const" or not isinstance(error.value, Decimal):
        raise QueryError(f"Expected constant but got {error.key}")
    if e.type.name not in HLL_TYPES:
        raise QueryError(f"hll_count is not defined for given datatype: {e.type}")
    if not Decimal("0.00003") <= error.value <= Decimal("0.367"):
        raise QueryError(f"std_err must be in range (0.00003, 0.367), but: std_err={error.value}")
    err = float(error.value)
    if err >= _SAFE_RSD:
        column = F.approx_count_distinct(e.column, err)
    else:
        lg = next((k for k in range(12, 22) if 1.04 / 2 ** (k / 2) <= err), None)
        value = F.when(e.column.isNotNull(), F.xxhash64(e.column))  # the sketch itself skips empty texts
        column = F.count_distinct(e.column) if lg is None else F.hll_sketch_estimate(F.hll_sketch_agg(value, lg))
    kind = "aggregate" if e.kind in ("const", "simple") else "invalid"
    return Typed(F.coalesce(column, F.lit(0)).cast("bigint"), S.BIGINT, kind, f"hll_count({e.key},{err})")


def _contains(a: Column, b: Column) -> Column:
    return F.array_contains(a, b)


_ARRAY_PAIRS: dict[str, Callable[[Column, Column], Column]] = {
    "contains_any": lambda a, b: F.exists(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False))),
    "contains_all": lambda a, b: F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False))),
    "contains_same": lambda a, b: (F.size(a) == F.size(b)) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))),
}
BINARY = ("contains", *_ARRAY_PAIRS, "hll_count")


def binary(name: str, a: Typed, b: Typed) -> Typed:
    if name == "hll_count":
        return hll_count(a, b)
    if name not in BINARY:
        raise QueryError(f"Undefined function {name}")
    if a.type.element is None:
        raise QueryError(f"Function {name} can not be applied to {a.key}, {b.key} of types {a.type}, {b.type}")
    if name == "contains":
        b = cast(b, a.type.element) if b.type != a.type.element else b
        return _made(_contains(a.column, b.column), S.BOOLEAN, name, a, b)
    if a.type != b.type:
        raise QueryError(f"Function {name} can not be applied to {a.key}, {b.key} of types {a.type}, {b.type}")
    return _made(_ARRAY_PAIRS[name](a.column, b.column), S.BOOLEAN, name, a, b)
