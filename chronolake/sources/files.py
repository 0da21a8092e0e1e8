"""Files as sources and sinks of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Write a result with a header; ``single``: as one file, for results small enough for one writer."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def concatenated(results: Sequence[DataFrame]) -> DataFrame:
    """The rows of all results, one after another; columns by position."""
    out = results[0]
    for r in results[1:]:
        out = out.unionAll(r)
    return out


def exploded_index(df: DataFrame, key: str, array: str) -> DataFrame:
    """(element, key) for each distinct element of an array column."""
    return df.select(F.explode(F.array_distinct(F.col(array))).alias("element"), F.col(key))
