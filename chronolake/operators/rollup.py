"""Rollups: materialised aggregates of one table in others."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.dialect.parser import Node, Parser, Select
from chronolake.operators.ingest import Store
from chronolake.plans.select import Planner
from chronolake.schema import Rollup, Schema
from chronolake.session import written


def _expression(text: str) -> Node:
    return Parser(text).condition()


def compute(spark: SparkSession, schema: Schema, rollup: Rollup, start: datetime, stop: datetime) -> DataFrame:
    """The rollup's rows for source times in [start, stop): its time column, its keys and its fields."""
    bounds = [Node(">=", (Node("field", value="time"), Node("const", value=start))), Node("<", (Node("field", value="time"), Node("const", value=stop)))]
    if rollup.custom:
        df = schema.rows(spark, rollup.source, [(start, stop)])
        return rollup.custom(df.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(stop))))
    where = Node("and", (*bounds, *([_expression(rollup.where)] if rollup.where else [])))
    time = _expression(rollup.time)
    keys = [_expression(g) for g in rollup.group_by]
    fields = [(time, "_bucket"), *[(_expression(e), n) for n, e in rollup.fields.items()]]
    query = Select(rollup.source, fields, where, [time, *keys])
    return Planner(spark, schema).plan(query).withColumnRenamed("_bucket", "time")


def run(spark: SparkSession, schema: Schema, rollup: Rollup, store: Store, start: datetime, stop: datetime, user: str | None = "rollup") -> None:
    """Compute a rollup and put it into each of its targets, which keep the columns they have."""
    rows = compute(spark, schema, rollup, start, stop)
    if len(rollup.targets) > 1:
        rows = written(rows, f"rollup-{rollup.name}")
    for name in rollup.targets:
        store.put(schema.table(name), rows, user)
