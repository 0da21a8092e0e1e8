"""Queries of the text and sketch problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import digest, expsketch, leaks, packing, sentences
from chronolake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expsketch.distinct_counts(expsketch.receipt_distinct(table(spark, sf_dir, "kkm_items"), table(spark, sf_dir, "receipt"))).drop("exact")


#: What no estimate of a distinct count may be off by: five standard errors and a little, as a share of the count.
MAX_COUNT_ERROR = 0.17


def p4_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its exact count, as far as the registers' estimate keeps within MAX_COUNT_ERROR of it."""
    items, receipt = table(spark, sf_dir, "kkm_items"), table(spark, sf_dir, "receipt")
    keys = ("table_name", "dim_name", "grouped_by", "day_utc", "kkm_id", "operation_type")
    estimated = p4_distinct(spark, sf_dir).select(*keys, "estimate", F.lit(None).cast("bigint").alias("n"))
    counted = expsketch.exact_counts(items, receipt).select(*keys, F.lit(None).cast("double").alias("estimate"), "n")
    both = estimated.unionByName(counted).groupBy(*keys).agg(F.max("estimate").alias("estimate"), F.max("n").alias("n"))
    return both.where(F.abs(F.col("estimate") / F.col("n") - 1) <= MAX_COUNT_ERROR).select(*keys, "n")


def p4_small_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of the lists that hold short sketches, which are exact counts."""
    got = expsketch.distinct_counts(expsketch.receipt_distinct(table(spark, sf_dir, "kkm_items"), table(spark, sf_dir, "receipt")), exact_lists=True)
    return got.where("exact").select("table_name", "dim_name", "grouped_by", "day_utc", "kkm_id", F.col("operation_type"), F.col("estimate").cast("bigint").alias("n"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = digest.percentiles(table(spark, sf_dir, "query_metrics"), QS)
    names = [",".join(k for i, k in enumerate(digest.KEYS) if s >> i & 1) or "total" for s in range(8)]
    return got.select(
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("kept") + 1).alias("grouped_by"), "engine", "state",
        F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_utc"), "n",
        *[F.col("estimates")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(QS)], F.array_max("rank_errors").alias("rank_error"),
    )


def p6_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups and whether every percentile of theirs keeps the rank error bound."""
    return p6_percentiles(spark, sf_dir).select("grouped_by", "engine", "state", "day_utc", "n", (F.col("rank_error") <= digest.MAX_RANK_ERROR).alias("within_bound"))


def p6_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the groups whose digests hold every value, which are values of the group."""
    return p6_percentiles(spark, sf_dir).where(F.col("n") <= digest.EXACT).drop("rank_error")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens, the tokens of unused space, and the share filled."""
    filled = p8_pack(spark, sf_dir).where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return filled.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum(F.lit(packing.CAPACITY) - F.col("used")).alias("unused"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("filled"))


def p8_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every piece is there once, none of them in a container above the capacity."""
    packed = p8_pack(spark, sf_dir)
    full = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > packing.CAPACITY)
    over = packed.join(full, "container_id", "left_semi").select("doc_id").distinct()
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("distinct"), (F.max("piece_no") - F.min("piece_no") + 1).alias("span"), F.count("container_id").alias("placed"), F.sum("n_tokens").alias("tokens"))
    whole = pieces.where("n = distinct AND n = span AND (placed = n OR tokens = 0)")
    return whole.join(over, "doc_id", "left_anti").select("doc_id")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages left for training."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir)).select("doc_id", "lang", "source", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), with_text=True)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_distinct, p4_bounded, p4_small_sets, p6_percentiles, p6_certified, p6_small_groups, p8_pack, p8_fill, p8_complete, p9_found, p9_stretches, p9_clean, p10_found, p10_sentences)}



def _grouped_by(a: str, b: str, c: str) -> str:
    """The names of the keys kept, from GROUPING's bits (1: rolled up)."""
    return f"coalesce(nullif(concat_ws(',', CASE WHEN GROUPING({a}) = 0 THEN '{a.replace('day_utc', 'day')}' END, CASE WHEN GROUPING({b}) = 0 THEN '{b.replace('day_utc', 'day')}' END, CASE WHEN GROUPING({c}) = 0 THEN '{c.replace('day_utc', 'day')}' END), ''), 'total')"


def _exact_counts(condition: str) -> str:
    day = "strftime(dp_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_utc"
    parts = []
    for name, source in (("customer_code", "kkm_items"), ("item", "kkm_items")):
        parts.append(f"SELECT '{source}' AS table_name, '{name}' AS dim_name, {_grouped_by('day_utc', 'kkm_id', 'operation_type')} AS grouped_by, day_utc, kkm_id, operation_type, count(DISTINCT x) AS n FROM (SELECT {day}, kkm_id, operation_type, {name} AS x FROM {source}) GROUP BY CUBE (day_utc, kkm_id, operation_type)")
    both = "(SELECT dp_time, kkm_id, operation_type FROM kkm_items UNION ALL SELECT dp_time, kkm_id, operation_type FROM receipt)"
    for label, source in (("kkm_items", "kkm_items"), ("receipt", "receipt"), ("all", both)):
        names = "coalesce(nullif(concat_ws(',', CASE WHEN GROUPING(day_utc) = 0 THEN 'day' END, CASE WHEN GROUPING(operation_type) = 0 THEN 'operation_type' END), ''), 'total')"
        parts.append(f"SELECT '{label}' AS table_name, 'kkm_id' AS dim_name, {names} AS grouped_by, day_utc, CAST(NULL AS INTEGER) AS kkm_id, operation_type, count(DISTINCT x) AS n FROM (SELECT {day}, operation_type, kkm_id AS x FROM {source}) GROUP BY CUBE (day_utc, operation_type)")
    return "SELECT table_name, dim_name, grouped_by, day_utc, CAST(kkm_id AS INTEGER) AS kkm_id, CAST(operation_type AS INTEGER) AS operation_type, n FROM (" + " UNION ALL ".join(parts) + f") WHERE {condition}"


_LOG = (
    "WITH once AS (SELECT * FROM query_metrics QUALIFY row_number() OVER (PARTITION BY query_id, partition_id ORDER BY total_duration DESC NULLS LAST, state DESC NULLS LAST, engine DESC NULLS LAST, start_date DESC NULLS LAST) = 1), "
    "log AS (SELECT upper(trim(engine)) AS engine, upper(trim(state)) AS state, strftime(start_date AT TIME ZONE 'UTC', '%Y-%m-%d') AS day_utc, total_duration AS value FROM once WHERE total_duration >= 0) "
)

SQL: dict[str, str] = {
    "p8_complete": "SELECT doc_id FROM documents",
    "p4_bounded": _exact_counts("n >= 1"),
    "p4_small_sets": _exact_counts(f"n BETWEEN 1 AND {expsketch.SEEDS}"),
    "p6_certified": _LOG + f"SELECT {_grouped_by('engine', 'state', 'day_utc')} AS grouped_by, engine, state, day_utc, count(*) AS n, true AS within_bound FROM log GROUP BY CUBE (engine, state, day_utc)",
    "p6_small_groups": _LOG + f"SELECT {_grouped_by('engine', 'state', 'day_utc')} AS grouped_by, engine, state, day_utc, count(*) AS n, " + ", ".join(f"CAST(quantile_disc(value, {q}) AS DOUBLE) AS p{round(q * 100)}" for q in QS) + f" FROM log GROUP BY CUBE (engine, state, day_utc) HAVING count(*) <= {digest.EXACT}",
}
