"""Lookup links of dimensions: outer, semi, anti and as-of joins, word search and related items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chronolake.functions.tokens import Tokenizer
from chronolake.operators.slices import SLICE_ROWS, slice_of
from chronolake.schema import Link
from chronolake.session import written


def one_per_key(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A link's rows with one row for each key: of several the greatest, so that the answer does not depend on order."""
    top = F.max(F.struct(*fields)).alias("_f")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"_f.{f}").alias(f) for f in fields])


def lookup(facts: DataFrame, link: Link, rows: DataFrame, prefix: str = "") -> DataFrame:
    """Left outer join with the link on its dimension; fields come as ``prefix + field``. Spark sizes the broadcast."""
    fields = list(link.fields)
    key = link.dimension
    if link.time_sensitive:
        return as_of(facts, rows, key, "time", fields, prefix)
    if link.ignore_case:
        rows = rows.withColumn(key, F.lower(key))
    found = one_per_key(rows, key, fields).select(F.col(key).alias("_key"), *[F.col(f).alias(prefix + f) for f in fields])
    own = F.lower(key) if link.ignore_case else F.col(key)
    return facts.join(found, own == F.col("_key"), "left").drop("_key")


#: Bytes of a time-sensitive link, as text, up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def as_of(facts: DataFrame, rows: DataFrame, key: str, time: str, fields: Sequence[str], prefix: str = "", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Values of the link in force at each fact's time: the latest row at or before it, before the first row the first.

    Of several link rows for one moment the greatest counts. A key without link rows, like a null key or a null time,
    gets nulls. The link's size is measured first; what is small is broadcast, each key's values in the order of their
    times, and the facts are read once where they lie. Else facts and link rows are united and sorted; see below.
    """
    value = F.struct(*[F.col(f) for f in fields])
    link = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias("_v"))
    size = link.agg(F.sum(F.lit(32) + F.coalesce(F.length(F.to_json("_v")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = link.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("at"), F.col("_v").alias("v")))).alias("_all")).select(F.col(key).alias("_key"), "_all")
        before = F.filter("_all", lambda x: x["at"] <= F.col(time))
        got = facts.join(F.broadcast(held), F.col(key) == F.col("_key"), "left").withColumn("_before", before)
        known = F.when(F.col(time).isNotNull(), F.when(F.size("_before") > 0, F.element_at("_before", -1)).otherwise(F.try_element_at("_all", F.lit(1))))
        return got.withColumn("_v", known["v"]).select(*[F.col(f"`{c}`") for c in facts.columns], *[F.col(f"_v.{f}").alias(prefix + f) for f in fields])
    return _as_of_sorted(facts, link, key, time, fields, prefix, slice_rows)


def _as_of_sorted(facts: DataFrame, link: DataFrame, key: str, time: str, fields: Sequence[str], prefix: str, slice_rows: int) -> DataFrame:
    """As-of lookup in a link of any size (one value ``_v`` for each key and time).

    Facts and link rows are united and read once in order of time within a key's slice of time, the link's row first on
    equal times; no pair of rows is ever formed. One summary row a slice carries the last value on to later slices, so
    that a key with very many rows is not one task.
    """
    wide = facts.select(key, time, F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_row"), F.lit(1).alias("_kind"))
    wide = wide.unionByName(link.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    wide = wide.withColumn("_slice", slice_of(wide, time, slice_rows))
    inside = Window.partitionBy(key, "_slice").orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = wide.groupBy(key, "_slice").agg(F.max_by(F.col("_v"), F.when(F.col("_kind") == 0, F.col(time))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_ckey"), F.col("_slice").alias("_cslice"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    first = link.groupBy(key).agg(F.min_by("_v", time).alias("_first")).select(F.col(key).alias("_key"), "_first")
    got = wide.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 1")
    got = got.join(carry, (F.col(key) == F.col("_ckey")) & (F.col("_slice") == F.col("_cslice")), "left").join(first, F.col(key) == F.col("_key"), "left")
    known = F.when(F.col(time).isNotNull(), F.coalesce("_v", "_carry", "_first"))
    return got.withColumn("_v", known).select("_row.*", *[F.col(f"_v.{f}").alias(prefix + f) for f in fields])


def matching_keys(rows: DataFrame, link: Link, condition: Column) -> DataFrame:
    """Keys of the link's rows that meet a condition on its fields, as ``_key``."""
    key = F.lower(link.dimension) if link.ignore_case else F.col(link.dimension)
    return rows.where(condition).select(key.alias("_key")).where(F.col("_key").isNotNull()).distinct()


def restrict(facts: DataFrame, link: Link, keys: DataFrame, exclude: bool = False) -> DataFrame:
    """Facts whose dimension is (or is not) among the keys."""
    own = F.lower(link.dimension) if link.ignore_case else F.col(link.dimension)
    return facts.join(keys, own == F.col("_key"), "left_anti" if exclude else "left_semi")


# words of items


def inverted_index(items: DataFrame, item: str, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(token, item) for each token of each distinct item."""
    return items.select(item).where(F.col(item).isNotNull()).distinct().select(F.explode(F.array_distinct(tokenizer.column(F.col(item)))).alias("token"), F.col(item))


class TokenIndex:
    """The words of items, stored: a Parquet table of (token, item), sorted by token, to which new items are added."""

    def __init__(self, spark: SparkSession, path: str, item: str, tokenizer: Tokenizer = Tokenizer()):
        self.spark, self.path, self.item, self.tokenizer = spark, path.rstrip("/"), item, tokenizer

    def read(self) -> DataFrame:
        schema = f"token string, `{self.item}` string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, items: DataFrame) -> None:
        """Index the items that are not there yet; items without any word are looked at again each time."""
        new = items.select(self.item).where(F.col(self.item).isNotNull()).distinct().join(self.read().select(self.item).distinct(), self.item, "left_anti")
        made = written(inverted_index(new, self.item, self.tokenizer), "new-tokens")
        made.repartitionByRange("token").sortWithinPartitions("token").write.mode("append").parquet(self.path)


def phrase_tokens(phrase: str, tokenizer: Tokenizer = Tokenizer()) -> list[tuple[str, bool]]:
    """(token, whether it is a prefix) of a search phrase; a word ending in % is a prefix and not stemmed."""
    out: list[tuple[str, bool]] = []
    for word in phrase.split(" "):
        if word.endswith("%"):
            prefix = tokenizer.spell(word[:-1].strip().lower())
            out += [(prefix, True)] if prefix else []
        else:
            out += [(t, False) for t in tokenizer.words(word) or []]
    return list(dict.fromkeys(out))


def items_with(index: DataFrame, item: str, phrases: Sequence[str], tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Items in which every word of at least one phrase occurs."""
    found = None
    for phrase in phrases:
        words = phrase_tokens(phrase, tokenizer)
        if not words:
            continue
        tests = [F.col("token").startswith(t) if prefix else F.col("token") == t for t, prefix in words]
        any_word = tests[0]
        for t in tests[1:]:
            any_word = any_word | t
        hits = [F.max(t.cast("int")).alias(f"_w{i}") for i, t in enumerate(tests)]
        one = index.where(any_word).groupBy(item).agg(*hits).where(" AND ".join(f"_w{i} = 1" for i in range(len(tests)))).select(item)
        found = one if found is None else found.unionAll(one)
    return index.select(item).limit(0) if found is None else found.distinct()


def filter_phrases(facts: DataFrame, item: str, include: Sequence[Sequence[str]] = (), exclude: Sequence[str] = (), index: DataFrame | None = None, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Facts whose item meets every condition of ``include`` (phrases of one condition are alternatives) and no phrase of ``exclude``.

    ``index``: (token, item) as a TokenIndex holds it. Without one the facts' distinct items are taken apart here, once
    for all conditions.
    """
    if index is None and (include or exclude):
        index = inverted_index(facts, item, tokenizer)
        if len(include) + bool(exclude) + sum(map(len, include)) + len(exclude) > 2:
            index = written(index, "tokens")
    for phrases in include:
        facts = facts.join(items_with(index, item, phrases, tokenizer), item, "left_semi")
    if exclude:
        facts = facts.join(items_with(index, item, exclude, tokenizer), item, "left_anti")
    return facts


def related(facts: DataFrame, matching: DataFrame, on: Sequence[str], exclude: bool = False) -> DataFrame:
    """Facts that share ``on`` (time and device, say) with any matching row, or with none."""
    return facts.join(matching.select(*on).distinct(), list(on), "left_anti" if exclude else "left_semi")
