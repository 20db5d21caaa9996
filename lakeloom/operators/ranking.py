"""Sorting, paging and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.windows import number_rows


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 (smaller numbers count as 1)."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence[object] | None, size: int) -> DataFrame:
    """The next rows after the key tuple ``after``: a row-value comparison that prunes, then a top-k."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(size)


def stable_sample(rows: DataFrame, key: Sequence[Column], seed: str, k: int) -> DataFrame:
    """The k rows with the smallest sha1(seed|key...): the same on every run and every partitioning."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in key])), *key).limit(k)


def promote(rows: DataFrame, has: Column, rank: str) -> DataFrame:
    """Rows that have it first, otherwise in their old order; rank is written anew."""
    first = F.when(has, 0).otherwise(1)
    return number_rows(rows.withColumn("_first", first), [F.col("_first"), F.col(rank)], "_new").drop("_first", rank).withColumnRenamed("_new", rank)


def newest_groups_first(rows: DataFrame, key: str, at: str) -> DataFrame:
    """rows with group_at: the time of the group's newest member; groups sort by it."""
    return rows.withColumn("group_at", F.max(at).over(W.partitionBy(key)))


def rare_first(terms: DataFrame, by: str, df: str = "df", budget: int = 50_000) -> DataFrame:
    """Terms of each question, rarest first, up to the one that takes the sum of df over the budget (the first always stays)."""
    w = W.partitionBy(by).orderBy(df, "term").rowsBetween(W.unboundedPreceding, -1)
    return terms.withColumn("before", F.coalesce(F.sum(df).over(w), F.lit(0))).where(F.col("before") < budget)
