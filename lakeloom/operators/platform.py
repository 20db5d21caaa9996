"""Small rules of a document platform: tables by content, usual styles, causes of gaps, training runs, stale indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the rules.
NUMBER, PERCENT = r"^\s*-?[0-9][0-9,]*(?:\.[0-9]+)?\s*$", r"^\s*-?[0-9][0-9,]*(?:\.[0-9]+)?\s*%\s*$"
RECENT_STEPS, DIVERGES = 5, 2.0


def cell_kind(text: Column) -> Column:
    """percent, number, empty or text."""
    return F.when(text.rlike(PERCENT), "percent").when(text.rlike(NUMBER), "number").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise("text")


def classify_tables(cells: DataFrame, table: str = "table", kind: str = "kind") -> DataFrame:
    """(table, kind, cells): the kind most of a table's cells are of (equal counts go to the greater name), and how many cells it has."""
    c = cells.groupBy(table, kind).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(table).agg(F.max_by(kind, F.struct("n", kind)).alias(kind), F.sum("n").alias("cells"))


def usual_style(rows: DataFrame, group: str, style: str, weight: Column | None = None, least: int = 1, share: float = 0.0) -> DataFrame:
    """(group, style, n): the style with the most weight (rows, if none is given) in each group that has enough and where it is usual enough."""
    c = rows.groupBy(group, style).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    g = c.groupBy(group).agg(F.max_by(style, F.struct("n", style)).alias(style), F.max("n").alias("n"), F.sum("n").alias("_s"))
    return g.where((F.col("_s") >= least) & (F.col("n") >= share * F.col("_s"))).drop("_s")


def gap_causes(fields: DataFrame, heading: str, evidence: Column, pending: Column) -> DataFrame:
    """(heading, cause, n): why fields are empty: no evidence was found, an answer is pending, or they are filled."""
    cause = F.when(~evidence, "no evidence").when(pending, "pending").otherwise("filled")
    return fields.groupBy(heading, cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def training_status(steps: DataFrame, run: str, order: list[str], loss: str) -> DataFrame:
    """(run, status): diverging, improving or flat, by the mean of the last steps against the first."""
    w = W.partitionBy(run).orderBy(*order)
    s = steps.withColumns({"_recent": F.avg(loss).over(w.rowsBetween(1 - RECENT_STEPS, 0)), "_first": F.first(loss).over(w), "_r": F.row_number().over(W.partitionBy(run).orderBy(*[F.desc(c) for c in order]))})
    return s.where("_r = 1").select(run, F.when(F.col("_recent") > DIVERGES * F.col("_first"), "diverging").when(F.col("_recent") < F.col("_first"), "improving").otherwise("flat").alias("status"))


def stale_indexes(current: DataFrame, indexed: DataFrame, source: str, digest: str) -> DataFrame:
    """(source, chunks, indexed, stale): an index is stale if a chunk of its source is missing, changed or gone; digests are compared as one sum, not one by one."""
    sums = lambda df, n: df.groupBy(source).agg(F.count(F.lit(1)).alias(n), F.sum(F.xxhash64(digest).cast("decimal(38,0)")).alias(f"_{n}"))
    j = sums(current, "chunks").join(sums(indexed, "indexed"), source, "full_outer")
    zero = F.lit(0)
    same = F.col("_chunks").eqNullSafe(F.col("_indexed")) & F.col("chunks").eqNullSafe(F.col("indexed"))
    return j.select(source, F.coalesce("chunks", zero).alias("chunks"), F.coalesce("indexed", zero).alias("indexed"), (~same).alias("stale"))
