"""Aggregation operators that one groupBy doesn't say by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut

#: Keys whose sums a task of the bootstrap holds at once.
BOOTSTRAP_KEYS = 1_000


def facets(rows: DataFrame, filters: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """(facet, value, n): each facet is counted under all filters but its own.

    Rows are aggregated once over all keys; the facets only see that aggregate.
    """
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def one(facet: str) -> DataFrame:
        kept = [F.col(k) == v for k, v in filters.items() if k != facet]
        return base.where(reduce(lambda a, b: a & b, kept, F.lit(True))).groupBy(F.col(facet).cast("string").alias("value")).agg(F.sum("n").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")

    return reduce(DataFrame.unionByName, [one(k) for k in keys])


def pivot_top(rows: DataFrame, key: str, column: str, top: Sequence[str]) -> DataFrame:
    """key x column counts: one column for each of ``top``, a rest column and the total, in one conditional aggregate."""
    listed = F.col(column).isin(list(top))
    cells = [F.count_if(F.col(column) == v).alias(f"c_{i}") for i, v in enumerate(top)]
    return rows.groupBy(key).agg(*cells, F.count_if(F.coalesce(~listed, F.lit(True))).alias("rest"), F.count(F.lit(1)).alias("total"))


def top_values(rows: DataFrame, column: str, n: int) -> list[str]:
    """The n most frequent values (ties by value): at most n rows reach the driver."""
    return [r[0] for r in rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(n).collect()]


def document_frequency(terms: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """(term, df) with distinct documents; duplicates go in a partial aggregate before the count."""
    return terms.select(doc, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: Column | int, kind: str = "lexical") -> Column:
    """lexical: ln(1 + n / (1 + df)); align: ln((n + 1) / (df + 0.5)); route: ln(1 + n / df)."""
    n = F.lit(n) if isinstance(n, int) else n
    if kind == "align":
        return F.log((n + 1) / (df + F.lit(0.5)))
    return F.log(1 + n / (1 + df)) if kind == "lexical" else F.log(1 + n / df)


def boilerplate_terms(terms: DataFrame, group: str, term: str, least: int = 3, share: float = 0.05) -> DataFrame:
    """Terms that occur in at least max(least, ceil(share * groups)) groups."""
    groups = terms.agg(F.countDistinct(group).alias("groups"))
    df = document_frequency(terms, group, term)
    return df.crossJoin(groups).where(F.col("df") >= F.greatest(F.lit(least), F.ceil(F.col("groups") * share))).select(term, "df")


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, mean): per group the mean vector, scaled to length one. Sums per position combine before the shuffle."""
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return mean.select(key, F.transform("mean", lambda x: x / (norm + F.lit(1e-9))).alias("mean"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def noise_floor(vectors: DataFrame, k: float = 3.0, pairs: int = 20_000, least: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(n, floor): mean + k * deviation of the cosine of up to ``pairs`` pairs of neighbours in a hash order; null below ``least`` vectors.

    Each vector with a small enough hash is paired with the next in that order, so
    a pair costs one lead() in a bounded sample rather than a join.
    """
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    sample = vectors.select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(pairs)
    sample = sample.withColumn("next", F.lead(vector).over(W.orderBy("h")))
    stats = sample.where("next is not null").select(dot(vector, "next").alias("s")).agg((F.avg("s") + k * F.stddev_pop("s")).alias("f"))
    return n.crossJoin(stats).select("n", F.when(F.col("n") >= least, F.col("f")).alias("floor"))


def dominant_share(rows: DataFrame, path: str, label: str, share: float = 0.7, least: int = 10) -> DataFrame:
    """(path, label): for each folder the label of most documents at or below it, taken from the nearest folder with a clear majority."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    per = rows.select(path, label).select(F.explode(ancestors).alias("folder"), label).groupBy("folder", label).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("folder").agg(F.sum("n").alias("total"), F.max_by(label, F.struct("n", label)).alias(label), F.max("n").alias("top"))
    clear = total.where((F.col("total") >= least) & (F.col("top") >= share * F.col("total")))
    named = rows.select(path).distinct().select(path, F.explode(ancestors).alias("folder"))
    return named.join(clear, "folder").groupBy(path).agg(F.max_by(label, F.length("folder")).alias(label))


def percentiles(rows: DataFrame, key: str, value: str, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, a column for each place): the values at places of each key's sorted values, from 0, given the number n of them; nulls don't count.

    Equal values are one row with a count. These lie in ranges of (key, value): places are found by the sums of the
    ranges before and a running sum within one, so no task has all of a key. A key without values has no row.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    c = cut(c.repartitionByRange("k", "v").withColumn("r", F.spark_partition_id()))
    per = W.partitionBy("k")
    sums = c.groupBy("k", "r").agg(F.sum("c").alias("s")).select(F.col("k").alias("k2"), F.col("r").alias("r2"), (F.sum("s").over(per.orderBy("r")) - F.col("s")).alias("before"), F.sum("s").over(per).alias("n"))
    j = c.join(sums, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")))
    up_to = F.col("before") + F.sum("c").over(W.partitionBy("r", "k").orderBy("v"))
    j = j.select("k", "v", "n", (up_to - F.col("c")).alias("low"), up_to.alias("high"))
    here = {name: F.when((at(F.col("n")) >= F.col("low")) & (at(F.col("n")) < F.col("high")), F.col("v")) for name, at in places.items()}
    return j.groupBy(F.col("k").alias(key)).agg(*[F.max(v).alias(name) for name, v in here.items()])


def at_share(share: float) -> Callable[[Column], Column]:
    """Not interpolated: the place min(n - 1, floor(share * n))."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(share)))


def percentile_rank(column: str, share: float) -> Column:
    """As at_share, for groups of a bounded size."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * share).cast("int")))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval."""
    p, z2 = hits / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def bootstrap(rows: DataFrame, key: str, value: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """(key, mean, low, high): a 95% interval of each group's mean by the Poisson bootstrap; null keys and values don't count.

    Equal values of a group are one row with a count c: together they enter each
    replicate with a Poisson(c) weight, drawn from a generator that the value itself seeds, so that
    reruns and retried tasks agree. Tasks add weights up: one row of sums for each key and task is shuffled, not one for each value and replicate.
    """
    each = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    each = each.withColumn("h", F.xxhash64(F.col(key), "v", F.lit(seed)))
    kind = each.schema[key].dataType.simpleString()

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, list[np.ndarray]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({key: list(sums), "w": [s[0] for s in sums.values()], "x": [s[1] for s in sums.values()]})

        for pdf in batches:
            for k, v, c, h in zip(pdf[key], pdf["v"], pdf["c"], pdf["h"], strict=True):
                weights = np.random.Generator(np.random.Philox(key=int(h) & (1 << 64) - 1)).poisson(c, reps).astype(float)
                mine = sums.setdefault(k, [np.zeros(reps), np.zeros(reps)])
                mine[0] += weights
                mine[1] += weights * v
                if len(sums) == BOOTSTRAP_KEYS:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    added = each.mapInPandas(drawn, f"{key} {kind}, w array<double>, x array<double>").select(key, F.posexplode(F.arrays_zip("w", "x")).alias("r", "s"))
    means = added.groupBy(key, "r").agg((F.sum("s.x") / F.nullif(F.sum("s.w"), F.lit(0.0))).alias("m"))
    ends = means.where("m is not null").groupBy(key).agg(percentile_rank("m", 0.025).alias("low"), percentile_rank("m", 0.975).alias("high"))
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).join(ends, key)


def co_mentions(mentions: DataFrame, doc: str, name: str, least_docs: int = 5, share: float = 0.02) -> DataFrame:
    """(a, b, n, share): pairs named together in enough documents; share is of the documents of the rarer name."""
    m = mentions.select(doc, name).distinct()
    total = cut(m.groupBy(name).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs))
    m = m.join(total.select(name), name, "left_semi")  # rarer names are in no pair
    pairs = m.select(doc, F.col(name).alias("a")).join(m.select(doc, F.col(name).alias("b")), doc).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    j = pairs.join(total.select(F.col(name).alias("a"), F.col("docs").alias("da")), "a").join(total.select(F.col(name).alias("b"), F.col("docs").alias("db")), "b")
    return j.select("a", "b", "n", (F.col("n") / F.least("da", "db")).alias("share")).where(F.col("share") >= share)


def fact_aggregate(facts: DataFrame, group: Sequence[Column], value: Column, unit: Column, source: Sequence[str], unit_share: float = 0.6) -> DataFrame:
    """Totals of extracted facts by group, with share of the grand total.

    A value repeated from the same source counts once. Within a group the unit
    of at least unit_share of the values is the group's; values of another unit are
    left out of the sum (and counted as off_unit). Sums are exact decimals.
    """
    names = [f"g{i}" for i in range(len(group))]
    f = facts.select(*[g.alias(n) for g, n in zip(group, names, strict=True)], value.cast("decimal(38,6)").alias("value"), F.coalesce(unit, F.lit("")).alias("unit"), *source)
    f = f.dropDuplicates([*names, "value", "unit", *source])
    per_unit = f.where("value is not null").groupBy(*names, "unit").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    g = per_unit.groupBy(*names).agg(
        F.sum("n").alias("all_n"),
        F.max_by("unit", F.struct("n", "unit")).alias("unit"),
        F.max("n").alias("top_n"),
        F.collect_list(F.struct("unit", "total", "n")).alias("units"),
    )
    clear = F.col("top_n") >= F.col("all_n") * unit_share
    used = F.filter("units", lambda u: (~clear) | (u["unit"] == F.col("unit")) | (u["unit"] == ""))
    g = g.select(*names, F.when(clear, F.col("unit")).otherwise("").alias("unit"), F.aggregate(used, F.lit(0).cast("decimal(38,6)"), lambda a, u: (a + u.total).cast("decimal(38,6)")).alias("total"), F.aggregate(used, F.lit(0).cast("long"), lambda a, u: a + u.n).alias("n"), "all_n")
    g = g.withColumn("off_unit", F.col("all_n") - F.col("n")).drop("all_n")
    everything = g.agg(F.sum("total").alias("grand"))
    return g.crossJoin(everything).select(*names, "unit", "total", "n", "off_unit", F.round(F.col("total").cast("double") / F.col("grand").cast("double") * 100, 1).alias("share"))
