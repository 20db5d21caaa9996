"""Ordered operators: ranking, first-seen, versions, neighbours, packing, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakeloom.operators.lineage import cut


def top_k(rows: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts groups to k before the shuffle (window group limit)."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def first_seen(rows: DataFrame, body: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each body, in the given order."""
    return top_k(rows, body, order, 1).drop("rank")


def duplicate_of(files: DataFrame, name: str = "name", size: str = "size", digest: str = "digest", order: str = "rel") -> DataFrame:
    """files with dup_of: the first file of equal (name, size, digest); without a digest, the head of its (name, size); null for representatives."""
    same = W.partitionBy(name, size).orderBy(order)
    exact = W.partitionBy(name, size, digest).orderBy(order)
    head = F.when(F.col(digest).isNull(), F.first(order).over(same)).otherwise(F.first(order).over(exact))
    return files.withColumn("dup_of", F.when(head != F.col(order), head))


def neighbours(chunks: DataFrame, doc: str = "doc_id", seq: str = "seq", text: str = "text", short: int = 400, ahead: int = 6, enough: int = 1200) -> DataFrame:
    """A short chunk grows by the following ones until it has ``enough`` characters, cut there; long ones stay."""
    w = W.partitionBy(doc).orderBy(seq).rowsBetween(0, ahead)
    pieces = F.collect_list(F.coalesce(text, F.lit(""))).over(w)
    grown = F.aggregate("_pieces", F.lit(""), lambda a, x: F.when(F.length(a) >= enough, a).when(a == "", x).otherwise(F.concat(a, F.lit("\n"), x)))
    out = chunks.withColumn("_pieces", pieces).withColumn("expanded", F.when(F.length(text) >= short, F.col(text)).otherwise(F.substring(grown, 1, enough)))
    return out.drop("_pieces")


def breadcrumbs(chunks: DataFrame, level: str = "level", title: str = "title", doc: str = "doc_id", order: Sequence[str] = ("page", "seq"), deepest: int = 6) -> DataFrame:
    """chunks with path: titles of the headings above each chunk, itself included if it is one.

    A heading at level l closes all open headings at l and below: the one that
    counts at l is the last of level l after the last one of a lower level.
    """
    w = W.partitionBy(doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    out = chunks.withColumn("_n", place)
    for k in range(1, deepest + 1):
        at = F.when(F.col(level) == k, F.struct(F.col("_n").alias("n"), F.col(title).alias("t")))
        out = out.withColumn(f"_h{k}", F.max(at).over(w))
    cut = F.lit(0)
    titles = []
    for k in range(1, deepest + 1):
        live = F.col(f"_h{k}.n") > cut
        titles.append(F.when(live, F.col(f"_h{k}.t")))
        cut = F.greatest(cut, F.coalesce(f"_h{k}.n", F.lit(0)))
    return out.withColumn("path", F.array_compact(F.array(*titles))).drop("_n", *[f"_h{k}" for k in range(1, deepest + 1)])


def toc_runs(chunks: DataFrame, heading: Column, doc: str = "doc_id", page: str = "page", seq: str = "seq", least: int = 5) -> DataFrame:
    """chunks with toc: whether the chunk stands in a run of at least ``least`` headings of one page without a body between."""
    order = W.partitionBy(doc).orderBy(page, seq)
    c = chunks.withColumn("_h", F.coalesce(heading, F.lit(False))).withColumn("_i", F.row_number().over(order))
    c = c.withColumn("_j", F.when(F.col("_h"), F.row_number().over(W.partitionBy(doc, "_h", page).orderBy("_i"))))
    run = W.partitionBy(doc, page, "_h", F.col("_i") - F.col("_j"))
    return c.withColumn("toc", F.col("_h") & (F.count(F.lit(1)).over(run) >= least)).drop("_h", "_i", "_j")


#: Fixed value: the share of the shorter version's grams that a version and the one it follows have in common.
FOLLOWS_FROM = 0.3


def current_versions(rows: DataFrame, family: str = "family", version: str = "version", latest: str = "latest", trusted: str = "trusted", dates: str = "dates", grams: str = "grams") -> DataFrame:
    """(family, version, status): current, old or unsure, for the versions (latest: when last revised, dates: all revisions, grams: hashes of the text) of each family.

    From the latest version down, the first one that is trusted, or has nothing before it, or follows its anchor is current: the anchor is the nearest trusted version
    before it, else the nearest one, and a version follows it that is later, keeps all its revisions and shares enough of its
    text. Versions above the current one are unsure, those below are old. Only an anchor's row meets a version: no family is held by a task.
    """
    down = W.partitionBy(family).orderBy(F.col(latest).desc_nulls_last(), F.desc(version))
    below = down.rowsBetween(1, W.unboundedFollowing)
    known = F.coalesce(F.col(trusted), F.lit(False))
    near = F.first(F.when(known, F.col(version)), ignorenulls=True).over(below)
    v = rows.select(family, version, latest, known.alias("_ok"), F.coalesce(near, F.lead(version).over(down)).alias("_anchor"), F.row_number().over(down).alias("_at"))
    own = rows.select(family, version, F.coalesce(dates, F.array()).alias("_d"), F.coalesce(grams, F.array()).alias("_g"))
    anchor = rows.select(family, F.col(version).alias("_anchor"), F.col(latest).alias("_was"), F.coalesce(dates, F.array()).alias("_ad"), F.coalesce(grams, F.array()).alias("_ag"))
    asked = v.where(~F.col("_ok") & F.col("_anchor").isNotNull()).join(own, [family, version]).join(anchor, [family, "_anchor"])
    shared = F.size(F.array_intersect("_g", "_ag")) / F.greatest(F.least(F.size(F.array_distinct("_g")), F.size(F.array_distinct("_ag"))), F.lit(1))
    follows = F.coalesce(F.col(latest) > F.col("_was"), F.col(latest).isNotNull()) & (F.size(F.array_except("_ad", "_d")) == 0) & (shared >= FOLLOWS_FROM)
    sound = asked.where(follows).select(family, version, F.lit(True).alias("_follows"))
    v = v.join(sound, [family, version], "left").withColumn("_good", F.col("_ok") | F.col("_anchor").isNull() | F.coalesce("_follows", F.lit(False)))
    first = F.min(F.when(F.col("_good"), F.col("_at"))).over(W.partitionBy(family))
    return v.select(family, version, F.when(F.col("_at") == first, "current").when(F.col("_at") < first, "unsure").otherwise("old").alias("status"))


def number_rows(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with name, their place from 1 in an order over all of them: sorted ranges, and for each range how many rows lie before it. No task holds more than its range."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))  # one row a range
    before = counts.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.withColumn("_p", part).join(before, "_p").withColumn(name, F.col("_b") + F.col("_m") - F.shiftleft("_p", 33) + 1).drop("_p", "_m", "_b")


def round_robin(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """rows with turn: the first row of every key, then the second of every key, and so on."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return number_rows(rows.withColumn("round", rn), [F.col("round"), F.col(key)], "turn")


def fuse(a: DataFrame, b: DataFrame, by: Sequence[str], item: str, k: int = 60, w_a: float = 1.0, w_b: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings (by..., item, rank from 1): sum of w / (k + rank)."""
    keys = [*by, item]
    both = a.select(*keys, (F.lit(w_a) / (k + F.col("rank"))).alias("s")).unionByName(b.select(*keys, (F.lit(w_b) / (k + F.col("rank"))).alias("s")))
    fused = both.groupBy(*keys).agg(F.sum("s").alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), item)))


#: Rows that a fold turns into Python at a time, and results that it gives out at a time.
FOLDED_ROWS = 2_000


def grouped_fold(rows: DataFrame, key: str, order: Sequence[str], schema: T.StructType | str, fold: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """An ordered fold per key, for rules that a frame can't say: fold gets a key's rows in order (nulls last) and returns result rows.

    Keys are dealt out and sorted by Spark, and a task folds one after the other as they come by: a key costs what its rows cost.
    """
    parsed = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    out = to_arrow_schema(parsed)

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, FOLDED_ROWS):
                for row in batch.slice(at, FOLDED_ROWS).to_pylist():
                    if held and row[key] != held[0][key]:
                        found += fold(held)
                        held = []
                        if len(found) >= FOLDED_ROWS:
                            yield made(found)
                            found = []
                    held.append(row)
        found += fold(held) if held else []
        if found:
            yield made(found)

    return rows.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order if c != key]).mapInArrow(run, parsed)


def pack_windows(rows: DataFrame, key: str, order: Sequence[str], size: str, limit: int = 9000) -> DataFrame:
    """(key, order..., window): greedy packing in order; a chunk that doesn't fit opens the next window, oversize chunks are dropped."""
    names = [key, *order]
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(n, types[n]) for n in names] + [T.StructField("window", T.IntegerType())])

    def fold(items: list[dict]) -> list[tuple]:
        out, window, used = [], 0, 0
        for r in items:
            n = int(r[size])
            if n > limit:
                continue
            if used and used + n > limit:
                window, used = window + 1, 0
            used += n
            out.append((*(r[c] for c in names), window))
        return out

    return grouped_fold(rows.select(*names, size), key, order, schema, fold)


def evidence_before(turns: DataFrame, conv: str, turn: str, evidence: Column) -> DataFrame:
    """turns with seen: how much evidence stands in strictly earlier turns."""
    w = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("seen", F.coalesce(F.sum(evidence.cast("long")).over(w), F.lit(0)))
