"""Shards with the mixture of the whole: proportional stratified interleaving.

Rows of a source are put into a seeded random order. The r-th of n rows (from 0)
gets the fractional rank (r + u) / n, where u in [0, 1) is drawn from the
source's name, so that small sources don't all stand at the same place. Sorted
by fractional rank, every stretch of the order holds each source in proportion; it
is cut into shards of the same number of rows (counts differ by one at most), and
a shard's slots number its rows in that order.

No source, bucket or group of equal rows is ever one task's: a source's order
is by hash, so it is cut into ranges of the hash that hold about ``RANGE_ROWS``
rows; rows with one hash (repeated rows) are counted per partition of the stored table and
numbered there. Ranges are summed up in two levels. Only hashes and row
numbers move until a row's place is known; texts are stored once and move once.

Edge cases: the source null stands apart from the empty one; null ids and null texts are values like
any other; repeated rows are rows of their own, interchangeable in the order; fewer rows than
shards leave shards empty; an empty table gives no rows; further columns are
carried along, and where one is called like an added column that gets an
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise, spare_name, stored_table

SHARDS = 24
RANGE_ROWS = 20_000
#: Ranges that are summed up within one another.
FANOUT = 1_024
SEED = "shard-1"


def _draw(*parts: Column) -> Column:
    """A number from 0 to 2^48 - 1 from the first bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def starts(counts: DataFrame, by: list[str], at: str, n: str) -> DataFrame:
    """counts (by, at, n: one row each) with start, the sum of n over all lower at of the same by."""
    c = counts.withColumn("hi", F.floor(F.col(at) / FANOUT))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    upper = c.groupBy(*by, "hi").agg(F.sum(n).alias("many"))
    upper = upper.select(*by, "hi", F.coalesce(F.sum("many").over(before(by, "hi")), F.lit(0)).alias("above"))
    c = c.withColumn("within", F.coalesce(F.sum(n).over(before([*by, "hi"], at)), F.lit(0)))
    return c.join(upper, [*by, "hi"]).withColumn("start", F.col("above") + F.col("within")).drop("hi", "above", "within")


def _ranked(rows: DataFrame, range_rows: int) -> DataFrame:
    """rows (rid, of, h) with n, the rows of their source, and r, their place in its order of h."""
    part = F.shiftright("rid", 33)
    sizes = rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    cells = rows.groupBy("of", "h", part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    groups = cells.groupBy("of", "h").agg(F.sum("m").alias("m")).join(sizes, "of")
    # h is even over 2^48, so are the rows over ranges of it.
    groups = materialise(groups.withColumn("range", F.floor(F.col("h") / F.lit(float(1 << 48)) * F.ceil(F.col("n") / range_rows))))
    ranges = starts(groups.groupBy("of", "range").agg(F.sum("m").alias("many")), ["of"], "range", "many").drop("many")
    lower = W.partitionBy("of", "range").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("m").over(lower), F.lit(0))).join(ranges, ["of", "range"]).select("of", "h", "n", (F.col("start") + F.col("before")).alias("start"))
    earlier = W.partitionBy("of", "h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    own = W.partitionBy("of", "h", "part").orderBy("rid")
    placed = rows.withColumn("part", part).withColumn("no", F.row_number().over(own) - 1)
    placed = placed.join(cells, ["of", "h", "part"]).join(groups, ["of", "h"])
    return placed.select("rid", "of", "n", (F.col("start") + F.col("earlier") + F.col("no")).alias("r"))


def placement(rows: DataFrame, shards: int = SHARDS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(rid, shard, slot) of rows (rid, source, h): rid as monotonically_increasing_id gave it to a stored table, h from 0 to 2^48 - 1."""
    # A source by a name that is never null.
    of = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    ranked = _ranked(rows.select("rid", of.alias("of"), "h"), range_rows)
    phase = _draw(F.lit(seed), F.lit("source"), F.col("of")) / F.lit(float(1 << 48))
    ranked = materialise(ranked.select("rid", "of", ((F.col("r") + phase) / F.col("n")).alias("frac")))
    total = ranked.count()
    ranked = ranked.withColumn("range", F.floor(F.col("frac") * F.lit(-(-total // range_rows))))
    ranges = starts(ranked.groupBy("range").agg(F.count(F.lit(1)).alias("many")).withColumn("all", F.lit(0)), ["all"], "range", "many").select("range", "start")
    at = F.row_number().over(W.partitionBy("range").orderBy("frac", "of", "rid")) - 1
    placed = ranked.withColumn("at", at).join(ranges, "range").select("rid", (F.col("start") + F.col("at")).cast("decimal(30,0)").alias("at"))
    # Each shard has total / shards rows, rounded down or up.
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div {max(total, 1)}"))
    first = F.expr(f"(cast(shard as decimal(30,0)) * {total} + {shards - 1}) div {shards}")
    return placed.select("rid", F.col("shard").cast("int").alias("shard"), (F.col("at").cast("long") - first).alias("slot"))


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of docs (doc_id, text, source and more) with shard (from 0) and slot (gapless from 0 in its shard)."""
    h = _draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stored = stored_table(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("rid"), F.col("source").cast("string").alias("source"), h.alias("h")))
    placed = placement(stored.select("rid", "source", "h"), shards, seed, range_rows)
    shard = spare_name(docs, "shard")
    slot = spare_name(docs, "slot")
    return stored.select("rid", "doc").join(placed, "rid").select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot", files: int = SHARDS) -> None:
    """One folder a shard, its rows in order of their slots, in about so many files over all shards."""
    rows.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``rows``."""
    rows = interleaved(docs.select("doc_id", "text", "source"), shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
