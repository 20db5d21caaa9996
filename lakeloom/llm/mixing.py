"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / weight with u from a hash of
its id, so reruns agree and better documents come first. Sorted by key within
its source, documents are summed up to the source's budget: complete epochs take
everything floor(target / size) times, the rest of the target is a fractional
epoch filled in key order; a document on the edge is taken when that brings the
source nearer to its target. The weight is a column of the caller's (a model's
score); without one it is read off the text (``text_quality``).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share all words; no target is above ``MAX_EPOCHS`` times its source's size, and
what that leaves over is shared again by weight until none is above. This is
water filling, so it is solved in one pass over sources sorted by size / weight.

Size: equal rows become one row with a count before anything is sorted. Running
sums never put a source into one task: keys are cut into ranges, n_docs /
``RANGE_ROWS`` of them to each doubling of the key. A doubling never holds more
than a quarter of a source's keys, whatever the weights are (an exponential variable
has at most .37 of its mass to a factor e, and so has any mixture of them), so a
range holds about ``RANGE_ROWS`` / 4 rows at most. Ranges are summed and offset, rows
are only sorted within a range. Since what is taken is a prefix of the order, a
source's mix is told by one row (the last key taken): texts meet that row and
are never shuffled.

Edge cases: null texts have size 0 and are taken zero words; a source without
words has target 0; null ids and repeated rows are rows like any other (ties in
the key go by id, then size, then content); of equal rows on the edge, as many
are taken as fit; null is a source of its own; columns may have any names; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise, small

CYCLE = 3
MAX_EPOCHS = 3
RANGE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Equal rows that one task gives out at once.
CHUNK = 10_000
SEED = "mix-1"


def text_quality(text: Column, size: Column) -> Column:
    """A quality weight in (0, 1] for texts without one: little markup, few capitals, enough words."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    plain = n - (F.length(t) - F.length(F.translate(t, SYMBOLS, "")))
    small = n - (F.length(t) - F.length(F.translate(t, CAPITALS, "")))
    return F.lit(0.05) + F.lit(0.95) * ((plain / n) * (small / n)) * (size / (size + F.lit(20)))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 48 bits of md5(seed:id)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size, m), each standing for m equal ones: one row per source."""
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row a source from here on; the windows hold sources, not documents.
    s = s.withColumn("w", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    by_ratio = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "prev_cap": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), "prev_w": F.coalesce(F.sum("w").over(by_ratio), F.lit(0))})
    s = s.withColumn("full", (F.col("total") - F.col("prev_cap")) * F.col("w") > F.col("cap") * (F.col("all_w") - F.col("prev_w")))
    s = s.withColumns({"left": F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything), "left_w": F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(everything)})
    share = F.col("left").cast("double") / F.greatest(F.col("left_w"), F.lit(1)).cast("double") * F.col("w")
    return s.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _measured(quality: Column | None, seed: str) -> list[Column]:
    """What decides about a row: id, source, size in words and key."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    weight = text_quality(text, size) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-9))
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        exponential_key(F.col("doc_id"), weight, seed).alias("key"),
    ]


def _order(*last: str) -> Column:
    """Where a row stands in its source; null ids come first."""
    return F.struct("key", F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size", *last)


def _decided(groups: DataFrame, range_rows: int, *last: str) -> DataFrame:
    """groups (doc_id, source, size, key, m and the columns named last) with source_size, target, epochs, at and more.

    at is the group's place in its source; more of its m rows are taken once more than epochs.
    """
    # Sources by a name that is never null: windows and joins then share one partitioning.
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    targets = small(source_targets(groups).select(name.alias("of"), "source_size", "target", F.greatest(F.ceil(F.col("n_docs") / range_rows), F.lit(1)).alias("ranges")))
    # A key may be 0 if u rounds to 1.
    octave = F.log2(F.greatest(F.col("key"), F.lit(1e-300)))
    placed = groups.withColumn("of", name).join(targets, "of").withColumn("range", F.floor(octave * F.col("ranges"))).drop("ranges")
    words = F.col("size") * F.col("m")
    before = W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("of", "range").agg(F.sum(words).alias("words"))
    sums = sums.select("of", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    placed = placed.withColumn("at", _order(*last))
    within = W.partitionBy("of", "range").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("run", F.coalesce(F.sum(words).over(within), F.lit(0))).join(sums, ["of", "range"])
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # The j-th of m equal rows is taken if 2 (words before + j size) - size <= 2 rest.
    room = 2 * (F.col("target") - F.col("epochs") * F.col("source_size")) - (2 * (F.col("start") + F.col("run"))).cast("double")
    fit = F.when(F.col("size") > 0, F.floor((room + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(room >= 0, F.col("m")).otherwise(0))
    more = F.when(F.col("epochs") >= MAX_EPOCHS, F.lit(0)).otherwise(F.greatest(F.least(fit, F.col("m")), F.lit(0)))
    return placed.withColumn("more", more.cast("long"))


def _repeat(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column times says, without that column; large numbers are dealt out over tasks first."""
    columns = [c for c in rows.columns if c != times]
    chunks = rows.where(F.col(times) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    left = F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col("chunk") * CHUNK)
    return chunks.hint("rebalance").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("n")).select(*columns)


def mix(docs: DataFrame, quality: Column | None = None, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs."""
    groups = materialise(docs.select(*_measured(quality, seed)).groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("m")))
    decided = _decided(groups, range_rows)
    parts = F.array(F.struct((F.col("epochs") + 1).alias("copies"), F.col("more").alias("n")), F.struct(F.col("epochs").alias("copies"), (F.col("m") - F.col("more")).alias("n")))
    rows = decided.select("doc_id", "size", "source_size", "target", F.inline(parts))
    return _repeat(rows, "n").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _content_hash(docs: DataFrame) -> Column:
    """A hash of a whole row; columns that hold maps, which have no hash of their own, count as JSON."""
    has_map = {f.name: "map<" in f.dataType.simpleString() for f in docs.schema.fields}
    return F.xxhash64(F.struct(*[F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if has_map[c] else F.col(f"`{c}`") for c in docs.columns]))


def mixed_documents(docs: DataFrame, quality: Column | None = None, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: each row as often as it is taken, all columns kept.

    What decides is the row, not its id: rows of one id have texts and copies of
    their own. Texts are written once and meet one row per source.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stored = materialise(docs.select(whole.alias("doc"), *_measured(quality, seed), _content_hash(docs).alias("hash")))
    keys = ["doc_id", "source", "size", "key", "hash"]
    groups = materialise(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")))
    decided = _decided(groups, range_rows, "hash")
    edge = F.when((F.col("more") > 0) & (F.col("more") < F.col("m")), F.struct("at", "more"))
    told = decided.groupBy("of").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("more") == F.col("m"), F.col("at"))).alias("last"), F.max(edge).alias("edge"))
    met = stored.withColumn("at", _order("hash")).withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(small(told), "of")
    copies = F.col("epochs") + F.when(F.col("last").isNotNull() & (F.col("at") <= F.col("last")), 1).otherwise(0)
    taken = met.select("doc", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))).alias("n")).select("doc.*")
    # Of the equal rows on a source's edge, one stands for all that are taken.
    extra = met.where("at = edge.at").groupBy("source").agg(F.first("doc").alias("doc"), F.first("edge.more").alias("more"))
    return taken.union(_repeat(extra.select("doc", "more"), "more").select("doc.*"))
