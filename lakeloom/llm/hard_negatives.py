"""Hard negatives for contrastive training, found with a pivot table.

Components become whole numbers, so a score is an exact inner product. Rows get
one coordinate more, the root of what their squared length lacks to the
greatest one, and anchors a zero there: the squared distance of anchor q and row x is then
M + |q|^2 - 2 <q, x>, and larger scores are smaller distances. Every row keeps its
distances to ``PIVOTS`` pivots. By the triangle inequality they bracket each score
from both sides; what the brackets can't rule out is checked exactly.

First pass: an anchor's positives, its highest rows of the same label. The k-th best
lower bracket of a block is a score that k of its rows reach, so rows whose upper
bracket is below it go unchecked. Second pass: for each positive the highest rows of
other labels inside its window of scores, with the same argument for each window; blocks whose
brackets miss every window are not visited at all.

Size: rows lie in blocks of at most ``BLOCK_ROWS``, those near one pivot together, and
anchors in blocks of at most ``ANCHOR_ROWS``; a task takes one block of each, and
returns its own first rows only. Rows that are equal but for their id become at most
as many rows as can be returned, those with the smallest ids: the others
come behind them in any order. Pivots are chosen farthest first from a bounded sample
(``SAMPLE_ROWS`` rows of each length); every row is indexed, and results are exact.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do rows whose squared length needs more than 62 bits (their scores are no
longs); vectors of different lengths have no score and never meet; repeated rows
(equal id, label and vector) count once, rows of one id that differ are rows of their own;
equal scores go by the smaller id; an anchor without positives, and a positive without rows
in its window, gives nothing; empty vectors score zero; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise

PIVOTS = 8
SAMPLE_ROWS = 1_024
BLOCK_ROWS = 16_384
ANCHOR_ROWS = 2_048
#: Blocks that small tables are cut into, so that every executor has work.
LEAST_BLOCKS = 32
#: Parts that the list of pairs of blocks is made in.
LANES = 64
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Hundredths of a positive's score that a negative's lies between.
LEAST, MOST = 30, 90


def _whole(scale: int):
    """vec as 32-bit whole numbers, null where the row takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            vec: list[bytes | None] = [None] * len(vectors)
            norm = [0] * len(vectors)
            for i, v in enumerate(vectors):
                if v is not None and None not in v:
                    with np.errstate(all="ignore"):
                        x = np.floor(scale * np.array(v, np.float64))
                        fits = np.isfinite(x).all() and float((x * x).sum()) < 2.0**62
                    if fits:
                        vec[i], norm[i] = x.astype("<i4").tobytes(), int((x.astype(np.int64) ** 2).sum())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(vec, pa.binary()), pa.array(norm, pa.int64())], ["vec_id", "label", "anchor", "vec", "norm"])

    return run


def _matrix(column: pa.ChunkedArray, kind: str = "<i4") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _lifted(x: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes their lengths equal."""
    return np.c_[x.astype(np.float64), np.sqrt(np.maximum(top - norm.astype(np.float64), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _choose(pivots: int):
    """Farthest first: each pivot is the row of the sample that is farthest from those before it."""

    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("at", "ascending"), ("vec", "ascending")])
        top = sample.column("top")[0].as_py()
        rows = _lifted(_matrix(sample.column("vec")), sample.column("norm").to_numpy(), top)
        chosen = [0]
        least = _distances(rows, rows[:1])[:, 0]
        while len(chosen) < min(pivots, len(rows)) and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, _distances(rows, rows[chosen[-1] :][:1])[:, 0])
        return pa.table({"width": sample.column("width")[:1], "top": sample.column("top")[:1], "pivots": pa.array([rows[chosen].tobytes()], pa.binary())})

    return run


def _place(rows: pa.Table, told: pa.Table) -> pa.Table:
    """Rows of a provisional block with their distances to the pivots: as rows, and as anchors."""
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32())] + [pa.array([], pa.list_(pa.float64()))] * 2, ["rid", "top", "near", "dist", "ask"])
    x, norm = _matrix(rows.column("vec")), rows.column("norm").to_numpy()
    top = told.column("top")[0].as_py()
    pivots = np.frombuffer(told.column("pivots")[0].as_py()).reshape(-1, x.shape[1] + 1)
    dist = _distances(_lifted(x, norm, top), pivots)
    ask = _distances(np.c_[x.astype(np.float64), np.zeros(len(x))], pivots)
    return pa.table([rows.column("rid"), pa.array([top] * len(x), pa.int64()), pa.array(dist.argmin(1).astype(np.int32)), pa.array(dist.tolist(), pa.list_(pa.float64())), pa.array(ask.tolist(), pa.list_(pa.float64()))], ["rid", "top", "near", "dist", "ask"])


class _Block:
    """Rows of a block, their stored distances, and the brackets of their scores with an anchor."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids, self.rid, self.label, self.norm = (rows.column(c).to_numpy() for c in ("vec_id", "rid", "label", "norm"))
        self.vec = _matrix(rows.column("vec"))
        self.dist = np.array(rows.column("dist").to_pylist(), np.float64).T.copy()
        self.floats = self.vec.astype(np.float64)

    def brackets(self, ask: np.ndarray, norm: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        near, far = np.zeros(len(self.ids)), np.full(len(self.ids), np.inf)
        for d, a in zip(self.dist, ask, strict=True):
            np.maximum(near, np.abs(d - a), out=near)
            np.minimum(far, d + a, out=far)
        # Distances carry rounding errors; the slack is far above them.
        slack = 1 + 4e-6 * (top + norm)
        return (top + norm - far * far) / 2 - slack, (top + norm - near * near) / 2 + slack

    def scores(self, at: np.ndarray, q: np.ndarray, norm: int, top: int) -> np.ndarray:
        if top * norm < 1 << 104:  # then every sum is below 2^52
            return (self.floats[at] @ q.astype(np.float64)).astype(np.int64)
        return self.vec[at].astype(np.int64) @ q.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _anchors(table: pa.Table) -> Iterator[tuple]:
    columns = [table.column(c).to_pylist() for c in ("rid", "label", "norm", "top", "ask")]
    return zip(*columns, _matrix(table.column("vec")), strict=True)


def _positives(k: int):
    """(rid of the anchor, id, score) of a block's first k rows of each anchor's label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if anchors.num_rows and rows.num_rows:
            block = _Block(rows)
            order = np.argsort(block.label, kind="stable")
            for rid, label, norm, top, ask, q in _anchors(anchors):
                own = order[np.searchsorted(block.label, label, "left", order) : np.searchsorted(block.label, label, "right", order)]
                own = own[block.rid[own] != rid]
                if not len(own):
                    continue
                low, high = block.brackets(np.array(ask), norm, top)
                own = own[high[own] >= _kth(low[own], k)]
                score = block.scores(own, q, norm, top)
                best = _first(score, block.ids[own], k)
                out.append((np.full(len(best), rid), block.ids[own][best], score[best]))
        return _columns(out, ["rid", "id", "score"])

    return run


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(c) if parts else [], pa.int64()) for c in (zip(*parts, strict=True) if parts else [[]] * len(names))], names)


def _negatives(k: int):
    """(rid of the anchor, number of the positive, id, score) of a block's first k rows of other labels in each window."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if anchors.num_rows and rows.num_rows:
            block = _Block(rows)
            windows = anchors.column("windows").to_pylist()
            for (rid, label, norm, top, ask, q), asked in zip(_anchors(anchors), windows, strict=True):
                low, high = block.brackets(np.array(ask), norm, top)
                other = block.label != label
                wanted = np.zeros(len(other), bool)
                for w in asked:
                    fits = other & (high >= w["least"]) & (low <= w["most"])
                    sure = fits & (low >= w["least"]) & (high <= w["most"])
                    wanted |= fits & (high >= _kth(low[sure], k))
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                score = block.scores(at, q, norm, top)
                for w in asked:
                    here = np.flatnonzero((score >= w["least"]) & (score <= w["most"]))
                    best = here[_first(score[here], block.ids[at[here]], k)]
                    out.append((np.full(len(best), rid), np.full(len(best), w["no"]), block.ids[at[best]], score[best]))
        return _columns(out, ["rid", "no", "id", "score"])

    return run


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows with the block they lie in: those near a pivot together as far as blocks get full, at most about so many rows in each."""
    counts = rows.groupBy("width", "near").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("parts", F.ceil(F.col("n") / most)).withColumn("before", F.sum("n").over(W.partitionBy("width").orderBy("near")) - F.col("n"))
    # Pivots with few rows share a block, counted through in order.
    counts = counts.select("width", "near", "parts", F.when(F.col("parts") > 1, F.col("near") + 1).otherwise(-1 - F.floor(F.col("before") / most)).alias("group"))
    placed = rows.join(counts, ["width", "near"])
    return placed.withColumn(name, F.struct("width", "group", F.pmod(F.xxhash64("vec", "vec_id"), F.col("parts")).alias("part"))).drop("parts", "group")


def _directory(rows: DataFrame, distances: str, block: str, pivots: int, *more: Column) -> DataFrame:
    """Least and greatest distance to each pivot of every block."""
    each = [f(F.try_element_at(distances, F.lit(j + 1))) for j in range(pivots) for f in (F.min, F.max)]
    return rows.groupBy("width", block).agg(F.array(*each[::2]).alias("lo"), F.array(*each[1::2]).alias("hi"), *more)


def _paired(asking: DataFrame, asked: DataFrame) -> DataFrame:
    """All pairs of blocks of one width, made in LANES parts."""
    lane = F.pmod(F.xxhash64("b"), F.lit(LANES))
    return asking.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).join(asked.withColumn("lane", lane.cast("int")), ["width", "lane"])


def _met(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, function, ddl: str) -> DataFrame:
    left = pairs.select("a", "b").join(anchors, "a")
    # Under names of their own: both sides come from one list of pairs.
    right = pairs.select(F.col("a").alias("of_a"), F.col("b").alias("of_b")).join(rows.withColumnRenamed("b", "of_b"), "of_b")
    return left.groupBy("a", "b").cogroup(right.groupBy("of_a", "of_b")).applyInArrow(function, ddl)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label); is_anchor says who asks."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor.cast("boolean"), F.lit(False)).alias("anchor"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL")
    whole = own.mapInArrow(_whole(scale), "vec_id long, label long, anchor boolean, vec binary, norm long").where("vec IS NOT NULL")
    once = whole.groupBy("vec_id", "label", "vec").agg(F.max("anchor").alias("anchor"), F.first("norm").alias("norm"))
    rows = materialise(once.select(F.monotonically_increasing_id().alias("rid"), "*", F.octet_length("vec").alias("width")))

    tops = rows.groupBy("width").agg(F.max("norm").alias("top"))
    sample = rows.select("width", "vec", "norm", F.xxhash64("vec").alias("at"))
    sample = sample.withColumn("n", F.row_number().over(W.partitionBy("width").orderBy("at", "vec"))).where(F.col("n") <= SAMPLE_ROWS).drop("n")
    chosen = materialise(sample.join(tops, "width").groupBy("width").applyInArrow(_choose(pivots), "width int, top long, pivots binary"))
    total = rows.count()
    block_rows = min(block_rows, -(-total // LEAST_BLOCKS) or 1)
    parts = -(-total // block_rows) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec", "vec_id"), F.lit(parts)))
    told = chosen.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    placed = dealt.groupBy("width", "part").cogroup(told.groupBy("width", "part")).applyInArrow(_place, "rid long, top long, near int, dist array<double>, ask array<double>")
    index = materialise(rows.join(placed, "rid"))

    # Of rows that differ in their id alone no more can be returned than these (an anchor isn't its own positive).
    leading = F.row_number().over(W.partitionBy("label", "vec").orderBy("vec_id"))
    kept = index.withColumn("n", leading).where(F.col("n") <= max(positives + 1, negatives)).drop("n", "anchor", "ask", "top")
    kept = materialise(_blocks(kept, block_rows, "b"))
    asking = materialise(_blocks(index.where("anchor").drop("anchor", "dist"), anchor_rows, "a"))

    ends = _directory(kept, "dist", "b", pivots).select("width", "b", F.col("lo").alias("row_lo"), F.col("hi").alias("row_hi"))
    seen = kept.select("b", "vec_id", "rid", "label", "norm", "vec", "dist")
    asks = asking.select("a", "rid", "label", "norm", "top", "vec", "ask")
    pairs = _paired(asking.select("width", "a").distinct(), ends.select("width", "b"))
    found = _met(pairs, asks, seen, _positives(positives), "rid long, id long, score long")
    place = F.row_number().over(W.partitionBy("rid").orderBy(F.col("score").desc(), "id"))
    first = materialise(found.withColumn("no", place.cast("long")).where(F.col("no") <= positives))

    # Bounds are whole: score >= ceil(least * positive / 100), score <= floor(most * positive / 100).
    big = F.col("score").cast("decimal(25,0)")
    low = -F.floor(-big * least / 100)
    window = F.struct("no", low.cast("long").alias("least"), F.floor(big * most / 100).cast("long").alias("most"))
    windows = first.select("rid", window.alias("w")).where("w.least <= w.most").groupBy("rid").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    searching = materialise(asking.join(windows, "rid"))
    asked = _directory(searching, "ask", "a", pivots, F.min("norm").alias("norm_lo"), F.max("norm").alias("norm_hi"), F.max("top").alias("top"), F.min(F.array_min("windows.least")).alias("least"), F.max(F.array_max("windows.most")).alias("most"))
    near = F.greatest(F.lit(0.0), *[F.greatest(F.try_element_at("row_lo", F.lit(j + 1)) - F.try_element_at("hi", F.lit(j + 1)), F.try_element_at("lo", F.lit(j + 1)) - F.try_element_at("row_hi", F.lit(j + 1))) for j in range(pivots)])
    far = F.least(*[F.try_element_at("row_hi", F.lit(j + 1)) + F.try_element_at("hi", F.lit(j + 1)) for j in range(pivots)], F.lit(float("inf")))
    slack = 1 + 4e-6 * (F.col("top") + F.col("norm_hi"))
    reach = ((F.col("top") + F.col("norm_hi") - near * near) / 2 + slack >= F.col("least")) & ((F.col("top") + F.col("norm_lo") - far * far) / 2 - slack <= F.col("most"))
    pairs = _paired(asked, ends).where(reach)
    hits = _met(pairs, searching.select("a", "rid", "label", "norm", "top", "vec", "ask", "windows"), seen, _negatives(negatives), "rid long, no long, id long, score long")
    rank = F.row_number().over(W.partitionBy("rid", "no").orderBy(F.col("score").desc(), "id"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives).select("rid", "no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.join(asking.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select("rid", "no", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hits.join(named, ["rid", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
