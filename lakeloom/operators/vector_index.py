"""An index of unit vectors as files: inverted lists around centroids, searched in waves.

Centroids (about the root of the number of rows) are fitted on a bounded sample; every row is filed in the
list of its nearest one, lists in cells of at most ``CELL_ROWS`` rows, sorted by list. A search ranks the lists
for each query and visits them in waves: the first wave takes as many as the index
has found necessary for ``RECALL`` on a sample of its own rows, and queries that a filter has left
with fewer than k rows go on, each wave twice as wide, until they have k or no list is left. Filters hold
during the search, so they never cost results; within a cell, scores are one matrix product.

Edge cases: rows and queries with a null vector, a null component or another
length than the index's don't meet anything; ties go by the smaller id; an empty index answers
nothing; k rows or fewer come back whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut

#: Rows that centroids are fitted on, and rows that the first wave's width is measured with.
SAMPLE_ROWS, PROBE_ROWS = 16_384, 128
#: Bytes that the centroids may take, since each task holds them all.
CENTROID_BYTES = 32 << 20
CELL_ROWS = 16_384
RECALL = 0.95
#: Lists that a scan asks for by name (and so reads only their row groups).
NAMED_LISTS = 256


def _fit(lists: int, rounds: int = 8):
    """k-means on the sample by the greatest inner product, started from evenly spaced rows."""

    def run(sample: pa.Table) -> pa.Table:
        x = np.array(sample.sort_by("_h").column("_v").to_pylist(), np.float32)
        c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        return pa.table({"list": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float32()))})

    return run


def _ranking(centroids: np.ndarray, every: bool):
    """Adds the lists to each vector, nearest first; the nearest only unless ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("_v").to_pylist(), np.float32).reshape(batch.num_rows, -1)
            near = x @ centroids.T
            lists = np.argsort(-near, axis=1, kind="stable").tolist() if every else near.argmax(1)[:, None].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "_lists"])

    return run


def _scores(k: int, query_id: str, vector_id: str):
    """The k best rows of a cell for each query that visits it."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[list, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by(vector_id)
            x = np.array(rows.column("_v").to_pylist(), np.float64)
            qid = queries.column(query_id).to_pylist()
            scores = np.array(queries.column("_v").to_pylist(), np.float64) @ x.T
            ids = rows.column(vector_id)
            for q, s in zip(qid, scores, strict=True):
                best = np.argsort(-s, kind="stable")[:k]
                out.append(([q] * len(best), best, s[best]))
        ids = rows.column(vector_id).take(pa.array(np.concatenate([b for _, b, _ in out]))) if out else pa.array([], rows.schema.field(vector_id).type)
        return pa.table([pa.array([q for qs, _, _ in out for q in qs], queries.schema.field(query_id).type), ids, pa.array(np.concatenate([s for _, _, s in out]) if out else [], pa.float64())], [query_id, vector_id, "score"])

    return run


class VectorIndex:
    """Files below a folder: lists (rows by list and cell), cells (list, cells), and how it was built."""

    def __init__(self, spark: SparkSession, path: str, vector_id: str = "vec_id", vector: str = "embedding") -> None:
        self.spark, self.path, self.vector_id, self.vector = spark, path.rstrip("/"), vector_id, vector

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def _usable(self, df: DataFrame, width: int | None) -> DataFrame:
        v = F.col(self.vector).cast("array<float>")
        whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        return df.where(whole if width is None else whole & (F.size(v) == width)).withColumn("_v", v)

    def build(self, vectors: DataFrame, keep: list[str] | None = None, lists: int | None = None) -> VectorIndex:
        """Index every row; keep names the columns that searches may filter by."""
        rows = self._usable(vectors.select(self.vector_id, self.vector, *(keep or [])), None)
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("width")).first()
        n, width = first.n, first.width or 1
        rows = self._usable(rows.drop("_v"), width)
        wanted = min(lists or max(1, round(n**0.5)), CENTROID_BYTES // (4 * width))
        sample = rows.select("_v", F.xxhash64("_v").alias("_h")).orderBy("_h").limit(SAMPLE_ROWS)
        fitted = sample.groupBy(F.lit(0).alias("_all")).applyInArrow(_fit(wanted), "list int, centroid array<float>")
        # At most CENTROID_BYTES, whatever the number of rows is.
        centroids = np.array([r.centroid for r in fitted.orderBy("list").collect()], np.float32).reshape(-1, width)
        schema = rows.schema.simpleString()[len("struct<") : -1]
        filed = rows.mapInArrow(_ranking(centroids, False), f"{schema},_lists:array<int>") if len(centroids) else rows.withColumn("_lists", F.array(F.lit(0)))
        filed = cut(filed.withColumn("list", F.col("_lists")[0]).drop("_lists", self.vector))
        cells = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells"))
        cells.write.mode("overwrite").parquet(f"{self.path}/cells")
        placed = filed.join(self._read("cells"), "list").withColumn("cell", F.pmod(F.xxhash64(self.vector_id), F.col("cells")).cast("int")).drop("cells")
        placed.repartitionByRange("list", "cell").sortWithinPartitions("list", "cell").write.mode("overwrite").parquet(f"{self.path}/lists")
        self.spark.createDataFrame([(json.dumps({"width": width, "rows": n}), centroids.tobytes())], "about string, centroids binary").write.mode("overwrite").parquet(f"{self.path}/about")
        probes = self._measured(centroids, n)
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")
        return self

    def _about(self) -> tuple[dict, np.ndarray]:
        r = self._read("about").first()
        about = json.loads(r.about)
        return about, np.frombuffer(r.centroids, np.float32).reshape(-1, about["width"])

    def _measured(self, centroids: np.ndarray, n: int, k: int = 10) -> int:
        """How many lists hold RECALL of the true first rows of a sample of PROBE_ROWS rows, against all rows."""
        if n == 0:
            return 1
        sample = self._read("lists").select(F.col(self.vector_id).alias("_q"), "_v").orderBy(F.xxhash64("_q", F.lit(1))).limit(PROBE_ROWS)
        ranked = cut(sample.mapInArrow(_ranking(centroids, True), f"_q {dict(sample.dtypes)['_q']}, _v array<float>, _lists array<int>"))
        true = self._wave(ranked.select("_q", "_v", F.explode("_lists").alias("list")), self._read("lists"), k, "_q")
        true = true.withColumn("_r", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), self.vector_id))).where(F.col("_r") <= k)
        at = true.join(self._read("lists").select(self.vector_id, "list"), self.vector_id).join(ranked.select("_q", "_lists"), "_q")
        return int(at.agg(F.percentile(F.array_position("_lists", F.col("list")), F.lit(RECALL)).alias("p")).first().p or 1) + 1

    def _wave(self, visits: DataFrame, rows: DataFrame, k: int, query_id: str) -> DataFrame:
        """The k best rows of every cell visited; visits (query_id, _v, list)."""
        v = visits.join(self._read("cells"), "list").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
        ids = dict(rows.dtypes)[self.vector_id]
        r = rows.select(F.col("list").alias("_list"), F.col("cell").alias("_cell"), self.vector_id, "_v")
        score = _scores(k, query_id, self.vector_id)
        return v.groupBy("list", "cell").cogroup(r.groupBy("_list", "_cell")).applyInArrow(score, f"{query_id} {dict(visits.dtypes)[query_id]}, {self.vector_id} {ids}, score double")

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, query_id: str = "qid", vector: str | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, vector_id, score, rank, lists): the k nearest rows that where lets through; lists says how many the query has visited."""
        about, centroids = self._about()
        asked = queries.select(query_id, F.col(vector or self.vector).alias(self.vector))
        asked = self._usable(asked, about["width"]).select(query_id, "_v")
        kind = dict(asked.dtypes)[query_id]
        ranked = asked.mapInArrow(_ranking(centroids, True), f"{query_id} {kind}, _v array<float>, _lists array<int>") if len(centroids) else asked.withColumn("_lists", F.array().cast("array<int>"))
        open_ = cut(ranked)
        ids = dict(self._read("lists").dtypes)[self.vector_id]
        best = self.spark.createDataFrame([], f"{query_id} {kind}, {self.vector_id} {ids}, score double, rank int, lists int")
        at, width = 0, probes or self._read("probes").first().probes
        while at < len(centroids) and not open_.isEmpty():
            visits = open_.select(query_id, "_v", F.explode(F.slice("_lists", at + 1, width)).alias("list"))
            rows = self._read("lists") if where is None else self._read("lists").where(where)
            named = visits.select("list").distinct().limit(NAMED_LISTS + 1).collect()
            if len(named) <= NAMED_LISTS:
                rows = rows.where(F.col("list").isin([r.list for r in named]))
            found = self._wave(visits, rows, k, query_id).select(query_id, self.vector_id, "score", F.lit(0).alias("rank"), F.lit(0).alias("lists"))
            both = best.union(found).withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), self.vector_id))).where(F.col("rank") <= k)
            at += width
            seen = open_.select(query_id, F.lit(min(at, len(centroids))).alias("_at"))
            best = cut(both.join(seen, query_id, "left").withColumn("lists", F.coalesce("_at", "lists")).drop("_at"))
            full = best.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
            open_, width = cut(open_.join(full.select(query_id), query_id, "left_anti")), 2 * width
        return best
