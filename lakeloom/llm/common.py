"""Shared pieces of the training-data operators.

``WORD_SPACE`` is the set that separates words everywhere in this subpackage:
``bytes.split()`` splits on exactly these six ASCII characters, so words are
taken from UTF-8 bytes and never from ``str.split()`` (which knows more spaces).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: \x20 and \x09-\x0D.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (spark.checkpoint.dir).

    Only where the session names none and runs on one machine (as in tests) is a
    temporary folder set instead; on a cluster that would not be shared, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated-by-storage checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: compressed, and read by columns."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which small() lets a table be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, stored and counted: to be broadcast if it has at most so many rows, else to be joined as any other."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= most else df


def spare_name(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are used, under fixed names; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def byte_rows(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The strings of a column as UTF-8 bytes; null gives empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory of a Python worker to the system: idle workers are kept, and with them what their heap still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) for every vertex that isn't the least.

    Links a[i]-b[i] become at most one row per vertex, so what leaves a task is
    linear in its vertices however many links it saw.
    """
    if not len(a):
        return a, b
    vertices, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(vertices))
    while True:
        la, lb = label[left], label[right]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(vertices))
    return vertices[moved], vertices[label[moved]]


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: Column | str = "a", b: Column | str = "b") -> DataFrame:
    """(vertex, root): root is the least vertex that can be reached; only vertices with a link.

    Alternating large-star and small-star rounds over DataFrames. Each round
    joins links with one aggregated minimum per vertex (partial aggregation
    first, skewed hubs are split by AQE's skew join) and cuts its lineage with a
    checkpoint. Links never come to the driver; only a count and a hash do.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    before = _digest(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialise(small)
        now = _digest(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
