"""Cutting the lineage of iterative operators, and folders for what must be written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
HAND_OUT = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine (as in tests) a temporary one serves where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lakeloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lakeloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table: compressed and read by columns, for wide rows."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(parts: list[DataFrame]) -> DataFrame:
    """As stored() of their union, but written one after the other: a plan of them all is planned anew whenever one of its shuffles ends, and keeps the files of every one."""
    path = scratch(parts[0].sparkSession, "table")
    for df in parts:
        df.select(parts[0].columns).write.mode("append").option("compression", "zstd").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def handed(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, stored and counted: handed to every task if it has few rows, so that what it meets isn't shuffled; else to be joined as any other."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= (HAND_OUT if most is None else most) else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out over as many tasks as a shuffle has: for small rows that cost much each, as a small file is one task however many rows it holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
