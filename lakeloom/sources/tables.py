"""Table sources: Parquet, JSON lines, CSV with an encoding cascade, listings, versioned vectors."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table with its filter and columns pushed into the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, time: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """JSON lines (gzip too); malformed lines are dropped; start <= time < end as ISO text."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if time and start:
        df = df.where(F.col(time) >= start)
    if time and end:
        df = df.where(F.col(time) < end)
    return df


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON array or object per file (gzip too): a snapshot."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decode(data: bytes, hint: str | None = None) -> str:
    """By the hint, as UTF-8, as cp949, or with replacement characters."""
    for name in (hint, "utf-8-sig", "cp949"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def csv_text(content: pd.Series) -> pd.Series:
    """Rows of a CSV file as lines of cells joined by " | ", blank cells and rows dropped."""

    def one(data: bytes | None) -> str:
        rows = csv.reader(io.StringIO(decode(bytes(data or b""))))
        return "\n".join(line for r in rows if (line := " | ".join(c.strip() for c in r if c.strip())))

    return content.map(one)


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of CSV files of any of the encodings."""
    return spark.read.format("binaryFile").load(path).select("path", csv_text("content").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(rel, size, mtime) below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root + "/", "")
    return files.select(rel.alias("rel"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def write_version(df: DataFrame, base: str, version: int) -> str:
    """A new version in a folder of its own: readers of the old one aren't disturbed."""
    path = f"{base.rstrip('/')}/version={version:010d}"
    df.write.mode("error").parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The given version, or the newest complete one (a folder without its success mark is skipped)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    name = f"version={version:010d}" if version is not None else found[-1]
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")
