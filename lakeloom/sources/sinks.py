"""Sinks: upserts, child replacement, exports with manifests, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], update: bool = True, order: str | None = None) -> DataFrame:
    """The table after inserting rows: on a known key the incoming row wins (update) or the current one stays.

    Among incoming rows of one key the last by ``order`` counts.
    """
    if order:
        incoming = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    else:
        incoming = incoming.dropDuplicates(key)
    kept = current.join(incoming.select(*key), key, "left_anti") if update else current
    new = incoming if update else incoming.join(current.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of every incoming parent are replaced by the incoming ones."""
    return current.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Only the partitions that df has rows for are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def manifest(df: DataFrame, name: str, split: str | None = None) -> DataFrame:
    """(name, split, rows, fields): what an export holds."""
    keys = [F.col(split).alias("split")] if split else [F.lit("").alias("split")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "split", "rows", F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)).alias("fields"))


def export_json(df: DataFrame, path: str, name: str, split: str | None = None) -> DataFrame:
    """Compressed JSON lines (a folder for each split) and, beside them, the manifest, which is returned."""
    writer = df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false")
    (writer.partitionBy(split) if split else writer).json(f"{path}/{name}")
    told = manifest(df, name, split)
    told.write.mode("overwrite").json(f"{path}/{name}.manifest")
    return told


def read_export(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of an export, typed as its manifest says."""
    told = spark.read.json(f"{path}/{name}.manifest").first()
    schema = ", ".join(" ".join(f.split(":", 1)) for f in told.fields.split(",")) if told else ""
    return spark.read.schema(schema).json(f"{path}/{name}")


def export_csv(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """CSV with a header; with keys the files hold ranges of them in order, so a page by keys is a stretch of few files."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def export_bundle(files: DataFrame, folder: str, content: str = "content", path: str = "path") -> DataFrame:
    """Artefacts (path, content) and, beside them, what they must be (path, size, sha256), which is returned. Each is written by the task that has it."""
    files.select(path, content).write.mode("overwrite").parquet(f"{folder}/artefacts")
    told = bundle_manifest(files, content, path)
    told.write.mode("overwrite").json(f"{folder}/manifest")
    return told


def check_bundle(spark: SparkSession, folder: str, content: str = "content", path: str = "path") -> DataFrame:
    """(path, size, sha256, state): intact, changed, missing or unlisted, by what a bundle holds and what its manifest says."""
    there = bundle_manifest(spark.read.parquet(f"{folder}/artefacts"), content, path)
    told = spark.read.schema(there.select(path, F.col("size").alias("_size"), F.col("sha256").alias("_sha")).schema.simpleString()[7:-1].replace("_size", "size").replace("_sha", "sha256").replace(":", " ")).json(f"{folder}/manifest")
    j = there.join(told.select(path, F.col("size").alias("_size"), F.col("sha256").alias("_sha")), path, "full_outer")
    same = (F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha"))
    state = F.when(F.col("_sha").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(same, "intact").otherwise("changed")
    return j.select(path, F.coalesce("size", "_size").alias("size"), F.coalesce("sha256", "_sha").alias("sha256"), state.alias("state"))


def bundle_manifest(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, size, sha256) of artefacts."""
    return files.select(path, F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def append_ledger(spark, ledger: str, name: str, rows: int, digest: str) -> None:
    spark.range(1).select(F.lit(name).alias("name"), F.lit(rows).cast("long").alias("rows"), F.lit(digest).alias("digest"), F.current_timestamp().alias("at")).write.mode("append").parquet(ledger)


def row_digest(df: DataFrame) -> DataFrame:
    """df with digest: typed, so that 1 and "1" and null differ."""
    parts = [F.concat(F.lit(f"{f.dataType.simpleString()}="), F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\u0000"))) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.withColumn("digest", F.sha2(F.concat_ws("\u0001", *parts), 256))


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): order-insensitive; row hashes are summed before the shuffle."""
    h = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    return row_digest(df).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
