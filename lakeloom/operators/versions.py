"""A store of versions as deltas: a snapshot every ``EVERY`` versions, line edits in between.

A segment is a snapshot and the edits up to the next one. It is written from
its own texts and read back from its own rows, so segments of one document are worked on
side by side, and any version takes at most ``EVERY`` steps.

Edge cases: a null text is an empty one; versions are told apart and ordered by their number, which may have
gaps; a repeated (doc, version) is an error of the input that gives one edit more; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.windows import grouped_fold

EVERY = 50


def line_delta(before: str, after: str) -> tuple[int, int, str]:
    """(at, removed, text) in lines: what lies between the lines that both texts begin and end with."""
    a, b = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, len(a) - head - tail, "\n".join(b[head : len(b) - tail])


def apply_delta(text: str, at: int, removed: int, lines: str, added: int) -> str:
    a = text.split("\n")
    a[at : at + removed] = lines.split("\n") if added else []
    return "\n".join(a)


def write_deltas(versions: DataFrame, doc: str = "doc_id", version: str = "version", text: str = "text", every: int = EVERY) -> DataFrame:
    """(doc, version, segment, step, kind, at, removed, added, text): the log of versions (doc, version, text); kind is full or edit."""
    kinds = dict(versions.dtypes)
    # Numbers of versions move alone; texts meet their segment afterwards.
    order = versions.select(doc, version).withColumn("_i", F.row_number().over(W.partitionBy(doc).orderBy(version)) - 1)
    order = order.select(doc, version, F.floor(F.col("_i") / every).cast("int").alias("segment"), (F.col("_i") % every).alias("step"))
    rows = versions.select(doc, version, F.coalesce(text, F.lit("")).alias("text")).join(order, [doc, version])
    schema = f"{doc} {kinds[doc]}, {version} {kinds[version]}, segment int, step int, kind string, at int, removed int, added int, text string"

    def fold(items: list[dict]) -> list[tuple]:
        out, before = [], ""
        for i, r in enumerate(items):
            now = r["text"]
            if i == 0:
                out.append((r[doc], r[version], int(r["segment"]), int(r["step"]), "full", None, None, None, now))
            else:
                at, removed, lines = line_delta(before, now)
                added = len(now.split("\n")) - len(before.split("\n")) + removed
                out.append((r[doc], r[version], int(r["segment"]), int(r["step"]), "edit", at, removed, added, lines if added else ""))
            before = now
        return out

    key = F.struct(doc, "segment")
    return grouped_fold(rows.withColumn("_k", F.to_json(key)), "_k", ["step"], schema, fold)


def read_versions(log: DataFrame, doc: str = "doc_id", version: str = "version") -> DataFrame:
    """(doc, version, text, step): every version, from its segment's snapshot and the edits up to it."""
    kinds = dict(log.dtypes)

    def fold(items: list[dict]) -> list[tuple]:
        out, now = [], ""
        for r in items:
            now = r["text"] if r["kind"] == "full" else apply_delta(now, int(r["at"]), int(r["removed"]), r["text"], int(r["added"]))
            out.append((r[doc], r[version], now, int(r["step"])))
        return out

    return grouped_fold(log.withColumn("_k", F.to_json(F.struct(doc, "segment"))), "_k", ["step"], f"{doc} {kinds[doc]}, {version} {kinds[version]}, text string, step int", fold)


def read_some(log: DataFrame, wanted: DataFrame, doc: str = "doc_id", version: str = "version") -> DataFrame:
    """(doc, version, text, step) of the wanted (doc, version): only their segments are read, and of these only what lies before them."""
    asked = wanted.select(doc, version).distinct().join(log.select(doc, version, "segment", F.col("step").alias("_last")), [doc, version])
    needed = asked.groupBy(doc, "segment").agg(F.max("_last").alias("_last"))
    rows = log.join(needed, [doc, "segment"]).where(F.col("step") <= F.col("_last")).drop("_last")
    return read_versions(rows, doc, version).join(wanted.select(doc, version).distinct(), [doc, version], "left_semi")
