"""Batch twins of the streaming operators: the same rules over a complete event table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.windows import grouped_fold
from lakeloom.streaming import events


def _folded(rows: DataFrame, order: list[str], out: str, step, deadline, ends, time: str) -> DataFrame:
    """The fold of the streaming operator over all rows of each field; at the end of the table, everything has ended."""

    def run(some: list[dict]) -> list[tuple]:
        return events.fold(some[0]["field"], None, some, math.inf, step, deadline, ends, time)[0]

    return grouped_fold(rows, "field", order, out, run)


def leases(requests: DataFrame) -> DataFrame:
    return _folded(requests, ["at", "user"], events.LEASE_OUT, events.lease_step, events.lease_deadline, events.lease_ends, "at")


def versions(edits: DataFrame) -> DataFrame:
    return _folded(edits, ["at", "seq"], events.VERSION_OUT, events.version_step, None, None, "at")


def write_backs(edits: DataFrame) -> DataFrame:
    """(field, at, edits): bursts by gaps of QUIET_S, cut after LONGEST_S from their first edit.

    A cut moves the start of what follows, so the fold is sequential within a burst, not across bursts: bursts are the groups.
    """
    w = W.partitionBy("field").orderBy("at")
    b = edits.withColumn("_gap", F.when(F.col("at") - F.lag("at").over(w) <= events.QUIET_S, 0).otherwise(1))
    b = b.withColumn("_burst", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    burst = b.select(F.concat_ws("\u0001", "field", F.col("_burst").cast("string")).alias("field"), "at")
    done = _folded(burst, ["at"], events.WRITE_OUT, events.write_step, events.write_deadline, events.write_ends, "at")
    return done.withColumn("field", F.substring_index("field", "\u0001", 1))


def presence(rows: DataFrame, user: str = "user_id", time: str = "ts", gap: int = 30) -> DataFrame:
    s = F.session_window(F.col(time).cast("timestamp"), f"{gap} seconds")
    return rows.groupBy(s.alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_of_operation(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
