"""Structured Streaming: incremental sync, idempotent operations, leases, presence, debounced writes, windows.

Every stateful rule is an incremental operator over an event stream; the batch
twins (for backfills and tests) are in batch.py.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values, in seconds.
LEASE_S, LEASE_CONTENDED_S, LEASE_GRACE_S = 300.0, 120.0, 30.0
PRESENCE_S = 30
QUIET_S, LONGEST_S = 3.0, 20.0


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, time: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; time becomes a TIMESTAMP for watermarks."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def sync(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Applies what has come since the last run, in micro-batches, then stops; the checkpoint is the cursor."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    query.awaitTermination()
    return query


def first_of_operation(stream: DataFrame, key: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each operation once: repeats of a key within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def tumbling_counts(stream: DataFrame, key: list[str], time: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *key, "n")


def presence(stream: DataFrame, user: str = "user_id", time: str = "ts", gap: str = f"{PRESENCE_S} seconds", late: str = "1 minute") -> DataFrame:
    """(user, start, end, n): who was active from when to when; a session ends after the gap."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(s.alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


# --- rules that are folded in the order of time ------------------------------------------------------------------
#
# A step takes (state, row) and gives (rows out, state); a deadline tells when a state ends by itself, and an
# ending gives the rows out for that. States are tuples of plain values; None is a key nothing is known of.

LEASE_OUT = "field string, at double, user string, action string, until double"
VERSION_OUT = "field string, seq long, result string, version int, copy string"
WRITE_OUT = "field string, at double, edits int"


def lease_step(held: tuple | None, r: dict) -> tuple[list[tuple], tuple]:
    """One request. A holder extends; others get a free lease, or shorten a contended one and wait."""
    at, user = float(r["at"]), r["user"]
    if held is None or held[0] == user:
        since = held[1] if held else at
        now = (user, since, at + LEASE_S)
        return [(r["field"], at, user, "extend" if held else "acquire", now[2])], now
    holder, since, until = held
    contended = since + LEASE_CONTENDED_S
    until = min(until, max(min(until, contended), at + LEASE_GRACE_S if contended <= at else 0.0))
    return [(r["field"], at, user, "wait", until)], (holder, since, until)


def lease_deadline(held: tuple) -> float:
    return held[2]


def lease_ends(field: str, held: tuple) -> list[tuple]:
    return [(field, held[2], held[0], "expire", held[2])]


def version_step(held: tuple | None, r: dict) -> tuple[list[tuple], tuple]:
    """An edit on the current version is applied; one on an older version is kept as a conflict copy unless it changes nothing."""
    version, text = held or (0, "")
    if int(r["base"]) == version:
        return [(r["field"], int(r["seq"]), "applied", version + 1, None)], (version + 1, r["text"])
    result = "same" if r["text"] == text else "conflict"
    return [(r["field"], int(r["seq"]), result, version, r["text"] if result == "conflict" else None)], (version, text)


def write_step(held: tuple | None, r: dict) -> tuple[list[tuple], tuple]:
    """An edit joins the burst, or opens the next one if the first edit of the burst is too long ago."""
    at = float(r["at"])
    if held and at - held[0] > LONGEST_S:
        return write_ends(r["field"], held), (at, at, 1)
    return [], (held[0] if held else at, at, (held[2] if held else 0) + 1)


def write_deadline(held: tuple) -> float:
    return held[1] + QUIET_S


def write_ends(field: str, held: tuple) -> list[tuple]:
    return [(field, min(held[1] + QUIET_S, held[0] + LONGEST_S), held[2])]


def fold(field: str, held: tuple | None, rows: list[dict], now: float, step: Callable, deadline: Callable | None, ends: Callable | None, time: str = "at") -> tuple[list[tuple], tuple | None]:
    """Rows in order of time, and what has ended before each of them and before now."""
    out = []
    for r in rows:
        if held is not None and deadline and deadline(held) < float(r[time]):
            out += ends(field, held)
            held = None
        more, held = step(held, r)
        out += more
    if held is not None and deadline and deadline(held) < now:
        out += ends(field, held)
        held = None
    return out, held


def _in_order(step: Callable, deadline: Callable | None, ends: Callable | None, columns: list[str], order: list[str], time: str):
    """A state function: rows wait until the watermark has passed them, then are folded in order; a timer wakes the key for the next of them, or for its deadline.

    So what comes out doesn't depend on how rows were cut into batches, and a key that has ended keeps no state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = json.loads(state.get[0]) if state.exists else ([], None)
        held = None if held is None else tuple(held)
        for pdf in batches:
            waiting += pdf.drop(columns=["_event"]).to_dict("records")
        now = state.getCurrentWatermarkMs() / 1000.0
        waiting.sort(key=lambda r: [r[c] for c in order])
        ready = [r for r in waiting if r[time] <= now]
        waiting = waiting[len(ready) :]
        out, held = fold(key[0], held, ready, now, step, deadline, ends, time)
        due = [r[time] for r in waiting[:1]] + ([deadline(held)] if held is not None and deadline else [])
        if waiting or held is not None:
            state.update((json.dumps([waiting, held]),))
            if due:
                state.setTimeoutTimestamp(int(max(min(due), now) * 1000) + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _folded(stream: DataFrame, out: str, step: Callable, deadline: Callable | None, ends: Callable | None, order: list[str], time: str, late: str) -> DataFrame:
    stamped = stream.withColumn("_event", F.timestamp_micros((F.col(time) * 1_000_000).cast("long"))).withWatermark("_event", late)
    return stamped.groupBy("field").applyInPandasWithState(_in_order(step, deadline, ends, _names(out), order, time), out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def leases(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests (field, user, at in epoch seconds) answered with acquire, extend or wait, and until when the lease runs; expire when it ran out."""
    return _folded(stream, LEASE_OUT, lease_step, lease_deadline, lease_ends, ["at", "user"], "at", late)


def versions(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Edits (field, seq, at, base, text) checked against the field's version, in order of (at, seq). Copies are kept by retained() on what comes out."""
    return _folded(stream, VERSION_OUT, version_step, None, None, ["at", "seq"], "at", late)


def write_backs(stream: DataFrame, late: str = "5 seconds") -> DataFrame:
    """(field, at, edits): a write after 3 quiet seconds, at the latest 20 seconds after the first edit; the last burst too, when its quiet has passed."""
    return _folded(stream, WRITE_OUT, write_step, write_deadline, write_ends, ["at"], "at", late)


def since(events: DataFrame, last_id: int, lookback: int = 0, key: str = "event_id") -> DataFrame:
    """Events behind a cursor, reaching back a little for late ids."""
    return events.where(F.col(key) > last_id - lookback)


def retained(events: DataFrame, by: Column, newest: int, order: list[Column]) -> DataFrame:
    """The newest rows of each key."""
    from pyspark.sql import Window as W

    return events.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= newest).drop("_n")
