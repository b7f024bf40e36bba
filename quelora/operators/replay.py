"""Replay of events with delivery delay, duplicates and broken copies, as one deterministic projection.

Chances come from hashes of the event id and a seed, so a replay is the same on every run, in any partitioning.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.functions.ids import event_id
from quelora.functions.iso import format_millis
from quelora.schemas import REQUIRED, SCHEMA_VERSION
from quelora.settings import Settings

_STEPS = 1 << 30


def chance(seed: int, *of: str) -> Column:
    """A number in [0, 1) for each value of the columns."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(_STEPS)) / _STEPS


def shift(events: DataFrame, target_start: str) -> DataFrame:
    """Moves all event times by the same interval, so that the first is at target_start."""
    origin = events.agg(F.min("event_ts").alias("__origin"))
    moved = F.timestamp_micros(F.unix_micros("event_ts") - F.unix_micros("__origin") + F.unix_micros(F.lit(target_start).cast("timestamp")))
    return events.crossJoin(F.broadcast(origin)).withColumn("event_ts", moved).withColumn("event_time", format_millis(F.col("event_ts"))).drop("__origin")  # one row


def schedule(events: DataFrame, tardiness_seconds: float = 45.0, seed: int = 7) -> DataFrame:
    """Adds deliver_at: the event time plus a uniform delay."""
    if tardiness_seconds < 0:
        raise ValueError("tardiness_seconds must not be negative")
    delay = (chance(seed, "event_id") * tardiness_seconds * 1e6).cast("long")
    return events.withColumn("deliver_at", F.timestamp_micros(F.unix_micros("event_ts") + delay))


def build(rows: DataFrame, event_type: str, *id_parts: str) -> DataFrame:
    """Events of a type from rows with event_ts, event_key and payload columns: fills the id from the parts' columns where
    it is null, and the schema's version. Raises where the type isn't one of the contract or a required field has no
    column."""
    if event_type not in REQUIRED:
        raise ValueError(f"unknown event type: {event_type}")
    if lacking := [n for n in REQUIRED[event_type] if n not in rows.columns]:
        raise ValueError(f"{event_type} needs {', '.join(lacking)}")
    made = event_id(*(F.col(p).cast("string") for p in id_parts)) if id_parts else F.uuid()
    given = F.coalesce("event_id", made) if "event_id" in rows.columns else made
    return rows.withColumns({"event_id": given, "event_type": F.lit(event_type), "event_time": format_millis(F.col("event_ts")), "schema_version": F.lit(SCHEMA_VERSION)})


def pace(records: DataFrame, append: Callable[[DataFrame], object], speed: float = 1.0, step_seconds: float = 1.0, stop: threading.Event | None = None) -> int:
    """Appends the records as their deliver_at comes by a clock that runs ``speed`` times as fast, a slice for each step of
    real time, until all are out or ``stop`` is set. Gives the number of slices that were written."""
    if speed <= 0 or step_seconds <= 0:
        raise ValueError("speed and step_seconds must be positive")
    stop = stop or threading.Event()
    due = F.unix_micros("deliver_at")
    low, high = records.agg(F.min(due), F.max(due)).first()
    began, at, written = time.monotonic(), low, 0
    while at is not None and at <= high and not stop.is_set():
        stop.wait(step_seconds)
        until = low + int((time.monotonic() - began) * speed * 1e6)
        part = records.where((due >= at) & (due < until if until <= high else due <= high))
        if not stop.is_set() and not part.isEmpty():
            append(part)
            written += 1
        at = until
    return written


def copies(events: DataFrame, duplicate_rate: float = 0.02, invalid_rate: float = 0.0, seed: int = 7) -> DataFrame:
    """Each event, then perhaps its duplicate and its broken copy: adds copy (original, duplicate or invalid)."""
    kinds = F.array_compact(F.array(
        F.lit("original"),
        F.when(chance(seed + 1, "event_id") < duplicate_rate, F.lit("duplicate")),
        F.when(chance(seed + 2, "event_id") < invalid_rate, F.lit("invalid")),
    ))
    return events.withColumn("copy", F.explode(kinds))


def payload_json(event_type: Column, broken: Column) -> Column:
    """The payload as JSON with sorted fields; a broken one lacks the first required field beside contact_id."""
    dropped = F.coalesce(*(F.when(event_type == t, F.lit(next(n for n in names if n != "contact_id"))) for t, names in REQUIRED.items()))
    fields = sorted({*sum(REQUIRED.values(), ()), "skill_required"})
    kept = [F.when(~(broken & (dropped == n)), F.col(n)).alias(n) for n in fields]
    return F.struct(*kept)


def log_records(events: DataFrame, settings: Settings) -> DataFrame:
    """Log records (key, value, topic, timestamp, headers) of events; rows whose copy is invalid are broken."""
    broken = F.col("copy") == "invalid" if "copy" in events.columns else F.lit(False)
    time = F.col("event_time") if "event_time" in events.columns else format_millis(F.col("event_ts"))
    body = F.struct(
        "event_id", time.alias("event_time"), "event_type", F.col("event_key").alias("key"), payload_json(F.col("event_type"), broken).alias("payload"), "schema_version"
    )
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
    return events.select(
        F.col("event_key").cast("binary").alias("key"),
        F.to_json(body).cast("binary").alias("value"),
        settings.topic(F.col("event_type")).alias("topic"),
        F.date_trunc("millisecond", "event_ts").alias("timestamp"),
        F.array(header("event_type", F.col("event_type")), header("schema_version", F.col("schema_version"))).alias("headers"),
        *(["deliver_at"] if "deliver_at" in events.columns else []),
    )


def counts(copied: DataFrame) -> DataFrame:
    """One row: records published, duplicates and broken copies."""
    return copied.agg(
        F.count("*").alias("events"), F.count_if(F.col("copy") == "duplicate").alias("duplicates"), F.count_if(F.col("copy") == "invalid").alias("invalid")
    )
