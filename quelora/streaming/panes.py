"""Revisions with pane metadata: early, on-time and late panes of each aggregate.

A stateful processor for each (metric_type, dimension_id, window) keeps the ids it has seen, the counts, the waits and
the number of the next pane. Panes are EARLY before the watermark passes the window's end (only with early firing),
ON_TIME when it does, and LATE for each batch of late rows until the lateness is over; then the state goes. Rows that
come later are dropped exactly, whatever Spark's own filter does.

Spark's watermark is the highest event time less the lateness, so the window's end passes when it reaches the end less
the lateness, and the state ends when it reaches the end. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quelora.operators import metrics as M
from quelora.schemas import CHANGELOG, CHANGELOG_FIELDS, QUEUE_METRICS, SCHEMA_VERSION
from quelora.settings import Settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = ("offered", "connected", "abandoned", "transferred", "resolved", "answered_within_sl", "transitions")


def nearest_rank(counts: dict[float, int], percent: int) -> float:
    """Value at the nearest rank of a multiset."""
    rank = -(-percent * sum(counts.values()) // 100)
    for value in sorted(counts):
        rank -= counts[value]
        if rank <= 0:
            return value
    return 0.0


def _nanos(seconds: float) -> int:
    """Sums are whole numbers, so they don't depend on the order of rows."""
    return int(Decimal(repr(float(seconds))).scaleb(9).to_integral_value(ROUND_HALF_UP))


def _rounded(x: float, digits: int) -> float:
    """Half up, as the batch metrics are."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _iso(ms: int) -> str:
    return pd.Timestamp(ms, unit="ms").strftime("%Y-%m-%dT%H:%M:%SZ")


class PaneProcessor(StatefulProcessor):
    """Emits a changelog row for each pane of its key."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "event_id string", "seen boolean")
        self.waits = handle.getMapState("waits", "wait double", "n int")
        self.sums = handle.getValueState("sums", ", ".join(f"{c} bigint" for c in (*_COUNTS, "talk", "wait")))
        self.pane = handle.getValueState("pane", "next int")
        self.fired = handle.getValueState("fired", "on_time boolean")

    def _bounds(self, key: tuple) -> tuple[int, int, int]:
        """Window start, end and on-time watermark in milliseconds."""
        start = int(key[2])
        end = start + self.settings.window_seconds * 1000
        return start, end, end - self.settings.allowed_lateness_seconds * 1000

    def _row(self, key: tuple, timing: str) -> pd.DataFrame:
        start, end, _ = self._bounds(key)
        index = self.pane.get()[0] if self.pane.exists() else 0
        self.pane.update((index + 1,))
        *counts, talk, wait = self.sums.get()
        n = dict(zip(_COUNTS, counts, strict=True))
        row = dict.fromkeys(CHANGELOG_FIELDS)
        row |= {
            "schema_version": SCHEMA_VERSION,
            "aggregate_id": f"{key[0]}|{key[1]}|{_iso(start)}",
            "metric_type": key[0],
            "dimension_id": key[1],
            "window_start": _iso(start),
            "window_end": _iso(end),
            "pane_index": index,
            "pane_timing": timing,
            "is_first": index == 0,
            "is_last": False,
        }
        if key[0] == M.STATE:
            row["transitions"] = n["transitions"]
        else:
            waits = {w[0]: c[0] for w, c in self.waits.iterator()}
            finished, total = n["connected"] + n["abandoned"], sum(waits.values())
            row |= {c: n[c] for c in _COUNTS if c in QUEUE_METRICS} | {
                "ns20": _rounded(n["answered_within_sl"] / n["connected"], 4) if n["connected"] else 0.0,
                "abandon_rate": _rounded(n["abandoned"] / finished, 4) if finished else 0.0,
                "avg_wait_seconds": _rounded(wait / 1e9 / total, 3) if total else 0.0,
                "p90_wait_seconds": _rounded(nearest_rank(waits, 90), 3),
                "max_wait_seconds": _rounded(max(waits), 3) if waits else 0.0,
                "total_talk_seconds": _rounded(talk / 1e9, 3),
            }
        frame = pd.DataFrame([row], columns=list(CHANGELOG_FIELDS))
        return frame.astype({c: {"bigint": "Int64", "int": "Int32"}[k] for c, k in CHANGELOG_FIELDS.items() if k in ("bigint", "int")})

    def _add(self, rows: pd.DataFrame) -> bool:
        """Counts the rows of ids not seen yet; whether there were any."""
        sums = list(self.sums.get()) if self.sums.exists() else [0] * (len(_COUNTS) + 2)
        at = {c: k for k, c in enumerate(_COUNTS)}
        fresh = False
        for r in rows.itertuples():
            if self.ids.containsKey((r.event_id,)):
                continue
            self.ids.updateValue((r.event_id,), (True,))
            fresh = True
            wait = 0.0 if pd.isna(r.wait_seconds) else float(r.wait_seconds)
            sums[at["transitions"]] += 1
            if r.event_type == "contact_queued":
                sums[at["offered"]] += 1
            elif r.event_type == "contact_connected":
                sums[at["connected"]] += 1
                sums[at["answered_within_sl"]] += int(wait <= self.settings.service_level_seconds)
            elif r.event_type == "contact_ended":
                self.waits.updateValue((wait,), ((self.waits.getValue((wait,))[0] if self.waits.containsKey((wait,)) else 0) + 1,))
                sums[-1] += _nanos(wait)
                left = r.disposition if r.disposition in ("abandoned", "transferred") else "resolved"
                sums[at[left]] += 1
                if left != "abandoned":
                    sums[-2] += 0 if pd.isna(r.talk_seconds) else _nanos(r.talk_seconds)
        if fresh:
            self.sums.update(tuple(sums))
        return fresh

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, end, on_time = self._bounds(key)
        if now >= on_time and self.sums.exists():  # due before these rows, which come after its watermark
            yield from self._on_time(key)
        fresh = False
        for batch in rows:
            if now < end:
                fresh |= self._add(batch)
        if not fresh:
            return
        if now >= on_time:
            if self.fired.exists():
                yield self._row(key, "LATE")
            else:
                yield from self._on_time(key)
        else:
            self.handle.registerTimer(on_time)
            if self.settings.early_firing_seconds > 0:
                yield self._row(key, "EARLY")
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, end, _ = self._bounds(key)
        if expiredTimerInfo.getExpiryTimeInMs() < end:
            if self.sums.exists():
                yield from self._on_time(key)
        else:
            for state in (self.ids, self.waits, self.sums, self.pane, self.fired):
                state.clear()

    def _on_time(self, key: tuple) -> Iterator[pd.DataFrame]:
        """The ON_TIME pane, once: by the timer, or before it by rows of the batch that first sees the watermark."""
        if not self.fired.exists():
            self.fired.update((True,))
            yield self._row(key, "ON_TIME")

    def close(self) -> None:
        pass


def panes(events: DataFrame, settings: Settings) -> DataFrame:
    """Changelog rows of a stream of valid events that has the watermark on event_ts."""
    start = F.unix_millis(F.window("event_ts", f"{settings.window_seconds} seconds").start)
    keyed = M.keyed(events, settings).withColumn("window_ms", start)
    rows = keyed.select("metric_type", "dimension_id", "window_ms", "event_id", "event_type", "disposition", "wait_seconds", "talk_seconds", "event_ts")
    grouped = rows.groupBy("metric_type", "dimension_id", "window_ms")
    return grouped.transformWithStateInPandas(PaneProcessor(settings), CHANGELOG, "Append", "EventTime")
