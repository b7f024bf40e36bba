"""The streaming queries: metrics with revisions, dead letters and the materialised view.

The same operators as in batch, under a watermark. Spark drops a row when the highest event time less the lateness has
passed its window's end, which is the allowed lateness counted from the window's end. In update mode a window's row is
its total so far, so revisions accumulate; in append mode there is one row, when the window can't change any more.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quelora.operators import changelog, contract, metrics
from quelora.operators.view import ViewStore
from quelora.settings import Settings


def events(records: DataFrame, settings: Settings) -> DataFrame:
    """Valid events of a record stream, with the watermark."""
    found = contract.valid(contract.validate(records))
    return found.withWatermark("event_ts", f"{settings.allowed_lateness_seconds} seconds")


def window_metrics(records: DataFrame, settings: Settings) -> DataFrame:
    """Keyed, deduplicated and aggregated in one stateful plan. Ids are kept until their window can't change."""
    return metrics.window_metrics(events(records, settings), settings)


def dead_letters(records: DataFrame, settings: Settings) -> DataFrame:
    """Dead-letter records of a record stream: stateless, a query of its own with its own checkpoint."""
    return contract.dead_letter_records(contract.dead_letters(contract.validate(records)), settings.dlq_topic)


def trigger(writer: DataStreamWriter, settings: Settings, available_now: bool) -> DataStreamWriter:
    """What there is now, or a micro-batch every so often: early revisions come with processing time."""
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{settings.early_firing_seconds or 1} seconds")


def to_view(records: DataFrame, settings: Settings, view_path: str, checkpoint: str, available_now: bool = True):
    """Keeps the view up to date with every revision; a batch's number is the pane of its rows."""
    store = ViewStore(view_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(changelog.revisions(batch, pane_index=F.lit(batch_id), pane_timing=F.lit("UNKNOWN")), batch_id)

    writer = window_metrics(records, settings).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return trigger(writer, settings, available_now).start()


def to_log(records: DataFrame, settings: Settings, log, checkpoint: str, available_now: bool = True, panes: bool = False):
    """Publishes changelog records: each window once, when it is final, or with ``panes`` every early, on-time and late
    revision (which needs the RocksDB state store)."""
    if panes:
        from quelora.streaming.panes import panes as revised

        changes = revised(events(records, settings), settings)
    else:
        changes = changelog.revisions(window_metrics(records, settings))
    changes = changelog.encode(changes, settings.metrics_topic)
    return trigger(log.writer(changes, checkpoint).outputMode("append"), settings, available_now).start()


def log_to_view(records: DataFrame, view_path: str, checkpoint: str, available_now: bool = True, seconds: int = 1):
    """Keeps the view up to date from the records of the metrics log; a source's limit of records or files a trigger
    bounds each poll."""
    writer = changelog.decode(records).writeStream.option("checkpointLocation", checkpoint).foreachBatch(ViewStore(view_path))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def settle(queries: list, seconds: float | None, quiet: float | None = None, poll: float = 0.5) -> None:
    """Waits until all queries have ended or, with limits, until the deadline or until none has read a row for ``quiet``
    seconds; then stops those that still run. One clock for all of them."""
    began = last = time.monotonic()
    seen = None
    while any(q.isActive for q in queries):
        now = time.monotonic()
        done = [(p["batchId"], p["numInputRows"]) if (p := q.lastProgress) else None for q in queries]
        busy = any(x and x[1] for x in done) and done != seen
        last, seen = (now if busy else last), done
        if (seconds is not None and now - began >= seconds) or (quiet is not None and now - last >= quiet):
            break
        time.sleep(poll)
    for q in queries:
        if q.isActive:
            q.stop()
        elif (failure := q.exception()) is not None:
            raise failure


def dropped_rows(query) -> int:
    """Rows beyond the lateness that the engine has dropped, from the progress that the query remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def dead_letters_to_log(records: DataFrame, settings: Settings, log, checkpoint: str, available_now: bool = True):
    """Publishes dead letters."""
    return trigger(log.writer(dead_letters(records, settings), checkpoint), settings, available_now).start()
