"""Windowed metrics of both kinds in one keyed aggregation, for batch and streams alike.

Queue metrics and state counts are keyed by (metric_type, dimension_id, window), so one scan, one deduplication and one
aggregation serve both. Map-side partial aggregation absorbs a hot queue; deduplication shuffles by event id as well,
which spreads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.functions.rounding import exact_round
from quelora.schemas import AGENT_TYPE, CONTACT_TYPES, QUEUE_METRICS
from quelora.settings import Settings

QUEUE = "queue_metrics"
STATE = "agent_state_counts"
#: Sums are exact decimals, so they don't depend on the order of rows.
EXACT = "decimal(28,9)"


def keyed(events: DataFrame, settings: Settings) -> DataFrame:
    """Adds metric_type, dimension_id and window to valid events. A null dimension is named None."""
    agent = F.col("event_type") == AGENT_TYPE
    dimension = F.coalesce(F.when(agent, F.col("to_state")).otherwise(F.col("queue_id")), F.lit("None"))
    return events.where(agent | F.col("event_type").isin(*CONTACT_TYPES)).withColumns({
        "metric_type": F.when(agent, STATE).otherwise(QUEUE),
        "dimension_id": dimension,
        "window": F.window("event_ts", f"{settings.window_seconds} seconds"),
    })


def deduplicate(events: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """One event for each id in its dimension and window. With first_by (batch only) it is the first in that order;
    otherwise any, as repeated events are equal."""
    scope = ["metric_type", "dimension_id", "window", "event_id"]
    if first_by is None:
        return events.dropDuplicates(scope)
    return events.groupBy(*scope).agg(F.min_by(F.struct(*events.columns), F.struct(*first_by)).alias("e")).select("e.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))


def aggregate(events: DataFrame, settings: Settings, exact_rounding: bool = False, counted: bool = False) -> DataFrame:
    """(metric_type, dimension_id, window, metrics) of deduplicated keyed events; metrics of the other kind are null. With
    ``counted`` also events_counted, of either kind."""
    kind = F.col("event_type")
    wait = F.coalesce(F.col("wait_seconds"), F.lit(0.0))
    ended, connected = kind == "contact_ended", kind == "contact_connected"
    disposition = F.coalesce(F.col("disposition"), F.lit(""))
    talk = F.when(ended & (disposition != "abandoned"), F.coalesce(F.col("talk_seconds"), F.lit(0.0)).cast(EXACT))
    sums = events.withColumn("__wait", F.when(ended, wait)).groupBy("metric_type", "dimension_id", "window").agg(
        F.count_if(kind == "contact_queued").alias("offered"),
        F.count_if(connected).alias("connected"),
        F.count_if(ended & (disposition == "abandoned")).alias("abandoned"),
        F.count_if(ended & (disposition == "transferred")).alias("transferred"),
        F.count_if(ended & ~disposition.isin("abandoned", "transferred")).alias("resolved"),
        F.count_if(connected & (wait <= settings.service_level_seconds)).alias("answered_within_sl"),
        F.sum(F.col("__wait").cast(EXACT)).cast("double").alias("__waits"),
        F.count("__wait").alias("__n"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY __wait)").alias("__p90"),
        F.max("__wait").alias("__max"),
        F.sum(talk).cast("double").alias("__talk"),
        F.count("*").alias("transitions"),
    )
    queue = F.col("metric_type") == QUEUE
    digits = {"ns20": 4, "abandon_rate": 4, "avg_wait_seconds": 3, "p90_wait_seconds": 3, "max_wait_seconds": 3, "total_talk_seconds": 3}
    finished = F.col("connected") + F.col("abandoned")
    raw = {
        "ns20": F.when(F.col("connected") > 0, F.col("answered_within_sl") / F.col("connected")),
        "abandon_rate": F.when(finished > 0, F.col("abandoned") / finished),
        "avg_wait_seconds": F.when(F.col("__n") > 0, F.col("__waits") / F.col("__n")),
        "p90_wait_seconds": F.col("__p90"),
        "max_wait_seconds": F.col("__max"),
        "total_talk_seconds": F.col("__talk"),
    }
    values = {n: F.coalesce(c if exact_rounding else F.round(c, digits[n]), F.lit(0.0)) for n, c in raw.items()}
    counts = {n: F.col(n) for n in QUEUE_METRICS if n not in raw}
    metrics = [F.when(queue, {**counts, **values}[n]).alias(n) for n in QUEUE_METRICS]
    more = [F.col("transitions").alias("events_counted")] if counted else []
    out = sums.select("metric_type", "dimension_id", "window", *metrics, F.when(~queue, F.col("transitions")).alias("transitions"), *more)
    return exact_round(out, digits) if exact_rounding else out


def window_metrics(events: DataFrame, settings: Settings, exact_rounding: bool = False) -> DataFrame:
    """Keys, deduplicates and aggregates valid events."""
    return aggregate(deduplicate(keyed(events, settings)), settings, exact_rounding)


def dedup_summary(events: DataFrame, settings: Settings) -> DataFrame:
    """One row: events accepted, duplicates and windows."""
    found = keyed(events, settings).groupBy("metric_type", "dimension_id", "window", "event_id").agg(F.count("*").alias("n"))
    by_window = found.groupBy("metric_type", "dimension_id", "window").agg(F.count("*").alias("accepted"), F.sum("n").alias("seen"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_window.agg(total("accepted").alias("accepted"), (total("seen") - total("accepted")).alias("duplicates"), F.count("*").alias("windows"))


def queue_window_report(events: DataFrame, settings: Settings) -> DataFrame:
    """Queue metrics with the report's own ids and bounds in milliseconds, and the events counted."""
    from quelora.functions.iso import format_millis

    chosen = deduplicate(keyed(events, settings)).where(F.col("metric_type") == QUEUE)
    found = aggregate(chosen, settings, counted=True)
    start = format_millis(F.col("window.start"))
    return found.select(
        F.concat_ws(":", "dimension_id", start).alias("aggregate_id"),
        F.col("dimension_id").alias("queue_id"),
        start.alias("window_start"),
        format_millis(F.col("window.end")).alias("window_end"),
        F.lit(settings.window_seconds).alias("window_seconds"),
        *QUEUE_METRICS,
        F.lit(settings.service_level_seconds).alias("service_level_seconds"),
        "events_counted",
    )
