"""The changelog: identified revisions of aggregates, and their log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.functions.iso import format_seconds
from quelora.schemas import CHANGELOG, CHANGELOG_FIELDS, QUEUE_METRICS, SCHEMA_VERSION


def revisions(metrics: DataFrame, pane_index: Column | None = None, pane_timing: Column | None = None) -> DataFrame:
    """Changelog rows of aggregates; by default the single on-time revision that a finished window has."""
    start = format_seconds(F.col("window.start"))
    index = F.lit(0) if pane_index is None else pane_index
    return metrics.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws("|", "metric_type", "dimension_id", start).alias("aggregate_id"),
        "metric_type",
        "dimension_id",
        start.alias("window_start"),
        format_seconds(F.col("window.end")).alias("window_end"),
        index.cast("int").alias("pane_index"),
        (F.lit("ON_TIME") if pane_timing is None else pane_timing).alias("pane_timing"),
        (index == 0).alias("is_first"),
        F.lit(False).alias("is_last"),
        *QUEUE_METRICS,
        "transitions",
    )


def encode(changes: DataFrame, topic: str) -> DataFrame:
    """Log records: the dimension as key; the row as JSON with sorted fields and without those of the other kind."""
    value = F.to_json(F.struct(*sorted(CHANGELOG_FIELDS)))
    return changes.select(F.col("dimension_id").cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(topic).alias("topic"))


def decode(records: DataFrame) -> DataFrame:
    """Changelog rows of log records, with the log's other columns; values that aren't JSON or have no id are left out."""
    kept = [c for c in records.columns if c not in ("value", *CHANGELOG_FIELDS)]
    parsed = records.withColumn("row", F.from_json(F.col("value").cast("string"), CHANGELOG))
    return parsed.where("row.aggregate_id IS NOT NULL").select(*kept, "row.*")
