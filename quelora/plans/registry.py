"""Named queries of the analytics engine and their SQL twins.

Every query runs over the whole ``events`` table through the record log, the contract and the operators; the SQL
derives the same rows from the table directly.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quelora.functions.ids import event_id
from quelora.operators import changelog, checks, contract, metrics, replay, view
from quelora.schemas import PAYLOAD_NUMBERS, PAYLOAD_STRINGS
from quelora.settings import Settings
from quelora.sources.adapter import events_log
from quelora.sources.log import FileLog, publish
from quelora.sources.shared import settings, shared_path
from quelora.streaming import pipeline
from quelora.streaming.panes import ROCKSDB

DAY = Settings(window_seconds=86_400, allowed_lateness_seconds=86_400)
HOUR = Settings(window_seconds=3_600, allowed_lateness_seconds=3_600)


def _utc(f):
    """The query in UTC: its expressions take the time zone when they are resolved, and the caller's own is back after."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with settings(spark, spark__sql__session__timeZone="UTC"):
            return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _validated(spark, sf_dir) -> DataFrame:
    return contract.validate(events_log(spark, sf_dir))


def _events(spark, sf_dir) -> DataFrame:
    return contract.valid(_validated(spark, sf_dir))


def _queue(spark, sf_dir, settings: Settings) -> DataFrame:
    found = metrics.window_metrics(_events(spark, sf_dir), settings).where(F.col("metric_type") == metrics.QUEUE)
    return changelog.revisions(found).select("dimension_id", "window_start", *metrics.QUEUE_METRICS)


def queue_metrics_day(spark, sf_dir):
    """Twelve metrics by queue and day."""
    return _queue(spark, sf_dir, DAY)


def queue_metrics_hour(spark, sf_dir):
    """Twelve metrics by queue and hour."""
    return _queue(spark, sf_dir, HOUR)


def agent_state_counts(spark, sf_dir):
    """Transitions by target state and hour."""
    found = metrics.window_metrics(_events(spark, sf_dir), HOUR).where(F.col("metric_type") == metrics.STATE)
    return changelog.revisions(found).select("aggregate_id", "dimension_id", "window_start", "window_end", "transitions")


def changelog_union(spark, sf_dir):
    """Both kinds of aggregates by day, as changelog rows."""
    return changelog.revisions(metrics.window_metrics(_events(spark, sf_dir), DAY))


def changelog_records(spark, sf_dir):
    """Round trip of the changelog through its log records."""
    records = changelog.encode(changelog_union(spark, sf_dir), DAY.metrics_topic)
    back = changelog.decode(records)
    return back.select(F.col("key").cast("string").alias("key"), "aggregate_id", "offered", "p90_wait_seconds", "transitions")


def queue_window_report(spark, sf_dir):
    """The report form of queue metrics by day."""
    return metrics.queue_window_report(_events(spark, sf_dir), DAY).orderBy("window_start", "queue_id")


def contract_errors(spark, sf_dir):
    """Records by rule that fails; 0 for valid ones."""
    return _validated(spark, sf_dir).groupBy(F.coalesce("rule", F.lit(0)).alias("rule")).agg(F.count("*").alias("n"))


def dlq_rows(spark, sf_dir):
    """Dead letters by error text and key."""
    letters = contract.dead_letter_records(contract.dead_letters(_validated(spark, sf_dir)), DAY.dlq_topic)
    body = F.col("value").cast("string")
    return letters.groupBy(F.get_json_object(body, "$.error").alias("error"), F.col("key").cast("string").alias("kafka_key")).agg(F.count("*").alias("n"))


def topic_routing(spark, sf_dir):
    """Valid records by topic."""
    return _events(spark, sf_dir).groupBy(DAY.topic(F.col("event_type")).alias("topic")).agg(F.count("*").alias("n"))


def dedup_stats(spark, sf_dir):
    """Accepted events, duplicates and windows by hour."""
    return metrics.dedup_summary(_events(spark, sf_dir), HOUR)


def event_id_uuid5(spark, sf_dir):
    """Deterministic ids of the raw events."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", event_id(F.col("user_id").cast("string"), F.concat(F.lit("evento-"), F.col("event_id").cast("string"))).alias("id"))


def delivery_disorder(spark, sf_dir):
    """Events delivered after a later one."""
    return checks.disorder(_events(spark, sf_dir).where("copy = 0"))


def late_split(spark, sf_dir):
    """Events by minute window that the highest event time delivered before them has closed, with 60 s of lateness."""
    return checks.lateness(_events(spark, sf_dir).where("copy = 0"), 60, 60)


def _revisions(spark, sf_dir) -> DataFrame:
    """A changelog with several revisions in arrival order: each event is a revision of its user's aggregate, its pane
    the number in props."""
    raw = _events(spark, sf_dir).where("copy = 0")
    user = F.substring("event_key", 2, 20)
    pane = ((F.unix_micros("deliver_at") - F.unix_micros("event_ts")) / 1_000_000).cast("int")
    return raw.select(F.concat(F.lit("user|"), user).alias("aggregate_id"), F.when(pane % 10 != 9, pane).alias("pane_index"), F.col("event_id").cast("long").alias("offset"))


def view_latest(spark, sf_dir):
    """The last revision of each aggregate."""
    return view.latest(_revisions(spark, sf_dir), ["offset"])


def view_counters(spark, sf_dir):
    """Revisions that replaced one and those out of order."""
    return view.counters(_revisions(spark, sf_dir), ["offset"])


def lifecycle_gaps(spark, sf_dir):
    """Gaps in contacts' life cycles, counted by kind; a contact's days count as contacts of their own."""
    daily = F.concat_ws("|", "event_key", F.date_format("event_ts", "yyyy-MM-dd"))
    return checks.lifecycle_gaps(_events(spark, sf_dir).withColumn("event_key", daily)).groupBy("gap").agg(F.count("*").alias("n"))


def transition_breaks(spark, sf_dir):
    """Agents' broken transition chains."""
    return checks.transition_breaks(_events(spark, sf_dir).where("copy = 0").withColumn("n", F.col("event_id").cast("long")), ["event_ts", "n"])


def causal_breaks(spark, sf_dir):
    """Contacts whose first events are out of causal order."""
    return checks.causal_breaks(_events(spark, sf_dir), F.col("event_id").cast("long"))


def replay_duplicates(spark, sf_dir):
    """What deduplication finds when every event is published twice."""
    events = _events(spark, sf_dir).where("copy = 0").drop("copy")
    records = replay.log_records(replay.copies(events, 1.0, 0.0), DAY)
    return metrics.dedup_summary(contract.valid(contract.validate(records)), HOUR)


def replay_shift(spark, sf_dir):
    """The first and last event time after all events have been moved to another start."""
    moved = replay.shift(_events(spark, sf_dir), "2027-01-01T00:00:00Z")
    return moved.agg(F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.count("*").alias("n"))


def delivered_records(spark, sf_dir):
    """Counts of a delivery to a file log, and what the log then holds."""
    log = FileLog(shared_path(spark, "delivered"))
    found = publish(log, events_log(spark, sf_dir))
    held = log.batch(spark).agg(F.count("offset").alias("stored"), F.count_distinct("key").alias("keys"))
    return held.select(*(F.lit(getattr(found, n)).cast("long").alias(n) for n in ("published", "delivered", "failed")), "stored", "keys")


def topic_disorder(spark, sf_dir):
    """Events of each topic that are delivered after a later one of theirs."""
    return checks.topic_disorder(_events(spark, sf_dir).where("copy = 0"), DAY.topic(F.col("event_type")))


def compare_reports(spark, sf_dir):
    """Daily queue metrics of all events beside those of the events with k below 50, where they differ."""
    events = _events(spark, sf_dir)
    k = ((F.unix_micros("deliver_at") - F.unix_micros("event_ts")) / 1_000_000).cast("int")
    fields = ["offered", "connected"]
    one, two = (changelog.revisions(metrics.window_metrics(e, DAY).where(F.col("metric_type") == metrics.QUEUE)) for e in (events, events.where(k < 50)))
    found = checks.compare(one, two, ["dimension_id", "window_start"], fields)
    return found.select("dimension_id", "window_start", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("left", "right") for c in fields))


def simulated_day(spark, sf_dir):
    """What the checks hold against a simulated day: nothing."""
    from quelora.sources.simulator import SimulatorSource

    spark.dataSource.register(SimulatorSource)
    day = spark.read.format("queue_simulator").options(start="2026-09-28T14:00:00Z", minutes=60, seed=7).load()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(checks.lifecycle_gaps(day), "gaps"),
        n(checks.transition_breaks(day, ["seq"]), "transition_breaks"),
        n(checks.causal_breaks(day, F.struct("event_ts", "seq")), "causal_breaks"),
        n(contract.validate(replay.log_records(day, DAY)).where("rule IS NOT NULL"), "invalid"),
        day.agg((F.count("*") - F.count_distinct("event_id")).alias("repeated_ids")),
    ]
    return functools.reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def replay_corrupt(spark, sf_dir):
    """Broken copies of all valid events fail the contract by the rule of missing payload fields."""
    events = _events(spark, sf_dir).where("copy = 0").drop("copy")
    broken = replay.log_records(replay.copies(events, 0.0, 1.0).where("copy = 'invalid'"), DAY)
    return contract.validate(broken).groupBy("rule", "error").agg(F.count("*").alias("n"))


def summary_by_type(spark, sf_dir):
    """Events by type, contacts and the total."""
    return checks.summary(_events(spark, sf_dir))


def dashboard_projection(spark, sf_dir):
    """The display table of the daily changelog."""
    return view.dashboard(changelog_union(spark, sf_dir)).select("window", "metric", "dimension", "pane", "offered", "connected", "abandoned", "ns20", "avg_wait", "p90_wait", "transitions")


def _ordered_log(spark, records: DataFrame, name: str) -> FileLog:
    """A file log of the records in four files by ranges of delivery time, which streams take in that order."""
    log = FileLog(shared_path(spark, name))
    log.append(records.repartitionByRange(4, "deliver_at").sortWithinPartitions("deliver_at"))
    log.order(spark)
    return log


def stream_queue_metrics(spark, sf_dir):
    """The daily changelog by way of the streaming query: the log is read a file at a time and materialised from the
    revisions."""
    base = shared_path(spark, "stream")
    log = _ordered_log(spark, events_log(spark, sf_dir), "stream-log")
    query = pipeline.to_view(log.stream(spark, 1), DAY, f"{base}/view", f"{base}/checkpoint")
    pipeline.settle([query], None)
    return view.ViewStore(f"{base}/view").read(spark).select("aggregate_id", *metrics.QUEUE_METRICS, "transitions")


def stream_panes(spark, sf_dir):
    """The panes of the daily windows, from the metrics log: one on time each, once a last record has closed them all."""
    base = shared_path(spark, "panes")
    events = _events(spark, sf_dir).where("copy = 0")
    end = events.agg(F.max("event_ts").alias("t"), F.max("deliver_at").alias("d"))
    later = lambda c: F.timestamp_micros(F.unix_micros(c) + 4 * 86_400_000_000)
    last = end.select(later("t").alias("event_ts"), later("d").alias("deliver_at"), F.lit("cierre").alias("event_key"))
    blank = {n: F.lit("cierre") for n in PAYLOAD_STRINGS if n != "contact_id"} | {n: F.lit(None).cast("double") for n in PAYLOAD_NUMBERS}
    closing = replay.log_records(replay.build(last.withColumns(blank).withColumn("contact_id", F.col("event_key")), "contact_queued", "event_key"), DAY)
    records = events_log(spark, sf_dir).select("key", "value", "deliver_at").unionByName(closing.select("key", "value", "deliver_at"))
    log, out = _ordered_log(spark, records, "panes-log"), FileLog(f"{base}/metrics")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        query = pipeline.to_log(log.stream(spark, 1), DAY, out, f"{base}/checkpoint", panes=True)
        pipeline.settle([query], None)
    return changelog.decode(out.batch(spark)).select("aggregate_id", *metrics.QUEUE_METRICS, "transitions", "pane_timing", "pane_index")


def log_to_view(spark, sf_dir):
    """The view kept from the metrics log, a few records a poll."""
    base = shared_path(spark, "polls")
    log = FileLog(f"{base}/metrics")
    log.append(changelog.encode(changelog_union(spark, sf_dir), DAY.metrics_topic))
    pipeline.settle([pipeline.log_to_view(log.stream(spark, 1), f"{base}/view", f"{base}/checkpoint")], None)
    return view.ViewStore(f"{base}/view").read(spark).select("aggregate_id", *metrics.QUEUE_METRICS, "transitions")


QUERIES = [
    queue_metrics_day, queue_metrics_hour, agent_state_counts, changelog_union, changelog_records, queue_window_report, contract_errors, dlq_rows,
    topic_routing, dedup_stats, event_id_uuid5, delivery_disorder, late_split, view_latest, view_counters, lifecycle_gaps, transition_breaks,
    causal_breaks, replay_duplicates, replay_shift, replay_corrupt, delivered_records, topic_disorder, compare_reports, simulated_day, summary_by_type,
    dashboard_projection, stream_queue_metrics, stream_panes, log_to_view,
]


def queries() -> dict:
    return {f.__name__: _utc(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from quelora.plans import oracle

    return oracle.sql()
