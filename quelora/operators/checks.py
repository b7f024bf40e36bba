"""Structural checks of event streams: order, life cycles, transitions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quelora.schemas import AGENT_TYPE, CONTACT_TYPES

BUCKET_SECONDS = 3600


def disorder(events: DataFrame, at: str = "deliver_at", time: str = "event_ts", tie: str = "event_id") -> DataFrame:
    """One row: events, and how many are earlier than the one delivered before them.

    Rows are compared inside buckets of delivery time; only each bucket's last event time meets the next bucket, in a
    table with a row for each hour, so there is no global sort of the events."""
    bucket = F.floor(F.unix_micros(F.col(at)) / (BUCKET_SECONDS * 1_000_000)).alias("bucket")
    rows = events.select(bucket, F.col(at).alias("at"), F.col(time).alias("ts"), F.col(tie).alias("tie"))
    inside = Window.partitionBy("bucket").orderBy("at", "tie")
    marked = rows.withColumn("before", F.lag("ts").over(inside))
    by_bucket = marked.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ts") < F.col("before")).alias("down"),
        F.min_by("ts", F.struct("at", "tie")).alias("first"),
        F.max_by("ts", F.struct("at", "tie")).alias("last"),
    )
    across = by_bucket.withColumn("before", F.lag("last").over(Window.orderBy("bucket")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return across.agg(zero(F.sum("n")).alias("events"), (zero(F.sum("down")) + F.count_if(F.col("first") < F.col("before"))).alias("disordered"))


def lifecycle_gaps(events: DataFrame) -> DataFrame:
    """(contact_id, gap) of contacts that were queued and never ended, ended and never queued, or connected and never
    ended: one aggregation by contact."""
    kinds = events.where(F.col("event_type").isin(*CONTACT_TYPES)).groupBy(F.col("event_key").alias("contact_id"))
    has = lambda k: F.bool_or(F.col("event_type") == k)
    found = kinds.agg(*(has(k).alias(k) for k in CONTACT_TYPES))
    gaps = F.array_compact(F.array(
        F.when(F.col("contact_queued") & ~F.col("contact_ended"), F.lit("queued_not_ended")),
        F.when(F.col("contact_ended") & ~F.col("contact_queued"), F.lit("ended_not_queued")),
        F.when(F.col("contact_connected") & ~F.col("contact_ended"), F.lit("connected_not_ended")),
    ))
    return found.select("contact_id", F.explode(gaps).alias("gap"))


def transition_breaks(events: DataFrame, order: list[str], start: str = "logged_out") -> DataFrame:
    """Agent transitions whose from_state isn't the state that the agent's last one led to."""
    chain = Window.partitionBy("agent_id").orderBy(*order)
    agents = events.where(F.col("event_type") == AGENT_TYPE)
    linked = agents.withColumn("expected_state", F.lag("to_state", 1, start).over(chain))
    return linked.where(~F.col("from_state").eqNullSafe(F.col("expected_state"))).select("event_id", "agent_id", "from_state", "expected_state")


def causal_breaks(events: DataFrame, order: Column) -> DataFrame:
    """Contacts whose events don't come as queued, connected, ended."""
    when = lambda k: F.min(F.when(F.col("event_type") == k, order))
    found = events.groupBy(F.col("event_key").alias("contact_id")).agg(*(when(k).alias(k) for k in CONTACT_TYPES))
    return found.where("contact_connected < contact_queued OR contact_ended < contact_connected OR contact_ended < contact_queued").select("contact_id")


def summary(events: DataFrame) -> DataFrame:
    """(name, n): events of each type, distinct contacts and the total; one pass and one shuffle by contact."""
    kinds = (*CONTACT_TYPES, AGENT_TYPE)
    contact = F.when(F.col("event_type").isin(*CONTACT_TYPES), F.col("event_key"))
    by_contact = events.groupBy(contact.alias("contact")).agg(F.count("*").alias("total"), *(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = by_contact.agg(F.count("contact").alias("contacts"), zero("total").alias("total"), *(zero(k).alias(k) for k in kinds))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in (*kinds, "contacts", "total")))
    return one.select(F.inline(F.filter(rows, lambda r: r["name"].isin("contacts", "total") | (r["n"] > 0))))


def lateness(events: DataFrame, window_seconds: int, lateness_seconds: int, at: str = "deliver_at", time: str = "event_ts", tie: str = "event_id") -> DataFrame:
    """(outcome, n): on_time, late and dropped events, by whether the highest event time delivered before an event has
    passed its window's end, and the lateness after it. Rows are ordered inside buckets of delivery time; a bucket takes
    over the highest time of all buckets before it from a table with a row for each hour."""
    end = F.window(time, f"{window_seconds} seconds").end
    bucket = F.floor(F.unix_micros(F.col(at)) / (BUCKET_SECONDS * 1_000_000))
    rows = events.select(bucket.alias("bucket"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(time).alias("ts"), F.unix_micros(end).alias("end"))
    inside = Window.partitionBy("bucket").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("bucket").agg(F.max("ts").alias("top")).select("bucket", F.max("top").over(before).alias("carried"))
    seen = rows.withColumn("seen", F.max("ts").over(inside)).join(tops, "bucket")
    high = F.unix_micros(F.greatest("seen", "carried"))
    past = lambda seconds: F.coalesce(high >= F.col("end") + seconds * 1_000_000, F.lit(False))
    outcome = F.when(past(lateness_seconds), "dropped").when(past(0), "late").otherwise("on_time")
    return seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def topic_disorder(events: DataFrame, topic: Column, at: str = "deliver_at", time: str = "event_ts", tie: str = "event_id") -> DataFrame:
    """(topic, events, disordered): how many events of a topic are earlier than the one before them there."""
    rows = events.withColumns({"topic": topic, "bucket": F.floor(F.unix_micros(F.col(at)) / (BUCKET_SECONDS * 1_000_000))})
    inside = Window.partitionBy("topic", "bucket").orderBy(at, tie)
    marked = rows.withColumn("before", F.lag(time).over(inside))
    by_bucket = marked.groupBy("topic", "bucket").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(time) < F.col("before")).alias("down"),
        F.min_by(time, F.struct(at, tie)).alias("first"),
        F.max_by(time, F.struct(at, tie)).alias("last"),
    )
    across = by_bucket.withColumn("before", F.lag("last").over(Window.partitionBy("topic").orderBy("bucket")))
    return across.groupBy("topic").agg(F.sum("n").alias("events"), (F.sum("down") + F.count_if(F.col("first") < F.col("before"))).alias("disordered"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of two tables that differ in a field, or that one lacks."""
    a = left.select(*keys, F.struct(*fields).alias("left"))
    b = right.select(*keys, F.struct(*fields).alias("right"))
    return a.join(b, keys, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
