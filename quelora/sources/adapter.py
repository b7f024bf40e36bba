"""Maps the driver's ``events`` table onto log records of the event contract, broken ones included.

click, view, purchase and signup become the four event types; error keeps its name and so breaks the contract. k is
the number in props: below 3 the record is published twice; from 89 on it is broken, each way by its own value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quelora.functions.iso import format_millis

TYPES = {"click": "contact_queued", "view": "contact_connected", "purchase": "contact_ended", "signup": "agent_state_changed"}
STATES = ["logged_in", "ready", "busy", "wrapup"]


def _spread(raw: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, as a small one of a single row group, is dealt out once; larger ones
    stay as they are."""
    cores = raw.sparkSession.sparkContext.defaultParallelism
    return raw.repartition(cores) if raw.rdd.getNumPartitions() < cores else raw


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with key, value, topic-free log columns, deliver_at (event time plus k seconds) and copy (0 or 1)."""
    raw = _spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")))
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    kind = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in TYPES.items()), F.col("event_type"))
    df = raw.select(F.col("event_id").cast("string").alias("id"), ts.alias("ts"), user.alias("user"), kind.alias("kind"), F.col("value").cast("decimal(18,3)").alias("v"), k.alias("k"))
    contact = F.concat(F.lit("c"), F.col("user").cast("string"))
    agent = F.concat(F.lit("a"), F.col("user").cast("string"))
    key = F.when(F.col("kind") == "agent_state_changed", agent).otherwise(contact)
    state = lambda n: F.element_at(F.array(*map(F.lit, STATES)), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    is_kind = lambda *names: F.col("kind").isin(*names)
    queue = F.concat(F.lit("q"), F.pmod("user", F.lit(4)).cast("string"))
    payload = F.struct(
        F.when(is_kind("contact_connected", "agent_state_changed"), agent).alias("agent_id"),
        F.when(is_kind("contact_queued"), F.lit("voice")).alias("channel"),
        F.when(~is_kind("agent_state_changed"), F.when(F.col("k") == 93, "other").otherwise(contact)).alias("contact_id"),
        F.when(is_kind("contact_ended"), F.element_at(F.array(*map(F.lit, ["abandoned", "transferred", "resolved"])), (F.col("k") % 3 + 1).cast("int"))).alias("disposition"),
        F.when(is_kind("agent_state_changed"), state(F.col("k") + 3)).alias("from_state"),
        F.when(is_kind("contact_queued"), F.lit("normal")).alias("priority"),
        F.when(~is_kind("agent_state_changed") & (F.col("k") != 91), queue).alias("queue_id"),
        F.when(is_kind("contact_ended"), F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("v") * 2)).cast("decimal(18,3)").alias("talk_seconds"),
        F.when(is_kind("agent_state_changed") & (F.col("k") != 91), state(F.col("k"))).alias("to_state"),
        F.when(is_kind("contact_connected", "contact_ended"), F.col("v")).alias("wait_seconds"),
    )
    time = F.when(F.col("k") == 92, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(format_millis(F.col("ts")))
    body = F.struct(
        F.col("id").alias("event_id"),
        time.alias("event_time"),
        F.col("kind").alias("event_type"),
        F.when(F.col("k") == 96, "").otherwise(key).alias("key"),
        payload.alias("payload"),
        F.when(F.col("k") != 90, F.lit(1)).alias("schema_version"),
    )
    # a column of its own, so that the JSON is written once for each record
    df = df.withColumn("text", F.to_json(body))
    text = (
        F.when(F.col("k") == 95, F.concat(F.lit("{"), F.col("text")))
        .when(F.col("k") == 94, F.lit("[1]"))
        .when(F.col("k") == 97, F.regexp_replace("text", '"event_time":"[^"]*"', '"event_time":5'))
        .when(F.col("k") == 99, F.regexp_replace("text", r'"payload":\{[^}]*\}', '"payload":["x"]'))
        .when(F.col("k") == 89, F.regexp_replace("text", r'"wait_seconds":[-+.0-9E]+', '"wait_seconds":"mucho"'))
        .otherwise(F.col("text"))
    )
    value = text.cast("binary")
    rows = df.select(
        key.cast("binary").alias("key"),
        F.when(F.col("k") == 98, F.concat(F.lit(b"\xff"), value)).otherwise(value).alias("value"),
        F.col("ts").alias("timestamp"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("long") * 1_000_000).alias("deliver_at"),
        F.when(F.col("k") < 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies")
