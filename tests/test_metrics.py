import random

from helpers import QUEUE, agent, connected, ended, queued, reckon, records
from pyspark.sql import functions as F

from quelora.operators import changelog, checks, contract, metrics
from quelora.schemas import QUEUE_METRICS
from quelora.settings import Settings

S = Settings()


def found(spark, events, settings=S, **kw):
    rows = changelog.revisions(metrics.window_metrics(contract.valid(contract.validate(records(spark, events))), settings, **kw)).collect()
    return {r["aggregate_id"]: r.asDict() for r in rows}


def test_golden_row(spark):
    events = [queued("ct-1", 5), connected("ct-1", 10, 5.0), ended("ct-1", 50, 5.0), queued("ct-2", 20), ended("ct-2", 40, 18.0, "abandoned")]
    row = found(spark, events)[f"queue_metrics|{QUEUE}|2026-07-24T13:00:00Z"]
    expected = dict(zip(QUEUE_METRICS, (2, 1, 1, 0, 1, 1, 1.0, 0.5, 11.5, 18.0, 18.0, 120.0), strict=True))
    assert {k: row[k] for k in QUEUE_METRICS} == expected
    assert (row["window_end"], row["pane_index"], row["pane_timing"], row["transitions"]) == ("2026-07-24T13:01:00Z", 0, "ON_TIME", None)


def test_windows_queues_and_duplicates(spark):
    twice = [queued("a", 5, event_id="x"), connected("a", 10, 1.0)] * 2
    elsewhere = [queued("b", 6, "ventas", event_id="x"), queued("c", 70, event_id="x")]
    rows = found(spark, twice + elsewhere)
    offered = {k.split("|", 1)[1]: v["offered"] for k, v in rows.items()}
    assert offered == {f"{QUEUE}|2026-07-24T13:00:00Z": 1, "ventas|2026-07-24T13:00:00Z": 1, f"{QUEUE}|2026-07-24T13:01:00Z": 1}


def test_agent_states_join_the_changelog(spark):
    rows = found(spark, [agent("a", 5, "busy"), agent("b", 6, "busy"), agent("a", 40, "wrapup"), queued("c", 5)])
    counts = {v["dimension_id"]: v["transitions"] for v in rows.values() if v["metric_type"] == "agent_state_counts"}
    assert counts == {"busy": 2, "wrapup": 1} and len(rows) == 3


def test_differential(spark):
    rng, events = random.Random(4), []
    for k in range(400):
        c, at, queue = f"c{k}", rng.uniform(0, 600), rng.choice(["q1", "q2", "q3"])
        wait = round(rng.uniform(0, 60), 3)
        events.append(queued(c, at, queue))
        if rng.random() < 0.7:
            events += [connected(c, at + wait, wait, queue), ended(c, at + wait + 30, wait, rng.choice(["resolved", "transferred", "other"]), queue)]
        else:
            events.append(ended(c, at + wait, wait, "abandoned", queue))
    events += rng.sample(events, 50)
    rng.shuffle(events)
    expected = reckon(events)
    rows = found(spark, events, exact_rounding=True)
    got = {(r["dimension_id"], r["window_start"]): {k: r[k] for k in QUEUE_METRICS} for r in rows.values()}
    import datetime as dt

    named = {(q, dt.datetime.fromtimestamp(w, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")): v for (q, w), v in expected.items()}
    assert got == named


def test_first_arrival_can_be_chosen(spark):
    df = contract.valid(contract.validate(records(spark, [queued("a", 5, event_id="x"), queued("b", 6, event_id="x")])))
    chosen = metrics.deduplicate(metrics.keyed(df, S), ["event_ts"])
    assert [r["contact_id"] for r in chosen.collect()] == ["a"]
    assert metrics.dedup_summary(df, S).first().asDict() == {"accepted": 1, "duplicates": 1, "windows": 1}


def test_empty(spark):
    assert found(spark, []) == {}


def test_changelog_round_trip(spark):
    df = changelog.revisions(metrics.window_metrics(contract.valid(contract.validate(records(spark, [queued("a", 5), agent("b", 6, "busy")]))), S))
    records_out = changelog.encode(df, "t")
    texts = [bytes(r["value"]).decode() for r in records_out.collect()]
    assert all(("transitions" in t) != ("offered" in t) for t in texts)
    back = changelog.decode(records_out.unionByName(spark.createDataFrame([(b"k", b"no json", "t"), (b"k", b"{}", "t")], records_out.schema)))
    assert sorted(map(str, back.drop("key", "topic").collect())) == sorted(map(str, df.collect()))


def test_checks(spark):
    events = contract.valid(contract.validate(records(spark, [queued("a", 5), ended("a", 9, 1.0), queued("b", 5), ended("c", 7, 1.0), connected("c", 8, 1.0)])))
    assert {(r.contact_id, r.gap) for r in checks.lifecycle_gaps(events).collect()} == {("b", "queued_not_ended"), ("c", "ended_not_queued")}
    assert [r.contact_id for r in checks.causal_breaks(events, F.col("event_ts")).collect()] == ["c"]
    assert {r["name"]: r["n"] for r in checks.summary(events).collect()}["contacts"] == 3
    timed = spark.range(10_000).select(
        F.timestamp_seconds(F.col("id") * 10).alias("deliver_at"), F.timestamp_seconds(F.col("id") * 10 - F.when(F.col("id") % 7 == 0, 60).otherwise(0)).alias("event_ts"), F.col("id").cast("string").alias("event_id")
    )
    assert checks.disorder(timed).first().asDict() == {"events": 10_000, "disordered": len(range(7, 10_000, 7))}
    same = metrics.window_metrics(events, S).withColumn("w", F.col("window.start"))
    assert checks.compare(same, same, ["dimension_id", "w"], ["offered"]).count() == 0
