import pytest
from pyspark.sql import functions as F

from quelora.operators import checks, contract, replay, view
from quelora.schemas import CHANGELOG_FIELDS
from quelora.settings import Settings
from quelora.sources.log import FileLog, conform
from quelora.sources.simulator import QUEUES, SimulatorSource, simulate


@pytest.mark.parametrize(
    ("panes", "last", "replaced", "ignored"),
    [([0, 1, 2], 2, 2, 0), ([0, 2, 1], 2, 1, 1), ([1, 1], 1, 1, 0), ([None, 0], 0, 1, 0)],
)
def test_upsert(spark, panes, last, replaced, ignored):
    df = spark.createDataFrame([("a", p, k) for k, p in enumerate(panes)] + [("b", 0, 9), (None, 5, 10)], "aggregate_id string, pane_index int, offset bigint")
    rows = {r["aggregate_id"]: r for r in view.latest(df, ["offset"]).collect()}
    assert rows["a"]["pane_index"] == last and set(rows) == {"a", "b"}
    if panes == [1, 1]:
        assert rows["a"]["offset"] == 1
    assert view.counters(df, ["offset"]).first().asDict() == {"messages_seen": len(panes) + 1, "aggregates": 2, "revisions_replaced": replaced, "out_of_order_ignored": ignored}


def test_store_is_idempotent(spark, tmp_path):
    fields = ", ".join(f"{n} {k}" for n, k in CHANGELOG_FIELDS.items())
    row = lambda i, pane: tuple({"aggregate_id": i, "pane_index": pane, "window_start": "2026-01-01T00:00:00Z", "metric_type": "queue_metrics"}.get(c) for c in CHANGELOG_FIELDS)
    store = view.ViewStore(str(tmp_path / "view"))
    for batch, rows in enumerate([[row("a", 0)], [row("a", 1), row("b", 1)], [row("a", 0)]]):
        for _ in range(2):  # a batch may run again
            store(spark.createDataFrame(rows, fields), batch)
    assert {r["aggregate_id"]: r["pane_index"] for r in store.read(spark).collect()} == {"a": 1, "b": 1}
    assert "queue metrics"[:12] in view.render(store.read(spark))


def test_simulator(spark):
    spark.dataSource.register(SimulatorSource)
    load = lambda seed: spark.read.format("queue_simulator").options(start="2026-09-28T14:00:00Z", minutes=20, seed=seed).load()
    day = load(11).persist()
    assert day.exceptAll(load(11)).count() == 0 and day.select("event_id").distinct().count() == day.count()
    assert day.exceptAll(load(12)).count() > 0
    assert checks.lifecycle_gaps(day).count() == 0
    assert checks.transition_breaks(day, ["seq"]).count() == 0
    order = F.struct("event_ts", "seq")
    assert checks.causal_breaks(day, order).count() == 0
    records = replay.log_records(day, Settings())
    assert contract.validate(records).where("rule IS NOT NULL").count() == 0
    waits = day.where("event_type = 'contact_connected'").agg(F.max("wait_seconds")).first()[0]
    assert waits < max(q.patience_seconds for q in QUEUES)
    day.unpersist()


def test_simulated_agents_serve_one_caller_at_a_time():
    import datetime as dt

    busy: dict = {}
    for e in simulate(QUEUES[0], dt.datetime(2026, 1, 1, tzinfo=dt.UTC), 120, 3):
        if e["event_type"] == "contact_connected":
            assert not busy.get(e["agent_id"])
            busy[e["agent_id"]] = True
        elif e["event_type"] == "agent_state_changed" and e["to_state"] == "ready":
            busy[e["agent_id"]] = False


def test_replay(spark, tmp_path):
    spark.dataSource.register(SimulatorSource)
    day = spark.read.format("queue_simulator").options(start="2026-09-28T14:00:00Z", minutes=20).load()
    moved = replay.shift(day, "2027-01-01T00:00:00Z")
    assert str(moved.agg(F.min("event_ts")).first()[0]) == "2027-01-01 00:00:00"
    timed = replay.schedule(moved, 45.0)
    late = timed.agg(F.max(F.unix_micros("deliver_at") - F.unix_micros("event_ts"))).first()[0]
    assert 0 < late < 45_000_000 and checks.disorder(timed).first()["disordered"] > 0
    assert checks.disorder(replay.schedule(moved, 0.0)).first()["disordered"] == 0
    with pytest.raises(ValueError):
        replay.schedule(moved, -1.0)
    copied = replay.copies(timed, 0.2, 0.1)
    n = replay.counts(copied).first()
    assert n["events"] == day.count() + n["duplicates"] + n["invalid"] and n["duplicates"] > 20 and n["invalid"] > 5
    records = replay.log_records(copied, Settings())
    checked = contract.validate(records)
    assert {r["rule"]: r["n"] for r in checked.groupBy("rule").agg(F.count("*").alias("n")).collect()} == {None: n["events"] - n["invalid"], 7: n["invalid"]}
    log = FileLog(str(tmp_path / "log"))
    log.append(records)
    assert log.batch(spark).count() == n["events"] and log.batch(spark, 3).count() == 3
    assert conform(records).columns == ["key", "value", "topic", "partition", "offset", "timestamp", "headers"]


def test_settings(monkeypatch):
    monkeypatch.setenv("WINDOW_SECONDS", "30")
    assert Settings.from_env().window_seconds == 30 and Settings().window_seconds == 60


def test_built_events(spark):
    rows = spark.createDataFrame([("c1", "q", "voice", "normal", None), ("c2", "q", "chat", "alta", "given")], "contact_id string, queue_id string, channel string, priority string, event_id string")
    timed = rows.withColumns({"event_ts": F.timestamp_seconds(F.lit(5)), "event_key": F.col("contact_id")})
    made = {r["event_key"]: r for r in replay.build(timed, "contact_queued", "contact_id", "channel").collect()}
    assert made["c2"]["event_id"] == "given" and len(made["c1"]["event_id"]) == 36 and made["c1"]["event_time"] == "1970-01-01T00:00:05.000Z"
    with pytest.raises(ValueError):
        replay.build(timed, "contact_paused")
    with pytest.raises(ValueError):
        replay.build(timed, "contact_ended")


def test_pace(spark):
    import threading

    rows = spark.createDataFrame([(k, k) for k in range(10)], "id long, s long").select("id", F.timestamp_seconds("s").alias("deliver_at"))
    parts: list = []
    assert replay.pace(rows, lambda p: parts.append(sorted(r["id"] for r in p.collect())), speed=4.0, step_seconds=0.5) == len(parts) > 1
    assert sum(parts, []) == list(range(10))
    stopped = threading.Event()
    stopped.set()
    assert replay.pace(rows, parts.append, stop=stopped) == 0


def test_publish_counts(spark, tmp_path):
    from quelora.sources.log import Delivery, publish

    records = spark.createDataFrame([(b"k", b"v")] * 7, "key binary, value binary")
    assert publish(FileLog(str(tmp_path / "log")), records) == Delivery(7, 7, 0)
    assert publish(FileLog("nosuch://log"), records) == Delivery(7, 0, 7)


def test_view_buckets_drop_old_versions(spark, tmp_path):
    fields = ", ".join(f"{n} {k}" for n, k in CHANGELOG_FIELDS.items())
    row = lambda i, pane: tuple({"aggregate_id": i, "pane_index": pane, "window_start": "2026-01-01T00:00:00Z"}.get(c) for c in CHANGELOG_FIELDS)
    store = view.ViewStore(str(tmp_path / "view"))
    for batch in range(6):
        store(spark.createDataFrame([row("a", batch)] + ([row(f"x{k}", 0) for k in range(40)] if not batch else []), fields), batch)
    found = {r["aggregate_id"]: r["pane_index"] for r in store.read(spark).collect()}
    assert found["a"] == 5 and len(found) == 41
    versions = sorted(p.name for p in (tmp_path / "view" / "data").iterdir() if p.is_dir())
    assert versions == ["v=0", "v=4", "v=5"]
    assert "(3 of 41 aggregates)" in view.render(store.read(spark), 3) and view.render(store.read(spark)).count("\n") == 41


def test_queries_leave_the_time_zone(spark):
    from quelora.plans import registry

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = registry.queries()["queue_metrics_day"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
        rows = sorted(map(str, found.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows == sorted(map(str, registry.queries()["queue_metrics_day"](spark, "/root/testdata/sf0.001").collect()))
