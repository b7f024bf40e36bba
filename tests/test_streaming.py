import time

import pytest
from helpers import QUEUE, connected, ended, queued, records
from pyspark.sql import functions as F

from quelora.operators import changelog, view
from quelora.operators.view import ViewStore
from quelora.schemas import CHANGELOG
from quelora.settings import Settings
from quelora.sources.log import FileLog
from quelora.streaming import pipeline
from quelora.streaming.panes import panes

S = Settings()
KEY = f"queue_metrics|{QUEUE}|2026-07-24T13:00:00Z"


def feed(spark, path, batches):
    """A log with a file for each batch, in order."""
    log = FileLog(str(path))
    for events in batches:
        log.append(records(spark, events).coalesce(1))
        time.sleep(1.1)
    return log.stream(spark, 1)


def test_revisions_accumulate_and_replay_converges(spark, tmp_path):
    batches = [[queued("a", 5), connected("a", 10, 5.0)], [queued("a", 5), queued("b", 20)], [queued("z", 400)], [queued("c", 30)], [queued("d", 31)]]
    stream = feed(spark, tmp_path / "log", batches)
    query = pipeline.to_view(stream, S, str(tmp_path / "view"), str(tmp_path / "ck"))
    query.awaitTermination()
    rows = {r["aggregate_id"]: r for r in ViewStore(str(tmp_path / "view")).read(spark).collect()}
    # 13:06:40 - 300 s is past 13:01: the first window is closed; Spark filters a batch by the watermark of the one
    # before the last, so c still counts and d doesn't
    assert rows[KEY]["offered"] == 3 and rows[KEY]["connected"] == 1 and len(rows) == 2
    again = pipeline.to_view(FileLog(str(tmp_path / "log")).stream(spark, 1), S, str(tmp_path / "view2"), str(tmp_path / "ck2"))
    again.awaitTermination()
    other = {r["aggregate_id"]: r for r in ViewStore(str(tmp_path / "view2")).read(spark).collect()}
    assert other == rows
    # a restart from the checkpoint reads nothing twice
    more = pipeline.to_view(FileLog(str(tmp_path / "log")).stream(spark, 1), S, str(tmp_path / "view"), str(tmp_path / "ck"))
    more.awaitTermination()
    assert {r["aggregate_id"]: r["offered"] for r in ViewStore(str(tmp_path / "view")).read(spark).collect()} == {k: v["offered"] for k, v in rows.items()}


def test_final_rows_and_dead_letters_reach_their_logs(spark, tmp_path):
    bad = {**queued("x", 6), "event_type": "nope"}
    stream = feed(spark, tmp_path / "log", [[queued("a", 5), bad], [ended("a", 50, 1.0)], [queued("z", 500)]])
    out, dead = FileLog(str(tmp_path / "out")), FileLog(str(tmp_path / "dlq"))
    pipeline.to_log(stream, S, out, str(tmp_path / "c1")).awaitTermination()
    pipeline.dead_letters_to_log(FileLog(str(tmp_path / "log")).stream(spark), S, dead, str(tmp_path / "c2")).awaitTermination()
    texts = [bytes(r["value"]).decode() for r in out.batch(spark).collect()]
    assert len(texts) == 1 and KEY in texts[0] and '"offered":1' in texts[0]
    assert dead.batch(spark).count() == 1


@pytest.mark.parametrize("early", [0, 5])
def test_panes(spark, tmp_path, early):
    settings = Settings(early_firing_seconds=early)
    batches = [
        [queued("a", 5), connected("a", 10, 5.0)],
        [queued("a", 5), queued("b", 20)],
        [queued("z", 70)],  # the window ends
        [queued("y", 80)],
        [queued("c", 30), queued("c", 30)],  # late, inside the horizon
        [queued("c", 30)],  # a late duplicate is no revision
        [queued("x", 420)],  # past the horizon
        [queued("w", 421)],
        [queued("d", 40)],  # too late
        [queued("v", 430)],
    ]
    events = pipeline.events(feed(spark, tmp_path / "log", batches), settings)
    rows: list = []
    query = (
        panes(events, settings)
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .foreachBatch(lambda df, k: rows.extend((k, r) for r in df.collect()))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    mine = [r for _, r in rows if r["aggregate_id"] == KEY]
    timings = [r["pane_timing"] for r in mine]
    assert timings == (["EARLY", "EARLY"] if early else []) + ["ON_TIME", "LATE"]
    assert [r["pane_index"] for r in mine] == list(range(len(mine)))
    assert [r["offered"] for r in mine] == ([1, 2] if early else []) + [2, 3]
    assert mine[0]["is_first"] and not any(r["is_first"] for r in mine[1:])


@pytest.mark.parametrize("early", [0, 5])
def test_rows_of_the_batch_that_first_sees_the_window_end(spark, tmp_path, early):
    """The on-time pane is due before them, once, and they are late."""
    settings = Settings(early_firing_seconds=early)
    batches = [[queued("a", 5), connected("a", 10, 5.0)], [queued("z", 70)], [queued("b", 20)], [queued("y", 80)], [queued("x", 90)]]
    out = FileLog(str(tmp_path / "out"))
    query = pipeline.to_log(feed(spark, tmp_path / "log", batches), settings, out, str(tmp_path / "ck"), panes=True)
    pipeline.settle([query], None)
    rows = sorted((r["pane_index"], r["pane_timing"], r["offered"]) for r in changelog.decode(out.batch(spark)).where(F.col("aggregate_id") == KEY).collect())
    assert [r[1:] for r in rows] == ([("EARLY", 1)] if early else []) + [("ON_TIME", 1), ("LATE", 2)]
    assert [r[0] for r in rows] == list(range(len(rows)))


def test_view_follows_the_metrics_log(spark, tmp_path):
    """Polls of a file each; of equal panes the later arrival wins, as offsets say."""
    log = FileLog(str(tmp_path / "metrics"))
    row = lambda pane, offered: {"aggregate_id": "a", "dimension_id": "q", "pane_index": pane, "offered": offered, "window_start": "2026-01-01T00:00:00Z", "metric_type": "queue_metrics"}
    for pane, offered in [(0, 1), (2, 3), (1, 2), (2, 9)]:
        log.append(changelog.encode(spark.createDataFrame([row(pane, offered)], CHANGELOG), "m").coalesce(1))
        time.sleep(1.1)
    query = pipeline.log_to_view(log.stream(spark, 1), str(tmp_path / "view"), str(tmp_path / "ck"))
    pipeline.settle([query], 60, quiet=30)
    assert [(r["pane_index"], r["offered"]) for r in ViewStore(str(tmp_path / "view")).read(spark).collect()] == [(2, 9)]
    assert log.batch(spark).select("offset").distinct().count() == 4 and log.batch(spark).where("partition IS NULL").count() == 0
    assert view.latest(changelog.decode(log.batch(spark)), ["offset"]).first()["offered"] == 9


def test_settle_stops_what_still_runs(spark, tmp_path):
    feed(spark, tmp_path / "log", [[queued("a", 5)]])
    queries = [pipeline.dead_letters_to_log(FileLog(str(tmp_path / "log")).stream(spark), S, FileLog(str(tmp_path / f"d{k}")), str(tmp_path / f"c{k}"), False) for k in range(2)]
    began = time.monotonic()
    pipeline.settle(queries, 4)
    assert time.monotonic() - began < 20 and not any(q.isActive for q in queries)
    assert pipeline.dropped_rows(queries[0]) == 0
