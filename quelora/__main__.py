"""Command line: ``python -m quelora simulate | run | follow | view`` on a file log or on Kafka."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quelora.operators import changelog, checks, replay, view
from quelora.settings import Settings
from quelora.sources.log import Delivery, FileLog, KafkaLog, publish
from quelora.sources.simulator import SimulatorSource, describe
from quelora.streaming import pipeline
from quelora.streaming.panes import ROCKSDB


def session() -> SparkSession:
    """A session in UTC; cluster settings come from spark-submit."""
    return SparkSession.builder.appName("quelora").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def log_of(args: argparse.Namespace, settings: Settings, *topics: str):
    return FileLog(f"{args.log}/{topics[0]}") if args.log else KafkaLog(settings.kafka_bootstrap_servers, topics)


def simulate(args: argparse.Namespace) -> dict:
    """Publishes a simulated day with delays, duplicates and broken copies; gives what it published."""
    spark, settings = session(), Settings.from_env()
    spark.dataSource.register(SimulatorSource)
    day = spark.read.format("queue_simulator").options(start=args.start, minutes=args.minutes, seed=args.seed).load()
    timed = replay.schedule(day, args.tardiness_seconds, args.seed)
    copied = replay.copies(timed, args.duplicate_rate, args.invalid_rate, args.seed).persist()
    records = replay.log_records(copied, settings)
    log = FileLog(f"{args.log}/raw") if args.log else log_of(args, settings, settings.contacts_topic, settings.agent_state_topic)
    done: list[Delivery] = []
    if args.speed:
        replay.pace(records, lambda part: done.append(publish(log, part)), args.speed)
    else:
        done.append(publish(log, records.repartitionByRange("deliver_at").sortWithinPartitions("deliver_at")))
    found = replay.counts(copied).first().asDict() | checks.disorder(timed).select("disordered").first().asDict()
    found |= {"generated": {r["name"]: r["n"] for r in checks.summary(day).collect()}, "scenario": describe(args.start, args.minutes, args.seed)}
    found["delivery"] = {n: sum(getattr(d, n) for d in done) for n in ("published", "delivered", "failed")}
    copied.unpersist()
    return found


def run(args: argparse.Namespace) -> dict:
    """Runs the metrics and dead-letter queries until what there is has been read, or for --seconds."""
    spark, settings = session(), Settings.from_env()
    source = FileLog(f"{args.log}/raw") if args.log else log_of(args, settings, settings.contacts_topic, settings.agent_state_topic)
    now = args.seconds is None and args.quiet is None
    out, dead = log_of(args, settings, settings.metrics_topic), log_of(args, settings, settings.dlq_topic)
    if args.panes:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    queries = [
        pipeline.to_view(source.stream(spark, args.poll), settings, f"{args.state}/view", f"{args.state}/checkpoint-view", now),
        pipeline.to_log(source.stream(spark, args.poll), settings, out, f"{args.state}/checkpoint-metrics", now, args.panes),
        pipeline.dead_letters_to_log(source.stream(spark, args.poll), settings, dead, f"{args.state}/checkpoint-dlq", now),
    ]
    pipeline.settle(queries, args.seconds, args.quiet)
    return {"batches": [q.lastProgress["batchId"] if q.lastProgress else None for q in queries], "dropped_late": [pipeline.dropped_rows(q) for q in queries]}


def follow(args: argparse.Namespace) -> dict:
    """Keeps a view from the metrics log alone, until what there is has been read, or for --seconds, or until --quiet."""
    spark, settings = session(), Settings.from_env()
    now = args.seconds is None and args.quiet is None
    records = log_of(args, settings, settings.metrics_topic).stream(spark, args.poll)
    query = pipeline.log_to_view(records, f"{args.state}/followed", f"{args.state}/checkpoint-followed", now)
    pipeline.settle([query], args.seconds, args.quiet)
    return view.counters(changelog.decode(log_of(args, settings, settings.metrics_topic).batch(spark)), ["offset"]).first().asDict()


def show(args: argparse.Namespace) -> None:
    """Prints the view: its newest snapshot, or that of a changelog log read from its start."""
    spark, settings = session(), Settings.from_env()
    found = view.ViewStore(f"{args.state}/view").read(spark) if args.state else None
    if found is None:
        changes = changelog.decode(log_of(args, settings, settings.metrics_topic).batch(spark))
        found = view.latest(changes, ["offset"])
    print(view.render(found, args.rows))


def main() -> None:
    parser = argparse.ArgumentParser(prog="quelora", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_text in (("simulate", simulate.__doc__), ("run", run.__doc__), ("follow", follow.__doc__), ("view", show.__doc__)):
        sub = commands.add_parser(name, help=help_text)
        sub.add_argument("--log", help="folder of a file log; Kafka without it")
        if name == "simulate":
            sub.add_argument("--start", default="2026-01-01T00:00:00Z")
            sub.add_argument("--minutes", type=int, default=30)
            sub.add_argument("--seed", type=int, default=7)
            sub.add_argument("--duplicate-rate", type=float, default=0.02)
            sub.add_argument("--invalid-rate", type=float, default=0.0)
            sub.add_argument("--tardiness-seconds", type=float, default=45.0)
            sub.add_argument("--speed", type=float, help="publish as delivery times come, by a clock so many times as fast; at once without it")
        else:
            sub.add_argument("--state", required=name in ("run", "follow"), help="folder of the view and the checkpoints")
        if name in ("run", "follow"):
            sub.add_argument("--seconds", type=int, help="how long to run; until all is read without it")
            sub.add_argument("--quiet", type=float, help="stop when nothing has come for so many seconds")
            sub.add_argument("--poll", type=int, help="records (of Kafka) or files (of a file log) of a batch, at most")
        if name == "run":
            sub.add_argument("--panes", action="store_true", help="publish early, on-time and late revisions instead of final rows")
        if name == "view":
            sub.add_argument("--rows", type=int, help="how many aggregates to show; all without it")
    args = parser.parse_args()
    result = {"simulate": simulate, "run": run, "follow": follow, "view": show}[args.command](args)
    if result is not None:
        print(json.dumps(result, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
