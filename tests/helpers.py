"""Events of a small call centre, and an independent reckoning of its metrics in plain Python."""

import datetime as dt
import json
import math

BASE = dt.datetime(2026, 7, 24, 13, tzinfo=dt.UTC)
QUEUE = "soporte-n1"


def iso(seconds):
    return (BASE + dt.timedelta(seconds=seconds)).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def event(kind, key, at, event_id=None, **payload):
    return {"event_id": event_id or f"{key}-{kind}-{at}", "event_type": kind, "event_time": iso(at), "schema_version": 1, "key": key, "payload": payload}


def queued(c, at, queue=QUEUE, **kw):
    return event("contact_queued", c, at, contact_id=c, queue_id=queue, channel="voice", priority="normal", **kw)


def connected(c, at, wait, queue=QUEUE, **kw):
    return event("contact_connected", c, at, contact_id=c, queue_id=queue, agent_id="ag-1", wait_seconds=wait, **kw)


def ended(c, at, wait, disposition="resolved", queue=QUEUE, **kw):
    talk = 0.0 if disposition == "abandoned" else 120.0
    return event("contact_ended", c, at, contact_id=c, queue_id=queue, disposition=disposition, wait_seconds=wait, talk_seconds=talk, **kw)


def agent(a, at, to_state, **kw):
    return event("agent_state_changed", a, at, agent_id=a, from_state="ready", to_state=to_state, **kw)


def records(spark, events):
    rows = [(e["key"].encode(), json.dumps(e, sort_keys=True, separators=(",", ":")).encode()) for e in events]
    return spark.createDataFrame(rows, "key binary, value binary")


def reckon(events, seconds=60, level=20):
    """Queue metrics by (queue, window start), event by event."""
    seen, windows = set(), {}
    for e in events:
        if not e["event_type"].startswith("contact"):
            continue
        at = dt.datetime.fromisoformat(e["event_time"].replace("Z", "+00:00")).timestamp()
        key = (e["payload"]["queue_id"], int(at // seconds * seconds))
        if (key, e["event_id"]) in seen:
            continue
        seen.add((key, e["event_id"]))
        w = windows.setdefault(key, {"q": 0, "c": 0, "sl": 0, "waits": [], "left": [], "talk": 0.0})
        p = e["payload"]
        if e["event_type"] == "contact_queued":
            w["q"] += 1
        elif e["event_type"] == "contact_connected":
            w["c"] += 1
            w["sl"] += p["wait_seconds"] <= level
        else:
            w["waits"].append(p["wait_seconds"])
            w["left"].append(p["disposition"])
            w["talk"] += 0 if p["disposition"] == "abandoned" else p["talk_seconds"]
    out = {}
    for key, w in windows.items():
        gone, waits = w["left"].count("abandoned"), sorted(w["waits"])
        out[key] = {
            "offered": w["q"],
            "connected": w["c"],
            "abandoned": gone,
            "transferred": w["left"].count("transferred"),
            "resolved": len(w["left"]) - gone - w["left"].count("transferred"),
            "answered_within_sl": w["sl"],
            "ns20": round(w["sl"] / w["c"], 4) if w["c"] else 0.0,
            "abandon_rate": round(gone / (w["c"] + gone), 4) if w["c"] + gone else 0.0,
            "avg_wait_seconds": round(sum(waits) / len(waits), 3) if waits else 0.0,
            "p90_wait_seconds": waits[math.ceil(0.9 * len(waits)) - 1] if waits else 0.0,
            "max_wait_seconds": max(waits, default=0.0),
            "total_talk_seconds": round(w["talk"], 3),
        }
    return out
