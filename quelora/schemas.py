"""Schemas of the log, the events, the changelog and the dead letters."""

from __future__ import annotations

LOG = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
    "headers array<struct<key:string,value:binary>>"
)

# The event contract.
ENVELOPE = ("event_id", "event_type", "event_time", "schema_version", "key", "payload")
CONTACT_TYPES = ("contact_queued", "contact_connected", "contact_ended")
AGENT_TYPE = "agent_state_changed"
REQUIRED = {
    "contact_queued": ("contact_id", "queue_id", "channel", "priority"),
    "contact_connected": ("contact_id", "queue_id", "agent_id", "wait_seconds"),
    "contact_ended": ("contact_id", "queue_id", "disposition", "wait_seconds", "talk_seconds"),
    "agent_state_changed": ("agent_id", "from_state", "to_state"),
}
SCHEMA_VERSION = 1
PAYLOAD_STRINGS = ("contact_id", "queue_id", "channel", "priority", "skill_required", "agent_id", "disposition", "from_state", "to_state")
PAYLOAD_NUMBERS = ("wait_seconds", "talk_seconds")

QUEUE_METRICS = {
    **dict.fromkeys(("offered", "connected", "abandoned", "transferred", "resolved", "answered_within_sl"), "bigint"),
    **dict.fromkeys(("ns20", "abandon_rate", "avg_wait_seconds", "p90_wait_seconds", "max_wait_seconds", "total_talk_seconds"), "double"),
}
CHANGELOG_HEAD = {
    "schema_version": "int",
    "aggregate_id": "string",
    "metric_type": "string",
    "dimension_id": "string",
    "window_start": "string",
    "window_end": "string",
    "pane_index": "int",
    "pane_timing": "string",
    "is_first": "boolean",
    "is_last": "boolean",
}
CHANGELOG_FIELDS = {**CHANGELOG_HEAD, **QUEUE_METRICS, "transitions": "bigint"}
CHANGELOG = ", ".join(f"{name} {kind}" for name, kind in CHANGELOG_FIELDS.items())
