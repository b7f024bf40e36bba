"""Run settings with environment overrides, and topic routing."""

from __future__ import annotations

import dataclasses
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic names and environment variables of the event contract.
CONTACTS_TOPIC = "cc.contacts.raw.v1"
AGENT_STATE_TOPIC = "cc.agent-state.raw.v1"
METRICS_TOPIC = "cc.queue-metrics.1m.v1"
DLQ_TOPIC = "cc.events.dlq.v1"
ENVIRONMENT = {
    "kafka_bootstrap_servers": "KAFKA_BOOTSTRAP_SERVERS",
    "contacts_topic": "KAFKA_CONTACTS_TOPIC",
    "agent_state_topic": "KAFKA_AGENT_STATE_TOPIC",
    "metrics_topic": "KAFKA_METRICS_TOPIC",
    "dlq_topic": "KAFKA_DLQ_TOPIC",
    "window_seconds": "WINDOW_SECONDS",
    "allowed_lateness_seconds": "ALLOWED_LATENESS_SECONDS",
    "early_firing_seconds": "EARLY_FIRING_SECONDS",
    "service_level_seconds": "SERVICE_LEVEL_SECONDS",
}


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a run can vary."""

    kafka_bootstrap_servers: str = "kafka:9092"
    contacts_topic: str = CONTACTS_TOPIC
    agent_state_topic: str = AGENT_STATE_TOPIC
    metrics_topic: str = METRICS_TOPIC
    dlq_topic: str = DLQ_TOPIC
    window_seconds: int = 60
    allowed_lateness_seconds: int = 300
    early_firing_seconds: int = 0
    service_level_seconds: int = 20

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults, overridden by the variables of ENVIRONMENT that are set."""
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        return cls(**{name: kinds[name](os.environ[var]) for name, var in ENVIRONMENT.items() if var in os.environ})

    def topic(self, event_type: Column) -> Column:
        """Topic that an event goes to."""
        return F.when(event_type == "agent_state_changed", self.agent_state_topic).otherwise(self.contacts_topic)
