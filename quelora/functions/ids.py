"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of event ids.
EVENT_NAMESPACE = "9f2c4b16-7d3a-4e58-b0c1-5a8e6d21f340"


def uuid5(name: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    """Name-based UUID of version 5, from built-in functions only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda start, size: F.substring(digest, start, size)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def event_id(*parts: Column) -> Column:
    """Id of an event from its parts."""
    return uuid5(F.concat_ws("|", *parts))
