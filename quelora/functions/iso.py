"""ISO-8601 instants as expressions; the session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, optional time to the minute or finer with . or , before the fraction, optional zone after a time.
GRAMMAR = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"

#: The form that events come in, which one cast reads.
USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO-8601 string, null if it isn't one; without a zone it is UTC. Forms that other parsers take
    (basic, week dates, hours alone) are null."""
    usual = F.when(text.rlike(USUAL), text.try_cast("timestamp"))
    return F.coalesce(usual, _any_form(text))


def _any_form(text: Column) -> Column:
    dotted = F.replace(text, F.lit(","), F.lit("."))
    # a time to the minute gets its seconds, and a zone its colon, so that one cast reads all forms
    whole = F.regexp_replace(dotted, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2}|$)", "$1:00$2")
    zoned = F.regexp_replace(whole, r"([+-]\d{2})(\d{2})$", "$1:$2")
    # a fraction beyond microseconds is cut
    cut = F.regexp_replace(zoned, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(GRAMMAR), F.when(F.length(text) <= 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).otherwise(cut.try_cast("timestamp")))


def format_millis(ts: Column) -> Column:
    """Fixed-width UTC string with milliseconds, truncated."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_seconds(ts: Column) -> Column:
    """UTC string of a whole second, as window bounds are."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
