"""The event contract: validation with reasons, and the typed events of valid records.

The value is parsed once as a variant, which tells a missing field from a null one, and unfolded by two casts to structs of
variants, of the envelope and of the payload. The first rule that fails gives the error. Rules are numbered in the contract's order; besides the contract
itself, a number that isn't one is an error (rule 12), as it would break the aggregates.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.functions.iso import format_millis, parse_iso
from quelora.schemas import AGENT_TYPE, CONTACT_TYPES, ENVELOPE, PAYLOAD_NUMBERS, PAYLOAD_STRINGS, REQUIRED

# The texts of the errors, which name the fields or values at fault.
NOT_UTF8 = "el payload no es UTF-8 válido"
NOT_JSON = "el payload no es JSON válido"
NOT_OBJECT = "el evento debe ser un objeto JSON"
MISSING = "faltan campos obligatorios del sobre: "
BAD_TYPE = "event_type no soportado: "
BAD_PAYLOAD = "payload debe ser un objeto JSON"
MISSING_PAYLOAD = " sin campos obligatorios en payload: "
TIME_NOT_STRING = "event_time debe ser un string ISO-8601"
BAD_TIME = "event_time no es ISO-8601 válido: "
BAD_KEY = "key debe ser un string no vacío"
KEY_MISMATCH = "en los eventos de contacto"
NOT_NUMBER = "payload con campos no numéricos: "


def _unfolded(value: Column, names: tuple[str, ...] | list[str]) -> Column:
    """The fields of an object as variants, all in one look: null where a field is missing, and null as a whole where the
    value is no object."""
    return F.try_variant_get(value, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def _names(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once for each row. A plain projection would be merged into whatever uses its
    columns, filters included, and parse the value anew at each use; the optimizer doesn't look into a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def validate(records: DataFrame) -> DataFrame:
    """Adds kafka_key, payload_text, rule (number of the rule that fails, null if none), error and the event's fields
    to log records (key binary, value binary, ...)."""
    raw = F.coalesce(F.col("value"), F.lit(b"")).cast("string")
    every = (*PAYLOAD_STRINGS, *PAYLOAD_NUMBERS)
    df = _once(records, {"body": F.when(F.is_valid_utf8(raw), F.try_parse_json(raw))})
    df = _once(df, {"envelope": _unfolded(F.col("body"), ENVELOPE)})
    field = lambda n: F.col(f"envelope.{n}")
    string = lambda n: F.when(_kind(field(n)) == "STRING", _text(field(n)))
    parsed = {"payload": _unfolded(field("payload"), every), "type_text": string("event_type"), "time_text": string("event_time"), "key_text": string("key")}
    df = _once(df, parsed)
    inside = lambda n: F.col(f"payload.{n}")
    numbers = {f"p_{n}": F.try_variant_get(inside(n), "$", "double") for n in PAYLOAD_NUMBERS}
    df = _once(df, {"time": parse_iso(F.col("time_text")), "p_contact_id": _text(inside("contact_id")), **numbers})
    payload_fields = {n: F.col("p_contact_id") if n == "contact_id" else _text(inside(n)) for n in PAYLOAD_STRINGS} | {n: F.col(f"p_{n}") for n in PAYLOAD_NUMBERS}
    kind, contact_id = F.col("type_text"), F.col("p_contact_id")
    by_type = lambda f: F.coalesce(*(F.when(kind == t, f(t)) for t in REQUIRED))
    lacking = lambda names, of: F.array_compact(F.array(*(F.when(of(n).isNull(), F.lit(n)) for n in names)))
    required = F.coalesce(*(F.when(kind == t, F.array(*map(F.lit, names))) for t, names in REQUIRED.items()))
    lacks_any = lambda names, of: functools.reduce(operator.or_, (of(n).isNull() for n in names))
    numeric = {t: [n for n in names if n in PAYLOAD_NUMBERS] for t, names in REQUIRED.items()}
    number = lambda n: F.col(f"p_{n}")
    shown = F.coalesce(_quoted(kind), F.when(F.is_variant_null("envelope.event_type"), F.lit("None")), F.to_json("envelope.event_type"))
    same_key = (_kind(inside("contact_id")) == "STRING") & (contact_id == F.col("key_text"))
    text = F.col
    by_type = lambda f: F.coalesce(*(F.when(kind == t, f(t)) for t in REQUIRED))
    rules = [
        (~F.is_valid_utf8(raw), F.lit(NOT_UTF8)),
        (F.col("body").isNull(), F.lit(NOT_JSON)),
        (F.col("envelope").isNull(), F.lit(NOT_OBJECT)),
        (lacks_any(ENVELOPE, field), F.concat(F.lit(MISSING), _names(lacking(ENVELOPE, field)))),
        (F.coalesce(~kind.isin(*REQUIRED), F.lit(True)), F.concat(F.lit(BAD_TYPE), shown)),
        (F.col("payload").isNull(), F.lit(BAD_PAYLOAD)),
        (by_type(lambda t: lacks_any(REQUIRED[t], inside)), F.concat(kind, F.lit(MISSING_PAYLOAD), _names(F.array_intersect(required, lacking(every, inside))))),
        (F.col("time_text").isNull(), F.lit(TIME_NOT_STRING)),
        (F.col("time").isNull(), F.concat(F.lit(BAD_TIME), _quoted(text("time_text")))),
        (F.coalesce(F.col("key_text") == "", F.lit(True)), F.lit(BAD_KEY)),
        (
            kind.isin(*CONTACT_TYPES) & ~F.coalesce(same_key, F.lit(False)),
            F.concat(F.lit("key ("), _quoted(text("key_text")), F.lit(") debe ser el contact_id ("), F.coalesce(_quoted(contact_id), F.lit("None")), F.lit(f") {KEY_MISMATCH}")),
        ),
        (F.coalesce(*(F.when(kind == t, lacks_any(n, number)) for t, n in numeric.items() if n), F.lit(False)), F.concat(F.lit(NOT_NUMBER), _names(F.array_intersect(required, lacking(PAYLOAD_NUMBERS, number))))),
    ]
    df = _once(df, {"rule": F.coalesce(*(F.when(bad, F.lit(k)) for k, (bad, _) in enumerate(rules, 1)))})
    error = F.coalesce(*(F.when(F.col("rule") == k, message) for k, (_, message) in enumerate(rules, 1)))
    fields = {
        "event_id": _text(field("event_id")),
        "event_type": kind,
        "event_time": format_millis(F.col("time")),
        "event_ts": F.col("time"),
        "schema_version": F.try_variant_get(field("schema_version"), "$", "int"),
        "event_key": F.col("key_text"),
        **payload_fields,
    }
    kept = [F.col(c) for c in records.columns if c not in fields]
    texts = [F.make_valid_utf8(F.col("key").cast("string")).alias("kafka_key"), F.make_valid_utf8(raw).alias("payload_text")]
    return df.select(*kept, *texts, "rule", error.alias("error"), *(c.alias(n) for n, c in fields.items()))


def valid(validated: DataFrame) -> DataFrame:
    """Typed events of the records that keep the contract."""
    return validated.where("rule IS NULL").drop("rule", "error")


def dead_letters(validated: DataFrame) -> DataFrame:
    """(error, kafka_key, payload) of the others."""
    return validated.where("rule IS NOT NULL").select("error", "kafka_key", F.col("payload_text").alias("payload"))


def dead_letter_records(letters: DataFrame, topic: str) -> DataFrame:
    """Log records of dead letters; one without a key (or with an empty one) goes under ``sin-clave``."""
    key = F.when(F.coalesce(F.col("kafka_key"), F.lit("")) == "", F.lit("sin-clave")).otherwise(F.col("kafka_key"))
    return letters.select(key.cast("binary").alias("key"), F.to_json(F.struct("error", "kafka_key", "payload")).cast("binary").alias("value"), F.lit(topic).alias("topic"))


def is_agent_event(event_type: Column) -> Column:
    return event_type == AGENT_TYPE
