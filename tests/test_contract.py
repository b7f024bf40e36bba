import json

import pytest
from helpers import agent, ended, queued, records
from pyspark.sql import functions as F

from quelora.functions.ids import event_id
from quelora.functions.iso import format_millis, parse_iso
from quelora.operators import contract

GOOD = queued("ct-8f2a1b3c", 5)


def changed(**parts):
    return {**GOOD, **parts}


def without(*path):
    copy = json.loads(json.dumps(GOOD))
    del (copy if len(path) == 1 else copy[path[0]])[path[-1]]
    return copy


def dump(x):
    return json.dumps(x).encode()


CASES = {
    "valid": (dump(GOOD), None),
    "agent": (dump(agent("ag-1", 3, "busy")), None),
    "null payload value": (dump({**GOOD, "payload": {**GOOD["payload"], "queue_id": None}}), None),
    "extra fields": (dump({**GOOD, "more": 1, "payload": {**GOOD["payload"], "x": [1]}}), None),
    "minute precision with zone": (dump(changed(event_time="2026-09-28T12:03Z")), None),
    "seven digits": (dump(changed(event_time="2026-09-28T12:03:21.1234567")), None),
    "date alone": (dump(changed(event_time="2026-09-28")), None),
    "not utf-8": (b'{"a": "\xff"}', 1),
    "not json": (b"{esto no es json", 2),
    "null value": (None, 2),
    "duplicate key": (b'{"a":1,"a":2}', 2),
    "not an object": (b"[1]", 3),
    "missing envelope": (dump(without("schema_version")), 4),
    "two missing": (b'{"event_type":"contact_queued"}', 4),
    "unknown type": (dump(changed(event_type="contact_paused")), 5),
    "number as type": (dump(changed(event_type=5)), 5),
    "payload list": (dump(changed(payload=["lista"])), 6),
    "missing payload": (dump(without("payload", "queue_id")), 7),
    "agent with contact payload": (dump(changed(event_type="agent_state_changed")), 7),
    "time is a number": (dump(changed(event_time=5)), 8),
    "not iso": (dump(changed(event_time="28/09/2026 14:03")), 9),
    "year alone": (dump(changed(event_time="2026")), 9),
    "impossible date": (dump(changed(event_time="2026-13-40")), 9),
    "empty key": (dump(changed(key="")), 10),
    "key mismatch": (dump(changed(key="otra-cosa")), 11),
    "number expected": (dump(ended("c", 3, "mucho")), 12),
}


def test_each_rule(spark):
    rows = [(name, b"k", value) for name, (value, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, key binary, value binary")
    found = {r["name"]: r["rule"] for r in contract.validate(df).collect()}
    assert found == {name: rule for name, (_, rule) in CASES.items()}


def test_messages_name_what_is_wrong(spark):
    df = spark.createDataFrame([(b"k", CASES[n][0]) for n in ("two missing", "missing payload", "unknown type", "key mismatch")], "key binary, value binary")
    errors = {r["rule"]: r["error"] for r in contract.validate(df).collect()}
    assert errors[4] == "faltan campos obligatorios del sobre: ['event_id', 'event_time', 'schema_version', 'key', 'payload']"
    assert errors[7] == "contact_queued sin campos obligatorios en payload: ['queue_id']"
    assert errors[5] == "event_type no soportado: 'contact_paused'"
    assert errors[11] == "key ('otra-cosa') debe ser el contact_id ('ct-8f2a1b3c') en los eventos de contacto"


def test_split_and_dead_letters(spark):
    df = spark.createDataFrame([(b"k", dump(GOOD)), (None, None), (b"", b"x"), (b"\xff", b"x")], "key binary, value binary")
    checked = contract.validate(df)
    assert contract.valid(checked).count() == 1
    letters = contract.dead_letter_records(contract.dead_letters(checked), "dlq").collect()
    assert sorted(bytes(r["key"]).decode() for r in letters) == ["sin-clave", "sin-clave", "�"]


def test_times_are_normalised_to_fixed_width(spark):
    given = {
        "2026-09-28T12:03:21+02:00": "2026-09-28T10:03:21.000Z",
        "2026-09-28T12:03:21.081763Z": "2026-09-28T12:03:21.081Z",
        "2026-09-28T12:03:21,999999": "2026-09-28T12:03:21.999Z",
        "2026-09-28 12:03": "2026-09-28T12:03:00.000Z",
        "2026-09-28T12:03-0530": "2026-09-28T17:33:00.000Z",
        "12:03": None,
        "2026-9-8": None,
    }
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", format_millis(parse_iso(F.col("t"))).alias("o")).collect()} == given


@pytest.mark.parametrize("parts", [("ag-soporte-n1-01", "transicion-2"), ("é", "x")])
def test_ids_are_name_based_uuids(spark, parts):
    from quelora.sources.simulator import event_id as plain

    found = spark.range(1).select(event_id(*map(F.lit, parts))).first()[0]
    assert found == plain(*parts)
    if parts[0].startswith("ag"):
        assert found == "31b259b6-94cd-57c0-b8ee-541a865bbcc1"


def test_fields_survive(spark):
    row = contract.valid(contract.validate(records(spark, [ended("c9", 7, 4.5, "transferred")]))).first()
    assert (row["contact_id"], row["wait_seconds"], row["talk_seconds"], row["disposition"], row["event_key"]) == ("c9", 4.5, 120.0, "transferred", "c9")
