import hashlib
import json

import __spark_entry__ as entry
import pytest

from ledgerline.operators import canonical as c

NUMBERS = {
    0: "0", -0.0: "0", 1: "1", 1.0: "1", -15: "-15", 100: "100", 1200.0: "1200", 0.1: "0.1", 123.456: "123.456", 1e21: "1e+21", 1e20: "100000000000000000000", 1.5e22: "1.5e+22", 1e-6: "0.000001",
    1e-7: "1e-7", 1.25e-9: "1.25e-9", 5e-324: "5e-324", 9007199254740993: "9007199254740992", 0.00012: "0.00012", 1e16: "10000000000000000", 123456789012345680000: "123456789012345680000",
}


@pytest.mark.parametrize("x", NUMBERS)
def test_numbers(x):
    assert c.number(x) == NUMBERS[x]


def test_text_and_order():
    assert c.canonical_json({"b": [True, None, 1.0], "a": "é😀\n\x01\"", "": 1, "😀": 2}) == '{"a":"é😀\\n\\u0001\\"","b":[true,null,1],"":1,"😀":2}'
    assert c.canonical_json("\x1f") == '"\\u001F"'


def test_events():
    box = {"eventId": "e", "traceId": "t", "spanId": None, "seq": 1, "kind": "model_usage", "capturedAt": "x", "evidenceStatus": "captured", "observationRole": "returned", "other": 1}
    assert c.canonical_event(box, {"seq": 9, "usage": {}, "__proto__": 1}) == {k: v for k, v in box.items() if k != "other"} | {"seq": 9, "usage": {}}
    control = c.canonical_event(box | {"kind": "span_start"}, {"span": {}})
    assert "observationRole" not in control and "span" not in control


def test_columns(spark):
    box = json.dumps({"eventId": "e", "kind": "span_end"})
    df = spark.createDataFrame([('{"b":1.0,"a":"x"}', box, None), ("nope", box, "{}"), (None, box, "{}")], "j string, container string, payload string")
    got = [(r[0], r[1]) for r in df.select(c.canonical("j"), c.digest("j")).collect()]
    assert got == [('{"a":"x","b":1}', hashlib.sha256(b'{"a":"x","b":1}').hexdigest()), (None, None), (None, None)]
    assert json.loads(c.project(df).first().event)["eventId"] == "e"


def test_events_with_equal_payloads_have_own_digests(spark, sf_dir):
    from ledgerline.plans.evidence import lifecycle_events

    rows = entry.queries()["event_digest"](spark, sf_dir).collect()
    assert len({r.digest for r in rows}) == len(rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    names = {"eventId": "event_id", "traceId": "trace_id", "spanId": "span_id", "seq": "seq", "kind": "kind", "capturedAt": "captured_at", "evidenceStatus": "status"}
    want = {}
    for e in lifecycle_events(spark, sf_dir).collect():
        event = {n: e[c] for n, c in names.items()}
        if e.kind not in ("interaction_start", "interaction_end", "span_start", "span_end"):
            event |= ({"observationRole": e.role} if e.role else {}) | ({"k": int(e.payload)} if e.payload else {})
        want[e.event_id] = hashlib.sha256(json.dumps(event, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {r.event_id: r.digest for r in rows} == want
