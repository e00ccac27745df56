"""Requests of every mode, each kind of refusal, and the frames that go out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riverbed.sources import envelope
from riverbed.streaming import pipeline, sse

SCHEMA = "n int, channel string, content_type string, headers map<string,string>, body string"
GOOD = {"ce-source": "//s", "CE-Id": "1", "Ce-Extra": "e", "x-other": "no"}


def judged(spark, rows, **options):
    rows = [(i, *r) for i, r in enumerate(rows)]
    return envelope.judged(spark.createDataFrame(rows, SCHEMA), **options)


def codes(spark, rows, **options):
    return [(r["offset"], r["code"], r["status"]) for r in judged(spark, rows, **options).orderBy("n", "offset").collect()]


def test_every_refusal(spark):
    j, s, b = envelope.HEADER, envelope.STRUCTURED, envelope.BATCH
    whole = {"source": "s", "id": "i", "data": {}}
    cases = [
        (("main", j, GOOD, "{}"), None), (("", j, GOOD, "{}"), "invalid-channel"), ((None, j, GOOD, "{}"), "invalid-channel"), (("meta", j, GOOD, "{}"), "disallowed-meta-channel-send"),
        (("main", None, GOOD, "{}"), "missing-content-type"), (("main", "text/plain", GOOD, "{}"), "invalid-content-type"),
        (("main", j, {"ce-id": "1"}, "{}"), "missing-event-source"), (("main", j, {"ce-source": "1"}, "{}"), "missing-event-id"),
        (("main", j, GOOD | {"ce-datacontenttype": "text/x"}, "{}"), "conflicting-data-type-headers"), (("main", j, GOOD | {"ce-datacontenttype": j}, "{}"), None),
        (("main", j, GOOD, "{"), "invalid-json-body"), (("main", j, GOOD, "[]"), "invalid-json-body"), (("main", j, GOOD, None), "invalid-json-body"), (("main", j, GOOD, '{"a":1,"a":2}'), "invalid-json-body"),
        (("main", s, {}, json.dumps(whole)), None), (("main", s + "; charset=utf-8", {}, json.dumps(whole)), None), (("main", s, {}, json.dumps(whole | {"source": 1})), "missing-event-source"),
        (("main", s, {}, json.dumps(whole | {"id": None})), "missing-event-id"), (("main", s, {}, json.dumps(whole | {"data": [1]})), "invalid-data-field"), (("main", s, {}, '{"source":"s","id":"i"}'), "invalid-data-field"),
        (("main", b, {}, json.dumps(whole)), "invalid-json-body"),
    ]
    got = codes(spark, [r for r, _ in cases])
    assert [c for _, c, _ in got] == [c for _, c in cases]
    assert {s for _, c, s in got if c == "disallowed-meta-channel-send"} == {403} and {s for _, c, s in got if c is None} == {202}
    assert codes(spark, [("main", j, GOOD, '{"a":"' + "x" * 200 + '"}')], max_body=100) == [(None, "body-too-large", 413)]


def test_nothing_may_follow_a_body(spark):
    """A body is one JSON value: what stands behind it is refused and can't become attributes of the event."""
    tails = ["}", "]", ",", ',"source":"x"', "},{", "]}", "}]", " {}", "x", ' , "id" : 2', "}}", "\n\t "]
    got = codes(spark, [("main", envelope.HEADER, GOOD, '{"a":[1]}' + t) for t in tails])
    assert [c for _, c, _ in got] == ["invalid-json-body"] * (len(tails) - 1) + [None]
    df = spark.createDataFrame([(t,) for t in ("1", " null ", '"]"', "[]", "", "1 2", "1]", "1}", None)], "t string")
    assert [r[0] for r in df.select(F.to_json(envelope.whole_json(F.col("t")))).collect()] == ["1", "null", '"]"', "[]", None, None, None, None, None]


def test_a_batch_is_taken_whole_or_not_at_all(spark):
    e = {"source": "s", "id": "i", "data": {}}
    bad = {"source": "s", "data": {}}
    assert codes(spark, [("main", envelope.BATCH, {}, json.dumps([e, bad, e]))]) == [(0, "batch-refused", 400), (1, "missing-event-id", 400), (2, "batch-refused", 400)]
    assert codes(spark, [("main", envelope.BATCH, {}, json.dumps([e, e]))]) == [(0, None, 202), (1, None, 202)]
    assert envelope.accepted(judged(spark, [("main", envelope.BATCH, {}, "[]")])).count() == 0


def test_headers_become_attributes(spark):
    r = envelope.accepted(judged(spark, [("main", envelope.HEADER, GOOD, '{"a": [1, null]}')])).first()
    assert json.loads(r["raw"]) == {"source": "//s", "id": "1", "extra": "e", "datacontenttype": envelope.HEADER, "data": {"a": [1, None]}}
    assert (r["source"], r["id"]) == ("//s", "1")


def test_names_that_differ_in_case_alone(spark):
    """The first in byte order counts, so one sender's headers can't stop a stream; no headers at all is no map."""
    rows = [("main", envelope.HEADER, {"ce-source": "a", "CE-Source": "b", "Ce-Id": "1", "ce-ID": "2"}, "{}"), ("main", envelope.HEADER, None, "{}"), ("main", envelope.HEADER, {"CE-DATACONTENTTYPE": "x/y", "ce-datacontenttype": envelope.HEADER, "ce-source": "s", "ce-id": "i"}, "{}")]
    out = judged(spark, rows)
    assert [r["code"] for r in out.orderBy("n").collect()] == [None, "missing-event-source", "conflicting-data-type-headers"]
    good = envelope.accepted(out).collect()
    assert [(r["source"], r["id"]) for r in good] == [("b", "1")]


def test_channels_are_decoded(spark):
    df = spark.createDataFrame([("a%20b",), ("",), ("%",), ("x",)], "c string")
    assert [r[0] for r in df.select(envelope.channel_name(F.col("c"))).collect()] == ["a b", None, None, "x"]


def test_structured_lines(spark):
    lines = spark.createDataFrame([('{"source":"s","id":"i","data":{}}',)], "value string")
    assert envelope.accepted(envelope.judged(envelope.structured(lines, F.lit("main")))).count() == 1


def test_admission():
    assert envelope.admitted(9, 5, 2, 10) is None
    assert envelope.admitted(10, 5, 2, 10) == {"code": envelope.OVERLOAD, "status": 429, "count": 10, "limit": 10, "refused": 10}


def test_admission_in_order(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(6)] + [("b", 0, 100), ("b", 1, 1)], "channel string, n int, size int")
    out = envelope.admission(df, "n", F.col("size"), 10).orderBy("channel", "n").collect()
    assert [(r["channel"], r["n"]) for r in out if r["status"] == 202] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert {r["code"] for r in out if r["status"] == 429} == {envelope.OVERLOAD}


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([("c1", "//somewhere", "some-id", ["q"], '{"a":\n1}')], "client_id string, source string, id string, query_ids array<string>, raw string")
    assert df.select(sse.body(F.col("source"), F.col("id"), F.col("raw"))).first()[0] == 'event: data\nid: %2F%2Fsomewhere+some-id\ndata: {"a":\ndata: 1}\n\n'
    p = sse.payloads(df).first()["payload"]
    assert p.startswith(': {"timestamp":"') and p.split("\n")[0].endswith('Z"}')
    sse.write_frames(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].strip().endswith("data: 1}")


def test_backoff_grows_and_is_bounded():
    waits = [pipeline.backoff(i, 0.5) for i in range(60)]
    assert waits == sorted(waits) and waits[-1] <= 10_000 and pipeline.backoff(3, 0.0) < pipeline.backoff(3, 0.9)
