"""Dedupe with a lifetime, and streaming runs with a registry that changes."""

from __future__ import annotations

import json
import os
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from riverbed import Registry
from riverbed.plans.registry import DurableRegistry
from riverbed.operators import dedupe
from riverbed.streaming import folders, pipeline


def test_lifetime_is_not_extended(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.randrange(0, 600) / 1.0) for _ in range(200)]
    df = spark.createDataFrame([("main", s, i, t) for s, i, t in rows], "channel string, source string, id string, t double").withColumn("ingest_ts", F.timestamp_seconds("t"))
    want = []
    for key in {r[:2] for r in rows}:
        last = None
        for t in sorted({r[2] for r in rows if r[:2] == key}):
            if last is None or t - last >= 180:
                want.append((*key, t))
                last = t
    got = [(r["source"], r["id"], r["t"]) for r in dedupe.first_events_within(df).collect()]
    assert sorted(got) == sorted(want)
    assert dedupe.first_events(df).count() == len({r[:2] for r in rows})


def test_ambiguous_concatenations_stay_apart(spark):
    df = spark.createDataFrame([("m", "a b", "c"), ("m", "a", "b c"), ("n", "a", "b c"), ("m", "a", "b c")], "channel string, source string, id string")
    assert dedupe.first_events(df).count() == 3


def request(n, **data):
    return json.dumps({"channel": "main", "content_type": "application/cloudevents+json", "headers": {}, "body": json.dumps({"source": "s", "id": str(n), "data": data}), "ingest_ts": "2024-01-01T00:00:00Z"})


SCHEMA = "channel string, content_type string, headers map<string,string>, body string, ingest_ts timestamp"


def test_publish_with_a_changing_registry(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, lines: (folder / name).write_text("\n".join(lines) + "\n")
    put("1.json", [request(1, a=1), request(1, a=1), request(2, a=2), "{broken"])
    r = Registry()
    r.add("main", "c1", "q1", "a=1")
    r.add("meta", "watch", "w", "")
    seen: list[tuple] = []
    sink = lambda df, n: seen.extend((x["client_id"], x["id"], tuple(x["query_ids"])) for x in df.collect())
    stream = lambda: pipeline.ingest(spark.readStream.schema(SCHEMA).json(str(folder)))
    assert pipeline.publish(stream(), r, sink, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(x for x in seen if x[0] == "c1") == [("c1", "1", ("q1",))]
    assert len([x for x in seen if x[0] == "watch"]) == 2
    seen.clear()
    put("2.json", [request(2, a=1), request(3, a=1), request(4, a=3)])
    r.remove("main", "c1")
    r.add("main", "c2", "all", "")
    assert pipeline.publish(stream(), r, sink, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(x[:2] for x in seen if x[0] != "watch") == [("c2", "3"), ("c2", "4")]  # 2 was told before the restart


def test_many_queries_take_the_join(spark):
    r = Registry()
    for i in range(pipeline.FEW + 1):
        r.add("main", f"c{i % 3}", f"q{i}", f"a={i}")
    e = spark.createDataFrame([("main", "s", "1", '{"data":{"a":5}}')], "channel string, source string, id string, raw string").withColumn("event", F.parse_json("raw"))
    found = pipeline.fan_out(e, r)
    assert [x["query_id"] for x in found.collect()] == ["q5"]


def test_gauges():
    g = pipeline.Gauges(Registry())
    assert "riverbed_active_queries 0" in g.text() and g.text().count("# TYPE") == 5


def test_the_first_row_of_a_key_stays(spark):
    """By time, and by place in the request where times tie; no time is the earliest; columns of any kind come along."""
    rows = [("m", "s", "1", "late", 9, 0), ("m", "s", "1", "early", 3, 5), ("m", "s", "1", "same", 3, 7), ("m", "s", "2", "only", 4, None), ("m", None, "3", "x", 8, 1), ("m", None, "3", "none", None, 2)]
    df = spark.createDataFrame(rows, "channel string, source string, id string, what string, t int, offset int").withColumn("ingest_ts", F.timestamp_seconds("t")).withColumn("event", F.parse_json(F.lit('{"a":[1]}')))
    for parts in (1, 6):
        out = dedupe.first_events(df.repartition(parts, "what"))
        assert out.columns == df.columns and sorted(r["what"] for r in out.collect()) == ["early", "none", "only"]


@pytest.mark.parametrize("capacity,parts", [(1 << 20, 8), (6, 2), (3, 1)])
def test_bounded_dedupe(spark, tmp_path, capacity, parts):
    """Against a plain replay of each part: lifetimes to the event, and the oldest key forgotten where there is no room."""
    rng = random.Random(capacity)
    (tmp_path / "in").mkdir()
    rows, t = [], 0.0
    for f in range(3):
        lines = []
        for _ in range(120):
            t += rng.choice([0.25, 0.5, 3, 20])
            key = (rng.choice("ab"), rng.choice([None, *"wxyz"]))
            rows.append((f, *key, t))
            lines.append(json.dumps({"n": len(rows) - 1, "source": key[0], "id": key[1], "ingest_ts": t}))
        rng.shuffle(lines)
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(sorted(lines, key=lambda x: json.loads(x)["ingest_ts"])) + "\n")
        os.utime(tmp_path / "in" / f"{f}.json", (f + 1, f + 1))
    schema = "n int, source string, id string, ingest_ts double"
    part = {r["n"]: r["p"] for r in spark.read.schema(schema).json(str(tmp_path / "in")).select("n", F.pmod(F.xxhash64("source", "id"), F.lit(parts)).alias("p")).collect()}
    want, held = set(), {p: {} for p in range(parts)}
    for n, (_, source, id_, t) in enumerate(rows):
        h = held[part[n]]
        if h.get((source, id_), t) > t:
            continue
        want.add((source, id_, t))
        h.pop((source, id_), None)
        for k in [k for k, until in h.items() if until <= t]:
            del h[k]
        if len(h) >= max(1, capacity // parts):
            del h[min(h, key=lambda k: h[k])]
        h[source, id_] = t + 60
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ingest_ts", F.timestamp_seconds("ingest_ts"))
    got = []
    q = dedupe.first_events_bounded(stream, 60, capacity, parts, key=["source", "id"]).writeStream.foreachBatch(lambda b, _: got.extend((r["source"], r["id"], r["t"]) for r in b.withColumn("t", F.col("ingest_ts").cast("double")).collect()))
    assert q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


def test_a_durable_registry(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/r"
    r = DurableRegistry(spark, folder, wait=0)
    r.add("main", "c1", "q1", "a=1")
    r.add("main", "c1", "q2", "b=~é")
    r.remove("main", "c1", "q1")
    other = DurableRegistry(spark, folder, wait=0)
    assert other.entries == r.entries and [x["type"] for x in other.log] == [x["type"] for x in r.log]
    other.add("side", "c2", "q", "")
    with pytest.raises(OSError):  # someone else has written since
        r.add("main", "c1", "q3", "a=3")
    assert ("main", "c1", "q3") not in r.entries
    assert r.refresh() == 1 and r.refresh() == 0 and r.entries == other.entries
    r.add("main", "c1", "q3", "a=3")
    calls = []
    write = DurableRegistry._write

    def shaky(self, name, text):
        calls.append(name)
        if len(calls) < 3:
            raise OSError("not now")
        write(self, name, text)

    monkeypatch.setattr(DurableRegistry, "_write", shaky)
    assert r.disconnect("c2") == 1 and len(calls) == 3 and DurableRegistry(spark, folder).entries == r.entries


def test_a_restart_reads_a_snapshot(spark, tmp_path, monkeypatch):
    from riverbed.plans import registry

    monkeypatch.setattr(registry, "SNAPSHOT", 4)
    folder = f"file://{tmp_path}/r"
    r = DurableRegistry(spark, folder, wait=0)
    for i in range(11):
        r.add("main", "c", f"q{i % 7}", f"a={i}")
        if i % 5 == 4:
            r.remove("main", "c", f"q{i % 7 - 1}")
        again = DurableRegistry(spark, folder, wait=0)
        assert again.entries == r.entries and again.changed == r.changed == i + 1 + (i + 1) // 5 and len(again.log) <= 4
    assert len({x["id"] for x in r.log}) == len(r.log) == 13


def test_unreachable_clients_are_unregistered(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(request(1, a=1) + "\n")
    r = Registry()
    for c in ("here", "away"):
        r.add("main", c, "q", "a=1")
        r.add("side", c, "q", "a=2")
    stream = pipeline.ingest(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
    q = pipeline.publish(stream, r, lambda df, n: {x["client_id"] for x in df.collect()} - {"here"}, str(tmp_path / "cp"))
    assert q.awaitTermination(120) and {k[1] for k in r.entries} == {"here"}
    pipeline.stop(q, r, ["here"])
    assert not r.entries and not q.isActive


def test_folders_come_from_the_session(spark):
    assert folders.fresh(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_meta_events_are_not_taken_from_producers(spark):
    df = spark.createDataFrame([("meta",), ("main",)], "channel string")
    assert pipeline.without_meta(df).count() == 1


class State:
    """A group's state, as far as a function of ``applyInPandasWithState`` needs one."""

    exists, kept = False, None

    def update(self, kept):
        self.kept = kept


@pytest.mark.parametrize("run,merged", [(32 << 20, 32), (1 << 20, 32), (100_000, 3)])
def test_a_part_is_sorted_in_bounded_memory(spark, monkeypatch, run, merged):
    """A batch that is much larger than what a worker holds: all of it in time, ties as they came, whole numbers among NULLs told apart."""
    monkeypatch.setattr(dedupe, "RUN_BYTES", run, raising=False)
    monkeypatch.setattr(dedupe, "MERGED", merged, raising=False)
    monkeypatch.setattr(dedupe, "BLOCK_BYTES", 1 << 16, raising=False)
    got = {}
    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandasWithState", lambda self, f, *_: got.update(df=self._df, judge=f))
    n = 30_000
    df = spark.range(n).select("id", F.when(F.col("id") % 7 > 0, 2**60 + F.col("id") % 3).alias("user"), F.repeat(F.lit("x"), 400).alias("pad"), F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("at"))
    dedupe.first_events_bounded(df, 1e9, 1, 1, ["user"], "at")
    rows = got["df"].toPandas()
    rows["pad"] = [f"{x:06}" + "x" * 400 for x in range(n)]  # strings of their own
    order = [x for x in range(0, n, 2)]
    random.Random(3).shuffle(order)
    order = [y for x in order for y in (x, x + 1)]

    def batches():
        for a in range(0, n, 500):
            part = rows.iloc[order[a : a + 500]].copy()
            part["pad"] = part["pad"].str.slice(0, 405) + "y"
            yield part

    state, told = State(), []
    tracemalloc.start()
    for b in got["judge"]((0,), batches(), state):
        told += b["id"].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    key = lambda x: x % 7 and 2**60 + x % 3
    assert told == [x for x in range(n) if x == 0 or key(x) != key(x - 1)]
    assert len(state.kept[0]) == 16 and (run > 1 << 20 or peak < n * 400 / 2)
