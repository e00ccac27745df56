"""Registration, removal, counts and the meta channel."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from riverbed import QueryError, Registry, match_by_join
from riverbed.functions.resolve import VariantEvent


def filled() -> Registry:
    r = Registry()
    r.add("main", "c1", "q1", 'a=1&../type="x";b=>2&b=<5')
    r.add("main", "c1", "q2", "a=[3&/c/d=!4")
    r.add("side", "c2", "q1", "")
    return r


def test_counts():
    r = filled()
    assert r.active() == 4
    assert dict(r.key_counts("main")) == {"data/a": 2, "type": 1, "data/b": 2, "data/c/d": 1}
    assert r.key_counts("side") == {}
    assert r.paths() == sorted({("data", "a"), ("type",), ("data", "b"), ("data", "c", "d")})
    tree = r.key_tree("main")["subKeys"]
    assert tree["type"]["references"] == 1 and tree["data"]["subKeys"]["c"]["subKeys"]["d"]["references"] == 1


def test_replacing_and_removing():
    r = filled()
    r.add("main", "c1", "q1", "z=1")
    assert r.active() == 3 and "data/b" not in r.key_counts("main")
    assert r.remove("main", "c1", "q2") == 1 and r.remove("main", "c1", "q2") == 0
    assert r.remove("main", "c1") == 1 and r.active() == 1 and not r.key_counts("main")


def test_a_wrong_part_changes_nothing():
    r = filled()
    before, log = dict(r.entries), len(r.log)
    with pytest.raises(QueryError):
        r.add("main", "c1", "q1", "a=1;b=1&b=2")
    with pytest.raises(QueryError):
        r.add("", "c1", "q1", "a=1")
    assert r.entries == before and len(r.log) == log


def test_table_of_conjunctions(spark):
    t = {(x["query_id"], x["conj_id"]): x for x in filled().standing(spark).collect()}
    assert len(t) == 4
    assert t["q1", 0]["anchor"] == "eq" and t["q1", 1]["anchor"] == "range" and t["q2", 2]["anchor"] == "all" and t["q1", 3]["terms"] == []


def test_changes_are_events_that_can_be_matched(spark):
    r = filled()
    r.remove("main", "c1", "q2")
    m = r.meta_events(spark)
    rows = [json.loads(x["value"]) for x in m.collect()]
    assert [x["type"].rpartition(".")[2] for x in rows] == ["registration"] * 3 + ["removal"]
    assert len({x["id"] for x in rows}) == 4
    w = Registry()
    w.add("meta", "watcher", "w", '../type=~"riverbed.query."&channel="main"&queryID="q2"')
    found = match_by_join(m.withColumn("event", F.parse_json("value")), w, VariantEvent("event"), key=["value"])
    assert found.count() == 2
