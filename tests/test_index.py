"""Ordered-map and interval-map operations against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riverbed.operators import index


def test_ordered_map(spark):
    keys = random.Random(1).sample(range(1000), 60)
    df = spark.createDataFrame([(k, k * 2) for k in keys], "k int, v int")
    got = lambda x: [r["k"] for r in x.collect()]
    s = sorted(keys)
    assert got(index.ascending(df, "k")) == s and got(index.descending(df, "k")) == s[::-1]
    for b in (s[0] - 1, s[7], s[7] + 1, s[-1], 2000):
        assert got(index.at_most(df, "k", b)) == [k for k in s[::-1] if k <= b]
        assert got(index.at_least(df, "k", b)) == [k for k in s if k >= b]
    assert got(index.first(df, "k")) == s[:1] and got(index.first(df.where("false"), "k")) == []
    assert got(index.get(df, "k", s[3])) == [s[3]] and index.keys(df, "k").columns == ["k"]
    new = spark.createDataFrame([(s[0], -1), (5000, -2)], "k int, v int")
    after = {r["k"]: r["v"] for r in index.put(df, new, "k").collect()}
    assert after == {k: k * 2 for k in keys} | {s[0]: -1, 5000: -2}
    assert sorted(got(index.remove(df, new, "k"))) == s[1:]


@pytest.mark.parametrize("width", [None, 3.0])
def test_intervals(spark, width):
    rng = random.Random(2)
    ranges = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(25)] + [(99, None, 3.0)]
    points = [float(x) / 2 for x in range(-3, 90)]
    norm = {i: (min(a, b), max(a, b)) for i, a, b in ranges if a is not None}
    r = spark.createDataFrame(ranges, "i int, lo double, hi double")
    p = spark.createDataFrame([(x,) for x in points], "x double")
    got = [(t["x"], t["i"]) for t in index.stab(p, "x", r, "lo", "hi", width).collect()]
    assert sorted(got) == sorted((x, i) for x in points for i, (a, b) in norm.items() if a <= x <= b)
    whole = r.where("i < 99")
    o = index.overlap(whole.select(F.col("i").alias("j"), F.col("lo").alias("a"), F.col("hi").alias("b")), "a", "b", whole, "lo", "hi", width)
    assert sorted((t["j"], t["i"]) for t in o.collect()) == sorted((j, i) for j, (a, b) in norm.items() for i, (c, d) in norm.items() if a <= d and c <= b)


def test_exact_ranges_and_extremes(spark):
    r = spark.createDataFrame([(1, 5.0, 2.0), (2, 2.0, 5.0), (3, 2.0, 6.0)], "i int, lo double, hi double")
    q = spark.createDataFrame([(2.0, 5.0)], "a double, b double")
    assert sorted(t["i"] for t in index.exact_range(q, "a", "b", r, "lo", "hi").collect()) == [1, 2]
    e = index.extremes(r.where("i > 1"), "lo", "hi").first()
    assert tuple(e["first"]) == (2.0, 5.0) and tuple(e["last"]) == (2.0, 6.0)
    assert [t["i"] for t in index.in_order(r.where("i > 1"), "lo", "hi").collect()] == [2, 3]


def test_prefixes(spark):
    texts, prefixes = ["", "a", "ab", "abc", "éa", "b", None], ["", "a", "abc", "é", "x", "abcd"]
    t, p = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in prefixes], "p string")
    want = sorted((x, y) for x in texts if x is not None for y in prefixes if x.startswith(y))
    assert sorted((r["t"], r["p"]) for r in index.prefixes_of(t, "t", p, "p").collect()) == want
    assert sorted(r["t"] for r in index.keys_starting_with(t, "t", "a").collect()) == ["a", "ab", "abc"]


def test_cardinality(spark):
    df = spark.range(7)
    assert index.cardinality(df).first()["size"] == 7 and index.cardinality(df, F.col("id")).first()["size"] == 21
    assert index.cardinality(df.where("false")).first()["size"] == 0
