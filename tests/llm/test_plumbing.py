"""Scratch tables, rolling hashes and connected components."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from riverbed.llm import common, graph, rolling


def test_scratch_lives_in_the_shared_folder(spark):
    s = common.Scratch(spark, "t")
    assert s.base.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = s.save(spark.range(5))
    folder = s.base.removeprefix("file://") + "/1"
    assert os.path.isdir(folder) and df.count() == 5
    s.drop(df)
    assert not os.path.exists(folder)


def test_rolling_hashes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 200).astype(np.uint8)
    s = rolling.prefix(x)
    at = np.arange(190)
    h = rolling.spans(s, at, at + 10)
    assert (h == rolling.grams(s, 10)[:190]).all()
    for i in range(0, 190, 7):
        for j in range(0, 190, 11):
            assert (h[i] == h[j]) == (x[i : i + 10] == x[j : j + 10]).all()
    assert len(rolling.grams(s, 200)) == 1 and len(rolling.grams(s, 201)) == 0 and len(rolling.window_min(x, 201)) == 0
    m = rolling.window_min(x, 8)
    for i, a in enumerate(m):
        w = x[i : i + 8]
        assert w[a - i] == w.min() and (w[a - i + 1 :] > w.min()).all()


def test_words_never_cross_texts():
    data = [b"ab c", b"d  e", b"", b" ", b"f"]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    a, b, by = rolling.words(raw, off)
    assert [raw[x:y].tobytes() for x, y in zip(a, b, strict=True)] == [b"ab", b"c", b"d", b"e", b"f"] and by.tolist() == [0, 2, 4, 4, 4, 5]
    assert list(common.slices(off, 4)) == [(0, 1), (1, 3), (3, 5)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in graph.components(common.Scratch(spark, "g"), spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_plain_cluster_sessions_need_the_setting(spark, monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        common.shared_dir(Fake)
