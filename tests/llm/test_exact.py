"""Operators with one right result: whole tables and odd documents against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from riverbed.llm import catalog, common, decontaminate, lines, neardup, substring, suffix, topk
from support import ORACLE, SMALL, compare


@pytest.fixture(scope="session")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in catalog.table(spark, SMALL, "documents").select("doc_id", "text").collect()]


def by_row(rows, values):
    return sorted(((i, *v) for (i, _), v in zip(rows, values, strict=True)), key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], ORACLE)


def components(rows, num):
    comp, size = brute.near_components([t for _, t in rows], num, 100)
    first = defaultdict(list)
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            first[c].append(i)
    out = []
    for c, n, (i, _) in zip(comp, size, rows, strict=True):
        small = min(first[c]) if n and first[c] else i
        out.append((n, small, i == small))
    return out


@pytest.mark.parametrize("small_key,block", [(16, 1024), (2, 3)])
def test_near_duplicates(spark, docs, odd, collected, monkeypatch, small_key, block):
    monkeypatch.setattr(neardup, "SMALL_KEY", small_key)
    monkeypatch.setattr(neardup, "KEY_BLOCK", block)
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    if small_key == 16:
        assert collected(catalog.op3_near_duplicates(spark, SMALL), *cols) == by_row(docs, components(docs, 85))
    rows, df = odd
    assert collected(neardup.near_duplicates(spark, df), *cols) == by_row(rows, components(rows, 80))


def test_near_duplicates_of_chains_and_crowds(spark, collected):
    """Copies of copies reach each other; a crowd that shares most shingles falls into its own components."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):
        rows.append((i, " ".join(text)))
        text = [*text]
        text[rng.randrange(120)] = rng.choice(words)
    common = [rng.choice(words) for _ in range(90)]
    for i in range(80):
        rows.append((1000 + i, " ".join(common + [rng.choice(words) for _ in range(rng.choice([6, 18, 30]))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    for num in (80, 85, 95):
        assert collected(neardup.near_duplicates(spark, df, num=num), *cols) == by_row(rows, components(rows, num))


def test_keep_first(spark, odd):
    rows, df = odd
    out = neardup.keep_first(spark, df)
    assert out.columns == df.columns
    want = sorted((i, t) for (i, t), (_, _, kept) in zip(rows, components(rows, 80), strict=True) if i is not None and kept)
    got = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None)
    # Rows that repeat an id stay once; texts without words all stay.
    assert sorted(set(got)) == sorted(set(want), key=lambda t: (t[0], t[1])) if all(t for _, t in want) else {i for i, _ in got} == {i for i, _ in want}
    assert [r["text"] for r in out.where("doc_id IS NULL").collect()] == [None]
    ids = [i for i, _ in got]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize("large", [2000, 0])
def test_suffixes(spark, docs, odd, collected, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE_BUCKET", large)
    if large:
        want = [(n, r, s, brute.sha(k)) for n, r, s, k in brute.suffix([t for _, t in docs])]
        assert sum(r for _, r, _, _ in want) > 0
        assert collected(catalog.op4_suffix_dedup(spark, SMALL), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == by_row(docs, want)
    rows, df = odd
    got = suffix.dedup(spark, df)
    assert collected(got.withColumn("k", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "k") == by_row(rows, [(n, r, s, brute.sha(k)) for n, r, s, k in brute.suffix([t for _, t in rows])])
    few = suffix.dedup(spark, df.where("doc_id < 200 AND doc_id >= 100"), window=60, gram=16)
    part = [(i, t) for i, t in rows if i is not None and 100 <= i < 200]
    assert collected(few.withColumn("k", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "k") == by_row(part, [(n, r, s, brute.sha(k)) for n, r, s, k in brute.suffix([t for _, t in part], 60)])


@pytest.mark.parametrize("large", [2000, 0])
def test_substrings(spark, docs, odd, collected, monkeypatch, large):
    monkeypatch.setattr(substring, "LARGE_BUCKET", large)
    if large:
        want = [(n, r, brute.sha(k)) for n, r, k in brute.substring(docs)]
        assert sum(r for _, r, _ in want) > 0
        assert collected(catalog.op10_substring_dedup(spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == by_row(docs, want)
    rows, df = odd
    # Rows that share an id are in any order; what is left of them together is the same.
    want = by_row(rows, [(n, r, k) for n, r, k in brute.substring([(-(2**63) if i is None else i, t) for i, t in rows])])
    got = collected(substring.dedup(spark, df), "doc_id", "n_words", "n_removed", "kept")
    assert got == want


def crowd(n=300):
    """Passages that many documents share, at places of their own, and periodic texts."""
    rng = random.Random(8)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"u{rng.randrange(40)}" for _ in range(rng.randrange(30))] + rng.choice(passages)[rng.randrange(8) :]
        rows.append((i, " ".join(w + ["ab"] * rng.choice([0, 0, 45]) + ["x", "y", "z"] * rng.choice([0, 0, 20]))))
    return rows


@pytest.mark.parametrize("large", [2000, 20])
def test_shared_passages(spark, collected, monkeypatch, large):
    monkeypatch.setattr(substring, "LARGE_BUCKET", large)
    monkeypatch.setattr(suffix, "LARGE_BUCKET", large)
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(substring.dedup(spark, df), "doc_id", "n_words", "n_removed", "kept") == by_row(rows, brute.substring(rows))
    got = suffix.dedup(spark, df, window=80, gram=20)
    want = [(n, r, s, k) for n, r, s, k in brute.suffix([t for _, t in rows], 80)]
    assert [(i, n, r, s, bytes(k)) for i, n, r, s, k in collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")] == by_row(rows, want)


def test_planted_passages_go_by_their_bytes(spark, collected):
    """A passage of over 50 words goes if it has 400 bytes, whatever the number of its words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11)))
    texts, passages = [[word() for _ in range(150)] for _ in range(120)], [[word() for _ in range(rng.randrange(51, 75))] for _ in range(40)]
    for i, p in enumerate(passages):
        for j in (3 * i, 3 * i + 1):  # two documents of three
            at = rng.randrange(1, 150)
            texts[j][at:at] = ["X" + word(), *p, "Y" + word()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = [len(" ".join(p)) for p in passages]
    assert min(size) < 380 and max(size) > 420
    for i, n in enumerate(size):
        # With the spaces around it, a passage is shared with two bytes more, and with others if neighbours happen to agree.
        for j in (0, 1):
            assert 0 <= got[3 * i + j] - (n + 2) <= 6 if n + 2 >= 400 else n + 8 >= 400 or not got[3 * i + j]
        assert not got[3 * i + 2]


def test_decontamination(spark, odd, collected):
    rows, df = odd
    long_ = [t for i, t in rows if i == 10][0].split(" ")
    items = [(1, " ".join(long_[30:55])), (2, "one"), (3, None), (4, ""), (None, " ".join(long_[:20])), (5, "ONE, two; three!"), (6, " ".join(long_[50:63])), (6, "word word word"), (7, "日本語 𝄞"), (8, " ".join(["word"] * 20)), (1, " ".join(long_[100:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("iw", F.lit(1)).withColumn("fp", F.lit("x"))
    want = by_row(rows, brute.contamination([t for _, t in rows], items))
    got = decontaminate.hits(spark, df, bench)
    assert collected(got, "id", "n_words", "n_hit", "items") == want
    assert sum(w[2] > 0 for w in want) > 5


def test_decontamination_by_shuffle_and_without_items(spark, odd, collected, monkeypatch):
    rows, df = odd
    items = [(1, [t for i, t in rows if i == 10][0]), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert collected(decontaminate.hits(spark, df, bench), "id", "n_words", "n_hit", "items") == by_row(rows, brute.contamination([t for _, t in rows], items))
    none = decontaminate.hits(spark, df, bench.where("false"))
    assert {(r["n_hit"], tuple(r["items"])) for r in none.collect()} == {(0, ())} and none.count() == len(rows)
    c = spark.createDataFrame([(0, 0), (1, 20), (1, 21), (0, 5)], "h int, n int").select(decontaminate.contaminated(F.col("h"), F.col("n")).alias("c"))
    assert [r["c"] for r in c.collect()] == [False, True, False, False]


@pytest.mark.parametrize("few", [200_000, 0])
def test_site_lines(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "BROADCAST_LINES", few)
    rng = random.Random(6)
    pages = []
    for i in range(400):
        host = rng.choice(["big"] * 7 + ["small", "tiny", "", None])
        ls = [f"own {i}", rng.choice(["menu", "menu ", "footer", f"rare {i % 60}"]), "", " ", "menu"] if rng.random() < 0.8 else []
        pages.append((i // 2, host, ls if rng.random() < 0.95 else None))
    df = spark.createDataFrame(pages, "page_id int, h string, ls array<string>").withColumn("rid", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("gone", F.lit(3))
    got = lines.dedup(spark, df, F.col("h"), F.coalesce("ls", F.array().cast("array<string>")))
    want = sorted((p, h or "", tuple(k)) for (p, h, _), k in zip(pages, brute.site_lines([(h, x or []) for _, h, x in pages]), strict=True))
    assert sorted((r["page"]["page_id"], r["page"]["h"] or "", tuple(r["kept"])) for r in got.collect()) == want
    assert {(r["page"]["h"], r["host"]) for r in got.collect()} <= {(x, x) for x in ("big", "small", "tiny", "", None)}


def test_hosts_and_pieces_of_pages(spark):
    rows = [("http://a.b/c", "<p>x</p><script>var a = '<b>';</script> y <br/>z"), ("HTTPS://U:p@Ex.COM:80/?q", None), ("nonsense", "<style>p{}</style>"), (None, "plain"), ("http://h", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [(r[0], r[1]) for r in df.select(lines.url_host(F.col("url")), lines.html_lines(F.col("html"))).collect()]
    assert got == [("a.b", ["x", "y", "z"]), ("ex.com", []), ("", []), ("", ["plain"]), ("h", [])]


@pytest.mark.parametrize("size", [(8192, 256), (64, 7)])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES", size[0])
    monkeypatch.setattr(topk, "QUERIES", size[1])
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(600)]
    rows += [(600, None), (650, [1.0] * 11 + [None]), (700, [float("nan")] * 12), (750, [float("inf")] * 12), (800, []), (850, [0.5] * 3), (900, [0.0] * 12), (None, [1.0] * 12), (7000, rows[3][1]), (50_000, rows[3][1]), (1001, [0.25] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(spark, df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute.top_k(rows)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(101)], "vec_id long, embedding array<double>")
    ties = topk.search(spark, same, same.where("vec_id = 50")).orderBy("rank").collect()
    assert [r["vec_id"] for r in ties] == [0, 1, 2, 3, 4]


def test_lists_are_read_in_part(monkeypatch):
    """A query stops before the ends of the lists, and each entry is read once."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 16)) / 4).astype(np.int64)
    lists = topk.Lists(x, np.arange(3000))
    q = x[::60]
    found = lists.top(q, np.arange(0, 3000, 60), 5)
    for j, (rows, score) in enumerate(found):
        s = x @ q[j]
        s[60 * j] = -(2**40)
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert rows.tolist() == best.tolist() and score.tolist() == s[best].tolist()
    assert lists.read / len(q) < 0.9
    skewed = topk.Lists(x * (2 ** np.arange(16))[::-1], np.arange(3000))
    skewed.top(q, np.full(len(q), -1), 5)
    assert skewed.read / len(q) < lists.read / len(q)


def test_a_repeated_query_is_answered_once(spark):
    """With the smallest of its vectors; rows of its own id are no candidates."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.parquet.compression.codec",)}
    out = topk.search(spark, df, df.where("vec_id = 50"))
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(50, 1, 1, 2 * 256 * 256), (50, 2, 3, 2 * 256 * 256), (50, 3, 2, 0)]
    assert spark.conf.get(common.BATCH) == str(common.BATCH_ROWS) and {k: spark.conf.get(k) for k in before} == before


def test_empty_tables(spark, none):
    assert neardup.near_duplicates(spark, none).count() == suffix.dedup(spark, none).count() == substring.dedup(spark, none).count() == 0
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(spark, none, b).count() == 0 and neardup.keep_first(spark, none).count() == 0
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert lines.dedup(spark, p, F.col("url"), F.split("html", "\n")).count() == 0
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(spark, e, e).count() == 0
