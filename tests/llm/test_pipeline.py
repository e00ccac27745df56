"""The pipeline's stages one by one against brute force on each stage's own input, and their contract."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from riverbed.llm import catalog, decontaminate, toxicity
from support import ORACLE, SMALL
from test_models import check_packing


@pytest.fixture(scope="session")
def stages(spark, tmp_path_factory):
    """[(stage, what went in, what came out)], as the runs hand them on."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), catalog.table(spark, SMALL, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SMALL).write.parquet(str(folder / name))
        kept = spark.read.parquet(str(folder / name))
        out.append((name, docs, kept))
        docs = kept
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()


def test_toxic_documents_go(spark):
    """From a handful of labels as from many: what the model calls toxic goes, and most of that is."""
    for folder in (SMALL, ORACLE):
        before, labels = catalog.table(spark, folder, "documents"), catalog.table(spark, folder, "labels")
        scored = toxicity.score(spark, before, labels)
        bad = scored.where("predicted = 1").select("doc_id")
        assert 0 < bad.count() < 0.3 * before.count()
        assert rows(corpus_pipeline.drop_toxic(spark, before, folder)) == rows(before.join(bad, "doc_id", "left_anti").select(*before.columns))
        right = scored.where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
        print(folder, "right on held-out documents:", right)
        assert right > 0.8


def test_boilerplate_lines_go(stages):
    _, before, after = stages[1]
    old, new = rows(before), {r["doc_id"]: r for r in after.collect()}
    kept = brute.site_lines([(r[3], (r[1] or "").split("\n")) for r in old])
    for r, k in zip(old, kept, strict=True):
        text = "\n".join(k)
        assert new[r[0]]["text"] == (r[1] if text == (r[1] or "") else text)
        assert new[r[0]]["n_chars"] == (r[4] if text == (r[1] or "") else len(text))


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    old = rows(before)
    comp, size = brute.near_components([r[1] for r in old], 80, 100)
    first = {}
    for c, r in zip(comp, old, strict=True):
        first.setdefault(c, r[0])
    want = [r for c, n, r in zip(comp, size, old, strict=True) if not n or first[c] == r[0]]
    assert rows(after) == want and len(want) < len(old)


def test_contaminated_documents_go(spark, stages):
    """No document that is left holds a benchmark window, however long it is."""
    _, before, after = stages[3]
    old = rows(before)
    items = [(r["item_id"], r["text"]) for r in catalog.table(spark, SMALL, "benchmark").collect()]
    assert min(len(brute.LETTERS.findall(t)) for _, t in items) >= 13
    found = brute.contamination([r[1] for r in old], items)
    assert rows(after) == [r for r, (_, h, _) in zip(old, found, strict=True) if not h]


def test_short_items_need_a_share(spark):
    """An item of few words is no evidence in a long text; a whole window is, at any length."""
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "hello there")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(500))
    docs = [(1, filler + " hello there"), (2, "so hello there"), (3, filler + " " + item[: item.index(" q13")] + " " + filler), (4, filler + " " + item[: item.index(" q12")] + " " + filler), (5, None), (5, None), (None, item.upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("row", F.lit(1))
    out = decontaminate.clean(spark, df, bench)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5, 5]
    assert decontaminate.clean(spark, df, bench.where("false")).count() == len(docs)


def test_what_is_left_is_packed(stages):
    _, before, after = stages[4]
    n, least = check_packing(after, [(r[0], r[1]) for r in rows(before)])
    assert n <= least + 1


def test_run_gives_the_last_stage(spark, stages):
    got, want = (sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect()) for df in (corpus_pipeline.run(spark, SMALL), stages[-1][2]))
    assert got == want


def test_odd_documents_pass_through(spark, odd, tmp_path):
    """Nulls, repeated rows and columns whose names the operators use inside."""
    docs = odd[1].withColumns({"lang": F.lit("xx"), "source": F.when(F.col("doc_id") % 3 == 0, "a"), "n_chars": F.char_length("text").cast("long")})
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and docs.where("length > 4096").count() == 0


def test_empty_documents_table(spark, tmp_path):
    docs = catalog.table(spark, SMALL, "documents").where("false")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_native_operators_have_no_python(spark):
    for name in ("op6_decontaminate", "op8_line_dedup"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
