"""Substring dedup on a compacted de Bruijn graph of word k-mers.

The k-mers of a window's length that follow each other and share their smallest q-gram travel together as one edge of the
graph (see ``repeats``), so the graph has about 2 / (window - gram + 2) of the corpus's k-mers. Edges join where one goes
on into the next in a text. A path without branches, along which all occurrences go together, is compacted into one long
span by joins; its source coordinates then tell which occurrence is the first. Where edges of one q-gram differ, their
k-mers are compared one by one.

Equality of two edges, paths or k-mers is that of 128 bits: of their smallest q-gram's hash and of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, arrow_map, binary, sha256, tidy, tune, with_row_key
from .repeats import CHUNK, LARGE_BUCKET, Windows, contexts, in_chunks, layout, removed_spans, repeated, strip


def compact(scratch: Scratch, occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node, n): heads of nonbranching paths over ``nodes`` (q, node, weight, n), with the windows of the whole path.

    X is followed by Y if every occurrence of X goes on into Y and every occurrence of Y comes from X, which their
    coordinates show. Pointers to the head double each round, so rounds grow with the logarithm of a path's nodes.
    """
    at = scratch.save(occ.select("q", "node", "rid", "s", "n").join(nodes.select("q", "node", "weight"), ["q", "node"]))
    w = Window.partitionBy("rid").orderBy("s")
    nxt = at.select("q", "node", "weight", "n", "s", *[F.lead(c).over(w).alias(f"y_{c}") for c in ("q", "node", "weight", "s")])
    nxt = nxt.where("y_s = s + n")
    pairs = nxt.groupBy(F.col("q").alias("up_q"), F.col("node").alias("up"), F.col("y_q").alias("q"), F.col("y_node").alias("node")).agg(F.count("*").alias("c"), F.first("weight").alias("wx"), F.first("y_weight").alias("wy"), F.first("n").alias("d"))
    up = scratch.save(pairs.where("c = wx and c = wy").select("q", "node", "up_q", "up", F.col("d").cast("long").alias("d")))
    active, done = up, None
    while True:
        r = up.select(F.col("q").alias("up_q"), F.col("node").alias("up"), F.col("up_q").alias("up2_q"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        on = active.join(r, ["up_q", "up"], "left")
        step = scratch.save(on.select("q", "node", F.coalesce("up2_q", "up_q").alias("up_q"), F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up2").isNull().alias("at_head")))
        ended = step.where("at_head").drop("at_head")
        done = ended if done is None else done.unionByName(ended)
        active = step.where("not at_head").drop("at_head")
        if active.isEmpty():
            break
        up = done.unionByName(active)
    tails = done.join(nodes.select("q", "node", "n"), ["q", "node"]).groupBy(F.col("up_q").alias("q"), F.col("up").alias("node")).agg(F.max(F.col("d") + F.col("n")).alias("long"))
    inner = done.select("q", "node")
    heads = nodes.join(scratch.save(inner), ["q", "node"], "left_anti").join(scratch.save(tails), ["q", "node"], "left")
    return heads.select("q", "node", F.coalesce("long", "n").cast("int").alias("n"))


def _first_bits(ctx: DataFrame, win: Windows, scratch: Scratch) -> DataFrame:
    """(q, node, bits) for the nodes in ``ctx`` (n, q, node, size, o, rid, s, items): 1 where the node's first occurrence
    is the window's first in all nodes."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_chunks(batches, "q", CHUNK):
            items, n, row, at = layout(t, win)
            s = rolling.prefix(items)
            h = rolling.spans(s, at, at + win.w)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + t["s"].to_numpy().astype(np.int64)[row]
            order = np.lexsort((place, t["rid"].to_numpy()[row], t["o"].to_numpy()[row], h))
            lead = np.ones(len(order), bool)
            lead[1:] = h[order[1:]] != h[order[:-1]]
            mine = np.zeros(len(order), np.uint8)
            mine[order[lead]] = 1
            yield pa.RecordBatch.from_arrays([t["q"].combine_chunks(), t["node"].combine_chunks(), binary(mine, np.concatenate([[0], np.cumsum(n)]))], ["q", "node", "bits"])

    cols = ("q", "node", "n", "o", "rid", "s", "items")
    few = ctx.where(F.col("size") <= LARGE_BUCKET).repartition("q").sortWithinPartitions("q").select(*cols).mapInArrow(tidy(small), "q long, node long, bits binary")

    def dealt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([batch])
        items, n, row, at = layout(t, win)
        h = rolling.spans(rolling.prefix(items), at, at + win.w)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(batch.column(i).take(take) for i in (0, 1, 3, 4)), pa.array((t["s"].to_numpy().astype(np.int64)[row] + j).astype(np.int32)), pa.array(j.astype(np.int32))], ["h", "q", "node", "o", "rid", "p", "j"])

    rows = scratch.save(arrow_map(ctx.where(F.col("size") > LARGE_BUCKET).select(*cols), dealt, "h long, q long, node long, o long, rid long, p int, j int"))
    first = scratch.save(rows.groupBy("q", "h").agg(F.min(F.struct("o", "rid", "p")).alias("f")))
    mine = (F.col("f.o") == F.col("o")) & (F.col("f.rid") == F.col("rid")) & (F.col("f.p") == F.col("p"))
    per = rows.join(first, ["q", "h"]).groupBy("q", "node").agg(F.array_sort(F.collect_list(F.struct("j", F.when(mine, "01").otherwise("00").alias("d")))).alias("w"))
    many = per.select("q", "node", F.unhex(F.array_join(F.transform("w", lambda x: x["d"]), "")).alias("bits"))
    return few.unionByName(many)


def later_repeats(scratch: Scratch, base: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, spans) of base (rid, id, text): word ranges covered by a window of words that also starts earlier."""
    win = Windows(window, gram, words=True)
    occ = repeated(scratch, base, win, keep=False)
    order = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("o")
    nodes = occ.select("*", order).groupBy("q", "node").agg(F.count("*").alias("weight"), F.min(F.struct("o", "rid", "s", "n")).alias("f"))
    nodes = scratch.save(nodes.select("q", "node", "weight", "f.o", "f.rid", "f.s", "f.n"))
    sizes = scratch.save(nodes.groupBy("q").agg(F.count("*").alias("size")))
    sized = scratch.save(nodes.join(sizes, "q"))
    closed = sized.where("size = 1 and weight > 1").select("q", "node", "weight", "n", "rid", "s")
    paths = scratch.save(compact(scratch, occ, closed))
    # A path's first occurrence is its head's, and it takes the head's place with all its windows.
    longer = paths.join(closed.select("q", "node", F.col("rid").alias("f_rid"), F.col("s").alias("f_s")), ["q", "node"]).select("q", "node", "n", F.lit(None).cast("binary").alias("bits"), F.col("f_rid"), F.col("f_s").cast("long").alias("f_s"))
    ctx = scratch.save(contexts(base, sized.where("size > 1"), win, ["size", "o", "rid", "s"]))
    open_ = _first_bits(ctx, win, scratch).join(nodes.select("q", "node", "n", F.col("rid").alias("f_rid"), F.col("s").cast("long").alias("f_s")), ["q", "node"])
    verdicts = scratch.save(longer.unionByName(open_.select("q", "node", "n", "bits", "f_rid", "f_s")))
    out = removed_spans(scratch, occ.drop("n"), verdicts, win, first=True)
    scratch.drop(occ, ctx, nodes, sizes, sized, verdicts)
    return out


def dedup(spark: SparkSession, docs: DataFrame, window: int = 20, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces; with ``digest`` kept_sha256 instead).

    A word goes if a window of ``window`` words over it also starts earlier: in a row with a smaller integer id (null is
    smallest, equal ids by row key), or before it in the same text. The first occurrence stays. Null texts have no words;
    texts of fewer words than the window keep all of them.
    """
    tune(spark)
    scratch = Scratch(spark, "substring")
    base = with_row_key(scratch, docs, id_col, text_col)
    spans = later_repeats(scratch, base, window, gram)

    def out(raw, off, by, gone):
        starts, ends, _ = rolling.words(raw, off)
        kept = np.concatenate([[0], np.cumsum(~gone)])
        n = np.diff(by)
        a, b = starts[~gone], ends[~gone]
        size = b - a + 1  # each word with a space after it
        o = np.concatenate([[0], np.cumsum(size)])
        flat = np.full(o[-1], 0x20, np.uint8)
        from_ = np.repeat(a - o[:-1], size) + np.arange(o[-1])
        inner = np.ones(o[-1], bool)
        inner[o[1:] - 1] = False
        flat[inner] = raw[from_[inner]]
        cut = o[kept[by]]
        last = cut[1:][np.diff(cut) > 0] - 1  # no space after a text's last word
        flat = np.delete(flat, last)
        cut = cut - np.concatenate([[0], np.cumsum(np.diff(cut) > 0)])
        rest = binary(flat, cut)
        return pa.array(n), pa.array(n - np.diff(kept[by])), sha256(rest) if digest else rest.cast(pa.string())

    last = "kept_sha256 string" if digest else "kept string"
    got = strip(base, spans, Windows(window, gram, True), out, "n_words long, n_removed long, " + last)
    return got.withColumnRenamed("id", "doc_id")
