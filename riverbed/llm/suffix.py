"""Substring removal over sampled suffixes, by bucket-pointer refinement.

Suffixes start in buckets by their first q-gram; a bucket of one is done. What is left is refined by sorting on the
bucket identifiers of later offsets, and each round reuses the identifiers of the one before, until suffixes in one
bucket share the whole window.

Suffixes are looked at in runs with one smallest q-gram (see ``repeats``). A run whose q-gram has no other run needs no
refinement: it repeats as a whole. Buckets of up to ``LARGE_BUCKET`` runs are refined in one task each; larger ones, which
no task could hold, are dealt out by the hash of the whole window, the last bucket that refinement comes to. Runs and such
windows are equal if 128 bits are: the q-gram's hash and their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, arrow_map, binary, sha256, tidy, tune, with_row_key
from .repeats import CHUNK, LARGE_BUCKET, Windows, contexts, in_chunks, layout, removed_spans, repeated, strip


def refine(s: np.ndarray, at: np.ndarray, w: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the windows of w items at ``at`` (ascending), and which of them share theirs with another one.

    ``s``: rolling prefix of the items. Starts from buckets of q-grams, then doubles: the bucket of 2 k items at p is
    the pair of the buckets of k items at p and at p + k (at p + w - k in the end, where they overlap). Suffixes alone
    in their bucket leave, and so do those whose later offset has left.
    """
    n = len(s) - 1
    ids = np.full(n, -1, np.int64)
    # Later offsets of a window lie within it, so their buckets are needed besides those of the windows themselves.
    have = q
    steps = []
    while have < w:
        step = min(have, w - have)
        steps.append(step)
        have += step
    need, levels = at, []
    for step in reversed(steps):
        levels.append(need)
        need = np.union1d(need, need + step)
    _, first = np.unique((s[need + q] - s[need]) * rolling._pow(rolling.INV, n + 1)[need], return_inverse=True)
    many = np.bincount(first)[first] > 1
    ids[need[many]] = first[many]
    for step, need in zip(steps, reversed(levels), strict=True):
        left, right = ids[need], ids[need + step]
        on = (left >= 0) & (right >= 0)
        p = need[on]
        _, pair = np.unique(left[on] * (n + 1) + right[on], return_inverse=True)
        many = np.bincount(pair)[pair] > 1
        ids = np.full(n, -1, np.int64)
        ids[p[many]] = pair[many]
    return ids[at], ids[at] >= 0


def _open_bits(ctx: DataFrame, win: Windows, scratch: Scratch) -> DataFrame:
    """(q, node, bits) for the nodes in ``ctx`` (n, q, node, weight, size, items): a byte for each window, 1 if it repeats."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_chunks(batches, "q", CHUNK):
            raw, n, row, at = layout(t, win)
            _, shared = refine(rolling.prefix(raw), at, win.w, win.q)
            shared |= (t["weight"].to_numpy() > 1)[row]
            yield pa.RecordBatch.from_arrays([t["q"].combine_chunks(), t["node"].combine_chunks(), binary(shared.astype(np.uint8), np.concatenate([[0], np.cumsum(n)]))], ["q", "node", "bits"])

    few = ctx.where(F.col("size") <= LARGE_BUCKET).repartition("q").sortWithinPartitions("q").select("q", "node", "n", "weight", "items").mapInArrow(tidy(small), "q long, node long, bits binary")

    def dealt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([batch])
        raw, n, row, at = layout(t, win)
        h = rolling.spans(rolling.prefix(raw), at, at + win.w)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), t["q"].combine_chunks().take(pa.array(row)), t["node"].combine_chunks().take(pa.array(row)), pa.array((at - np.repeat(at[np.cumsum(n) - n], n)).astype(np.int32)), t["weight"].combine_chunks().take(pa.array(row))], ["h", "q", "node", "j", "weight"])

    rows = arrow_map(ctx.where(F.col("size") > LARGE_BUCKET).select("q", "node", "n", "weight", "items"), dealt, "h long, q long, node long, j int, weight long")
    rows = scratch.save(rows)
    dup = scratch.save(rows.groupBy("q", "h").agg(F.sum("weight").alias("c")).where("c > 1").select("q", "h", F.lit(1).alias("dup")))
    per = rows.join(dup, ["q", "h"], "left").groupBy("q", "node").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("dup", F.lit(0)).alias("d")))).alias("w"))
    many = per.select("q", "node", F.unhex(F.array_join(F.transform("w", lambda x: F.lpad(x["d"].cast("string"), 2, "0")), "")).alias("bits"))
    return few.unionByName(many)


def repeated_bytes(scratch: Scratch, base: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, spans) of base (rid, id, text): byte ranges covered by a string of ``window`` bytes that starts elsewhere too."""
    win = Windows(window, gram, words=False)
    occ = repeated(scratch, base, win, keep=True)
    nodes = scratch.save(occ.groupBy("q", "node").agg(F.count("*").alias("weight"), F.min(F.struct("rid", "s", "n")).alias("f")).select("q", "node", "weight", "f.rid", "f.s", "f.n"))
    sizes = scratch.save(nodes.groupBy("q").agg(F.count("*").alias("size")))
    nodes = nodes.join(sizes, "q")
    ctx = scratch.save(contexts(base, nodes.where("size > 1"), win, ["weight", "size"]))
    open_ = _open_bits(ctx, win, scratch).select("q", "node", "bits")
    closed = nodes.where("size = 1 and weight > 1").select("q", "node", F.lit(None).cast("binary").alias("bits"))
    none = F.lit(None).cast("long")
    verdicts = scratch.save(open_.unionByName(closed).select("q", "node", "bits", none.alias("f_rid"), none.alias("f_s")))
    out = removed_spans(scratch, occ, verdicts, win, first=False)
    scratch.drop(occ, ctx, sizes, verdicts)
    return out


def dedup(spark: SparkSession, docs: DataFrame, window: int = 400, gram: int = 64, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; with ``digest`` kept_sha256 instead) for every row.

    Each byte in a string of ``window`` bytes that also starts anywhere else goes, in all places, same text included.
    Null texts are empty; texts shorter than the window keep everything; rows that repeat an id, or have none, are
    texts of their own, so a repeated row of ``window`` bytes or more removes itself. The kept bytes may cut characters.
    """
    tune(spark)
    scratch = Scratch(spark, "suffix")
    base = with_row_key(scratch, docs, id_col, text_col)
    spans = repeated_bytes(scratch, base, window, gram)

    def out(raw, off, by, gone):
        kept = np.concatenate([[0], np.cumsum(~gone)])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        at = off[:-1][np.diff(off) > 0]
        edge[at] = gone[at]
        runs = np.concatenate([[0], np.cumsum(edge)])
        n = np.diff(off)
        rest = binary(raw[~gone], kept[off])
        return pa.array(n), pa.array(n - np.diff(kept[off])), pa.array(np.diff(runs[off])), sha256(rest) if digest else rest

    last = "kept_sha256 string" if digest else "kept binary"
    got = strip(base, spans, Windows(window, gram, False), out, "n_bytes long, n_removed long, n_spans long, " + last)
    return got.withColumnRenamed("id", "doc_id")
