"""Repeated windows of a corpus, found through sampled positions.

A window is W consecutive items (bytes or words) of one text. Each window names as its anchor the q-gram with the
smallest hash in it (the last of equal ones), so equal windows have equal anchors at equal places. Consecutive windows
mostly share their anchor; such a run, with all items its windows cover, is an occurrence of a node. Only anchors whose
q-gram occurs again are looked at further, and a corpus has few of them: about 2 / (W - q + 2) of its positions.

- A node whose q-gram has no other node is closed: its windows repeat as often as the node itself.
- The windows of the other, open nodes are compared with each other, bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import Scratch, arrow_map, binary, slices, text_buffer

#: Nodes of a q-gram up to which one task compares their windows; windows of larger buckets are dealt out one by one.
LARGE_BUCKET = 2000
#: Nodes whose windows a task compares at once, small buckets together.
CHUNK = 4000


@dataclass(frozen=True)
class Windows:
    """What the items are, the window's length and the anchor's, both in items."""

    w: int
    q: int
    words: bool

    def items(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of all texts back to back, and their offsets by text."""
        if not self.words:
            return raw, offsets
        starts, ends, by = rolling.words(raw, offsets)
        return rolling.word_hashes(raw, starts, ends, False), by

    @property
    def size(self) -> int:
        return 8 if self.words else 1

    @property
    def kind(self) -> type:
        return np.uint64 if self.words else np.uint8


def anchors(items: np.ndarray, offsets: np.ndarray, win: Windows) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, q-gram, node) of each run of windows with one anchor."""
    n = len(items) - win.w + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    s = rolling.prefix(items)
    g = rolling.grams(s, win.q)
    at = rolling.window_min(g, win.w - win.q + 1)
    long_ = np.flatnonzero(np.diff(offsets) >= win.w)
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, offsets[long_], 1)
    np.add.at(mark, offsets[long_ + 1] - win.w + 1, -1)
    valid = np.cumsum(mark[:n]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    text_starts = offsets[long_]
    new[text_starts] = True
    first = np.flatnonzero(new)
    stop = np.empty(len(first), np.int64)
    text = np.searchsorted(offsets, first, side="right") - 1
    end = offsets[text + 1] - win.w + 1
    if len(first):
        stop[:-1] = np.minimum(first[1:], end[:-1])
        stop[-1] = end[-1]
    count = stop - first
    node = rolling.mix(rolling.spans(s, first, stop - 1 + win.w) + (at[first] - first).astype(np.uint64))
    return text, first, count, g[at[first]], node


def occurrences(base: DataFrame, win: Windows) -> DataFrame:
    """(q, node, id, rid, s, n): n windows from item s of row rid have the anchor q and make up this node."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(2))
        rids = batch.column(0).to_numpy()
        for a, b in slices(off, 1_000_000):
            items, by = win.items(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            text, first, count, q, node = anchors(items, by, win)
            yield pa.RecordBatch.from_arrays([pa.array(q.view(np.int64)), pa.array(node.view(np.int64)), batch.column(1).take(pa.array(text + a)), pa.array(rids[text + a]), pa.array((first - by[text]).astype(np.int32)), pa.array(count.astype(np.int32))], ["q", "node", "id", "rid", "s", "n"])

    long_, int_ = T.LongType(), T.IntegerType()
    kind = T.StructType([T.StructField("q", long_), T.StructField("node", long_), base.schema["id"], T.StructField("rid", long_), T.StructField("s", int_), T.StructField("n", int_)])
    return arrow_map(base.select("rid", "id", "text"), run, kind)


def repeated(scratch: Scratch, base: DataFrame, win: Windows, keep: bool) -> DataFrame:
    """The occurrences whose q-gram occurs at least twice.

    With ``keep`` all occurrences are written first; otherwise they are worked out twice, first for their q-grams alone,
    which suits short windows, with which they would be the largest table.
    """
    occ = scratch.save(occurrences(base, win)) if keep else occurrences(base, win)
    twice = scratch.save(occ.select("q").groupBy("q").agg(F.count("*").alias("c")).where("c > 1").select("q"))
    scratch.collect()
    out = scratch.save(occ.join(twice, "q"))
    scratch.drop(occ, twice)
    return out


def contexts(base: DataFrame, nodes: DataFrame, win: Windows, carry: list[str]) -> DataFrame:
    """``nodes`` (q, node, rid, s, n, ...) with ``items``: all that the node's windows cover, read from one occurrence."""
    wanted = nodes.groupBy("rid").agg(F.collect_list(F.struct("s", "n", "q", "node", *carry)).alias("at"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(0))
        lists = batch.column(1)
        rows, lo = lists.flatten(), lists.offsets.to_numpy()
        for a, b in slices(off, 1_000_000):
            items, by = win.items(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            part = rows.slice(lo[a], lo[b] - lo[a])
            s, n = part.field(0).to_numpy().astype(np.int64), part.field(1).to_numpy().astype(np.int64)
            start = s + np.repeat(by[:-1], np.diff(lo[a : b + 1]))
            size = n + win.w - 1
            o = np.concatenate([[0], np.cumsum(size)])
            flat = items[np.repeat(start - o[:-1], size) + np.arange(o[-1])]
            yield pa.RecordBatch.from_arrays([*(part.field(i) for i in range(1, part.type.num_fields)), binary(flat, o)], [*(part.type.field(i).name for i in range(1, part.type.num_fields)), "items"])

    fields = {f.name: f for f in nodes.schema.fields}
    kind = T.StructType([*(fields[c] for c in ("n", "q", "node", *carry)), T.StructField("items", T.BinaryType())])
    return arrow_map(base.select("rid", "text").join(wanted, "rid").select("text", "at"), run, kind)


def in_chunks(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``size`` rows that never part rows of one key."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows < size:
            continue
        t = pa.concat_tables(held).combine_chunks()
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
            held, rows = [t.slice(cut)], t.num_rows - cut
        else:
            held = [t]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def layout(t: pa.Table, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of all nodes of ``t`` back to back, windows by node, and for each window its node's row and its place."""
    items = t["items"].combine_chunks()
    raw = np.frombuffer(b"".join(items.to_pylist()), win.kind)
    n = t["n"].to_numpy().astype(np.int64)
    size = n + win.w - 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(np.cumsum(size) - size, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return raw, n, row, at


def removed_spans(scratch: Scratch, occ: DataFrame, verdicts: DataFrame, win: Windows, first: bool) -> DataFrame:
    """(rid, spans): the item ranges covered by windows to remove.

    ``verdicts`` (q, node, bits, f_rid, f_s): a bit for each window of the node. Without ``first`` a set bit removes
    the window everywhere; with it, a set bit keeps the window at the node's first occurrence (f_rid, f_s), and
    everything else goes. Null bits stand for all set.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rid, s, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        total = int(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        flags = np.ones(total, bool)
        bits = batch.column(3)
        has = np.flatnonzero(~np.asarray(bits.is_null()))
        if len(has):
            raw = b"".join(bits.take(pa.array(has)).to_pylist())
            flags[np.isin(row, has)] = np.frombuffer(raw, np.uint8).astype(bool)
        if first:
            f_rid, f_s = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            flags = ~(flags & ((f_rid == rid) & (f_s == s))[row])
        change = flags.copy()
        change[1:] &= ~flags[:-1] | (row[1:] != row[:-1])
        last = flags.copy()
        last[:-1] &= ~flags[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(change), np.flatnonzero(last)
        yield pa.RecordBatch.from_arrays([pa.array(rid[row[a]]), pa.array((s[row[a]] + place[a]).astype(np.int32)), pa.array((s[row[b]] + place[b] + win.w).astype(np.int32))], ["rid", "a", "b"])

    both = occ.join(verdicts, ["q", "node"]).select("rid", "s", "n", "bits", "f_rid", "f_s")
    rows = arrow_map(both, run, "rid long, a int, b int")
    return scratch.save(rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")))


def covered(spans: pa.Array, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For all texts back to back, whether each item is in a span. ``lengths``: spans of each text."""
    mark = np.zeros(int(offsets[-1]) + 1, np.int32)
    flat = spans
    base = np.repeat(offsets[:-1], lengths)
    np.add.at(mark, flat.field(0).to_numpy().astype(np.int64) + base, 1)
    np.add.at(mark, flat.field(1).to_numpy().astype(np.int64) + base, -1)
    return np.cumsum(mark[:-1]) > 0


def strip(base: DataFrame, spans: DataFrame, win: Windows, f: Callable, fields: str) -> DataFrame:
    """``f(raw, text offsets, item offsets, gone)`` over all texts, ``gone`` by item; returns arrays of ``fields``."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(1))
        lists = batch.column(2)
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], type=lists.type)
        rows, lo = lists.flatten(), lists.offsets.to_numpy()
        for a, b in slices(off, 1_000_000):
            part, cut = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            by = rolling.words(part, cut)[2] if win.words else cut
            gone = covered(rows.slice(lo[a], lo[b] - lo[a]), np.diff(lo[a : b + 1]), by)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *f(part, cut, by, gone)], ["id", *names])

    kind = T.StructType([base.schema["id"], *T._parse_datatype_string(fields).fields])
    return arrow_map(base.join(spans, "rid", "left").select("id", "text", "spans"), run, kind)
