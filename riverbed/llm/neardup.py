"""Near-duplicate groups by MinHash with tensored bands.

Two small collections of half keys, each from two minhashes, are combined pairwise into table keys: m + m half keys
give m * m tables, so 4 m minhashes do the work of 4 m * m. Two texts meet if they share a half key of each collection.
Every candidate link is confirmed on the full sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import Scratch, arrow_map, binary, slices, text_buffer, tidy, tune, with_row_key
from .graph import components

#: Chance that a pair of texts at the threshold meets in no table.
MISS = 1e-4
#: Classes whose sets are looked up by a broadcast of their row keys at most; more go by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts of a table key up to which a join pairs its components; the texts of larger keys are compared in blocks where they meet.
SMALL_KEY = 16
#: Texts in such a block, about, and bytes of their sets.
KEY_BLOCK, KEY_BLOCK_BYTES = 384, 16_000_000


def halves(threshold: float, miss: float = MISS) -> int:
    """Half keys in each collection, so that a pair at the threshold is missed with a chance of ``miss`` at most."""
    return max(4, math.ceil(math.log(miss / 2) / math.log(1 - threshold**2)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles, text after text, and their offsets.

    A text of 1 to k - 1 words has one shingle, the whole sequence; one without words has none.
    """
    starts, ends, by = rolling.words(raw, offsets)
    s = rolling.prefix(rolling.word_hashes(raw, starts, ends, True))
    full = rolling.grams(s, k)
    if len(full):
        # The hash of the items at a start doesn't depend on what comes before, so one pass serves all texts.
        full = np.concatenate([full, np.zeros(len(s) - 1 - len(full), np.uint64)])
    sets = []
    for a, b in zip(by[:-1], by[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            sets.append(rolling.spans(s, np.array([a]), np.array([b])))
        else:
            sets.append(np.zeros(0, np.uint64))
    n = [len(x) for x in sets]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _salts(n: int) -> np.ndarray:
    return rolling.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(2, n)


def min_hashes(flat: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (columns) of each non-empty set (rows)."""
    out = np.empty((len(offsets) - 1, n), np.uint64)
    salt, odd = _salts(n)
    for j in range(n):
        v = flat ^ salt[j]
        v *= odd[j] | np.uint64(1)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9FB21C651E98DF25)
        out[:, j] = np.minimum.reduceat(v, offsets[:-1])
    return out


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(rid, id, n, h1, h2, sig, a, b) for docs (rid, id, text): set size, sums of two hashes of the set's shingles, two bits
    of 32 minhashes, half keys.

    Texts are of one class if n, h1 and h2 are equal, which 128 bits say; an empty set has null in both.
    """
    n_hash = 4 * m

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(2))
        for lo, hi in slices(off, 1_000_000):
            flat, o = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            n = np.diff(o)
            some = np.flatnonzero(n)
            starts = np.concatenate([o[:-1][some], o[-1:]])
            h1, h2, sig = (np.zeros(len(n), np.int64) for _ in range(3))
            keys = np.zeros((len(n), 2 * m), np.int64)
            if len(some):
                h = min_hashes(flat, starts, n_hash)
                for to, salt in ((h1, 0), (h2, 0x2545F4914F6CDD1D)):
                    to[some] = rolling.mix(np.add.reduceat(rolling.mix(flat ^ np.uint64(salt)), starts[:-1]) + n[some].astype(np.uint64)).view(np.int64)
                low = (h[:, :32] >> np.uint64(40)) & np.uint64(3)
                sig[some] = (low << (2 * np.arange(low.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)
                keys[some] = rolling.mix(h[:, 0::2] * np.uint64(3) + rolling.mix(h[:, 1::2]) + np.arange(2 * m, dtype=np.uint64)).view(np.int64)
            empty = n == 0
            list_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(h1, mask=empty), pa.array(h2, mask=empty), pa.array(sig), list_of(keys[:, :m]), list_of(keys[:, m:])], ["rid", "id", "n", "h1", "h2", "sig", "a", "b"])

    kind = T.StructType([T.StructField("rid", T.LongType()), docs.schema["id"], *T._parse_datatype_string("n long, h1 long, h2 long, sig long, a array<long>, b array<long>").fields])
    return arrow_map(docs.select("rid", "id", "text"), run, kind)


def least_agreement(t: float) -> int:
    """Of 32 two-bit minhashes, a pair at similarity t agrees on 32 (3 t + 1) / 4 in the mean; less by 4.2 deviations is rejected."""
    p = (3 * t + 1) / 4
    return math.floor(32 * p - 4.2 * math.sqrt(32 * p * (1 - p)))


def crowd_links(scratch: Scratch, texts: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (x, y) among texts of crowded keys that join different components.

    ``texts``: cid, comp, n, sig, a, b, rep; ``sets``: rid, s. Texts meet by their half keys of the first collection, in
    blocks of bounded size, so a task holds two blocks whatever the size of a key. A pair is looked at under the first
    half key that it shares, if it shares one of the second collection too. Sets are compared where they meet, and not
    for texts that are connected already, so only links leave a task, and fewer than it has texts.
    """
    least = least_agreement(num / den)
    rows = scratch.save(texts.join(sets.withColumnRenamed("rid", "rep"), "rep").drop("rep"))
    x = rows.select("cid", "comp", F.octet_length("s").alias("bytes"), F.explode("a").alias("key"))
    sizes = x.groupBy("key").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    blocks = F.greatest(F.ceil(F.col("c") / KEY_BLOCK), F.ceil(F.col("bytes") / KEY_BLOCK_BYTES)).cast("int")
    sizes = scratch.save(sizes.select("key", blocks.alias("blocks")))
    dealt = x.select("cid", "key").join(sizes, "key").withColumn("t", F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cid", "key", "t", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"))
    cols = ["key", "p", "q", "t", "cid", "comp", "n", "sig", "a", "b", "s"]
    met = dealt.join(rows, "cid").select(*cols).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def links(t: pa.Table) -> pa.RecordBatch:
        part, cid, comp, n, sig = (t[c].to_numpy() for c in ("t", "cid", "comp", "n", "sig"))
        a, b = (t[c].combine_chunks().flatten().to_numpy().reshape(len(cid), -1) for c in ("a", "b"))
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        here = int(np.argmax(a[0] == t["key"][0].as_py()))
        d = sig[left][:, None] ^ sig[right][None, :]
        agree = 32 - np.bitwise_count((d | (d >> 1)) & 0x5555555555555555)
        n1, n2 = n[left][:, None], n[right][None, :]
        ok = (agree >= least) & (comp[left][:, None] != comp[right][None, :]) & (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2))
        if p == q:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        score = agree[i, j]
        i, j = left[i], right[j]
        due = (b[i] == b[j]).any(axis=1) & ~(a[i, :here] == a[j, :here]).any(axis=1)
        order = np.argsort(-score[due].astype(np.int64), kind="stable")
        sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["s"].combine_chunks()]
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        out = []
        for k, l in zip(i[due][order].tolist(), j[due][order].tolist(), strict=True):
            ck, cl = find(int(comp[k])), find(int(comp[l]))
            if ck != cl and similar(sets_[k], sets_[l], num, den):
                top[ck] = cl
                out.append((k, l))
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[got[:, 0]], cid[got[:, 1]])), pa.array(np.maximum(cid[got[:, 0]], cid[got[:, 1]]))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, p, q = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            t = pa.Table.from_batches([batch])
            first = t.slice(0, 1)
            if held and any(held[0][c][0] != first[c][0] for c in ("key", "p", "q")):
                yield links(pa.concat_tables(held))
                held = []
            edges = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                held.append(t.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield links(pa.concat_tables(held))
                    held = []
        if held:
            yield links(pa.concat_tables(held))

    return scratch.save(met.mapInArrow(tidy(run), "x long, y long"))


def similar(u: np.ndarray, v: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, for sorted sets that aren't empty."""
    common = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return den * common >= num * (len(u) + len(v) - common)


class Verifier:
    """Confirms candidate links on full sets; remembers which pairs have been tried."""

    def __init__(self, scratch: Scratch, base: DataFrame, classes: DataFrame, k: int, num: int, den: int):
        self.scratch, self.base, self.k, self.num, self.den = scratch, base, k, num, den
        self.light = classes.select("cid", "n", "sig", "rep")
        self.tried: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sets are similar enough, written."""
        pairs = pairs.distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["x", "y"], "left_anti")
        x, y = (self.light.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "xy")
        p = pairs.join(x, "x").join(y, "y")
        # Sizes decide exactly.
        p = p.where(self.den * F.least("n_x", "n_y") >= self.num * F.greatest("n_x", "n_y"))
        diff = F.col("sig_x").bitwiseXOR(F.col("sig_y"))
        agree = 32 - F.bit_count(diff.bitwiseOR(F.shiftrightunsigned(diff, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        p = self.scratch.save(p.where(agree >= least_agreement(self.num / self.den)).select("x", "y", "rep_x", "rep_y"))
        tried = p.select("x", "y")
        self.tried = tried if self.tried is None else self.tried.unionByName(tried)
        sets = self.sets(p.select(F.col("rep_x").alias("rid")).unionByName(p.select(F.col("rep_y").alias("rid"))).distinct())
        both = p.join(sets.select(F.col("rid").alias("rep_y"), F.col("s").alias("s_y")), "rep_y").join(sets.select(F.col("rid").alias("rep_x"), F.col("s").alias("s_x")), "rep_x")
        num, den = self.num, self.den

        def confirm(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ok = [similar(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), num, den) for u, v in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])

        out = self.scratch.save(arrow_map(both.select("x", "y", "s_x", "s_y"), confirm, "x long, y long"))
        self.scratch.drop(sets)
        return out

    def sets(self, rids: DataFrame) -> DataFrame:
        """(rid, s) with the sorted set of each of these rows."""
        rids = self.scratch.save(rids)
        if rids.count() <= BROADCAST_ROWS:
            rids = F.broadcast(rids)
        k = self.k

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raw, off = text_buffer(batch.column(1))
            for lo, hi in slices(off, 1_000_000):
                flat, o = shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binary(flat, o)], ["rid", "s"])

        return self.scratch.save(arrow_map(self.base.select("rid", "text").join(rids, "rid", "left_semi"), run, "rid long, s binary"))


def groups(spark: SparkSession, scratch: Scratch, base: DataFrame, num: int, den: int, k: int = 5) -> DataFrame:
    """(rid, id, n, comp) for base (rid, id, text): texts of a similarity of num / den or more share a comp, through any
    chain of links; comp is null for texts without words. A class of equal texts is named by its first row key."""
    m = halves(num / den)
    sk = scratch.save(sketches(base, k, m))
    same = ["n", "h1", "h2"]
    named = scratch.save(sk.where("h1 is not null").groupBy(*same).agg(F.min("rid").alias("cid"), *[F.first(c).alias(c) for c in ("sig", "a", "b")]))
    classes = named.select("cid", F.col("cid").alias("rep"), "n", "sig", "a", "b")
    # Half keys that no other text has make no table key that another one has.
    half = classes.select("cid", F.posexplode(F.concat("a", "b")).alias("p", "h"))
    twice = scratch.save(half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    own = half.join(twice, "h").groupBy("cid").agg(*[F.collect_list(F.when(F.col("p") < m if s == "a" else F.col("p") >= m, F.col("h"))).alias(s) for s in "ab"])
    tables = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y)))))
    keys = scratch.save(own.select("cid", tables.alias("key")))
    shared = scratch.save(keys.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"), F.count("*").alias("size")).where("lead < last").drop("last"))
    met = scratch.save(keys.join(shared, "key"))
    scratch.drop(twice, keys, shared)
    check = Verifier(scratch, base, classes, k, num, den)
    edges = check.links(met.where("cid <> lead").select(F.col("lead").alias("x"), F.col("cid").alias("y")))
    # What failed against a key's first text may still be linked with its others, if they are in another component.
    comps = components(scratch, edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = scratch.save(met.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    open_ = scratch.save(labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key"))
    rows = scratch.save(labelled.join(open_, "key").drop("lead"))
    few, many = rows.where(F.col("size") <= SMALL_KEY), rows.where(F.col("size") > SMALL_KEY)
    right = few.select("key", F.col("cid").alias("y"), F.col("comp").alias("comp_y"))
    pairs = few.select("key", F.col("cid").alias("x"), "comp").join(right, "key").where("x < y and comp <> comp_y").select("x", "y").distinct()
    crowd = scratch.save(many.select("cid", "comp").distinct().join(classes.select("cid", "n", "sig", "a", "b", "rep"), "cid"))
    edges = edges.unionByName(crowd_links(scratch, crowd, check.sets(crowd.select(F.col("rep").alias("rid"))), num, den))
    edges = edges.unionByName(check.links(pairs))
    comps = components(scratch, edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = named.select(*same, "cid").join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(*same, F.coalesce("comp", "cid").alias("comp"))
    return scratch.save(sk.select("rid", "id", *same).join(found, same, "left").select("rid", "id", "n", "comp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A text's set is its distinct k-word shingles (words between ASCII white space, A to Z lower-cased). Texts are
    linked if den * intersection >= num * union; component_id is the smallest id reached by links, kept says that it is
    the row's own. Null and empty texts have size 0 and are linked with nothing, so they are kept. Rows with a null id
    are linked like others and never kept as a group's first, unless the whole group has no id. Rows that repeat an id
    have the component of their own text.
    """
    tune(spark)
    scratch = Scratch(spark, "neardup")
    base = with_row_key(scratch, docs, id_col, text_col)
    g = groups(spark, scratch, base, num, den, k)
    first = scratch.save(g.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id")))
    out = g.join(first, "comp", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the first of each group: the smallest id, null last, then any one."""
    tune(spark)
    scratch = Scratch(spark, "neardup")
    base = scratch.save(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))
    g = groups(spark, scratch, base.select("rid", F.col("row")[id_col].alias("id"), F.coalesce(F.col("row")[text_col], F.lit("")).alias("text")), num, den, k)
    me = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    first = scratch.save(g.where("comp is not null").groupBy("comp").agg(F.min(me).alias("m")).select("comp", F.col("m.rid").alias("first")))
    gone = scratch.save(g.join(first, "comp").where("rid <> first").select("rid"))
    return base.join(gone, "rid", "left_anti").select("row.*")
