"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Pieces are dealt by hash into blocks of bounded size. Each block is packed on a few islands; an island evolves a
population of packings: crossover injects whole well-filled bins of one parent into another, removes the bins that hold
a document twice, and best-fits the displaced documents. Between epochs each island's elite moves to the next island.
What ends up in bins with room to spare, over all blocks, is dealt and packed once more.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import units
from .common import Scratch, arrow_map, binary, pack, slices, text_buffer, tune

LIMIT = 4096
#: Pieces in a block, islands of a block, epochs between migrations, packings on an island, children in an epoch at most. An
#: island that meets the lower bound on sequences has no need of more, so only blocks that are hard to pack take them all.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 3, 3, 6, 16
#: Bins filled to less than this share are opened again in the last round.
FULL = 0.995


def best_fit(items: np.ndarray, size: list[int], room: list[int], into: list[int], limit: int) -> None:
    """Puts ``items`` one by one into the bin that they fill best, or a new one; changes ``room`` and ``into``."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in items.tolist():
        s = size[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = limit, len(room)
            room.append(limit)
        room[b] = r - s
        into[i] = b
        if r > s:
            insort(free, (r - s, b))


def first_packing(size: np.ndarray, limit: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best fit by falling size, sizes blurred with ``rng``."""
    key = size if rng is None else size * rng.uniform(0.8, 1.25, len(size))
    room: list[int] = []
    into = [0] * len(size)
    best_fit(np.argsort(-key, kind="stable"), size.tolist(), room, into, limit)
    return np.array(into, np.int32)


def fitness(into: np.ndarray, size: np.ndarray, limit: int) -> tuple[int, float]:
    """(-bins, mean squared fill): fewer bins are better, then unevenly filled ones (Falkenauer)."""
    fill = np.bincount(into, size)
    return -len(fill), float(((fill / limit) ** 2).mean()) if len(fill) else 0.0


def cross(a: np.ndarray, b: np.ndarray, size: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``b`` with well-filled bins of ``a``."""
    fill = np.bincount(a, size)
    share = rng.uniform(0.1, 0.4)
    gift = np.argsort(-(fill + rng.uniform(0, 0.02 * limit, len(fill))))[: max(1, int(share * len(fill)))]
    taken = np.isin(a, gift)
    broken = np.zeros(int(b.max()) + 1, bool)
    broken[b[taken]] = True  # bins that hold a document twice go
    fill_b = np.bincount(b, size)
    spare = np.flatnonzero(~broken & (fill_b < limit))
    if len(spare):
        broken[spare[np.argsort(fill_b[spare])[: max(1, len(spare) // 20)]]] = True  # and the emptiest, as mutation
    kept = ~taken & ~broken[b]
    names = np.concatenate([a[taken], b[kept] + len(fill)])
    _, number = np.unique(names, return_inverse=True)
    into = np.zeros(len(a), np.int64)
    into[np.concatenate([np.flatnonzero(taken), np.flatnonzero(kept)])] = number
    placed = taken | kept
    room = (limit - np.bincount(into[placed], size[placed])).astype(int).tolist()
    out = into.tolist()
    loose = np.flatnonzero(~placed)
    best_fit(loose[np.argsort(-size[loose], kind="stable")], size.tolist(), room, out, limit)
    return np.array(out, np.int32)


def bound(size: np.ndarray, limit: int) -> int:
    """No packing has fewer bins."""
    return -(-int(size.sum()) // limit)


def evolve(size: np.ndarray, pop: list[np.ndarray], children: int, limit: int, seed: int) -> list[np.ndarray]:
    """The best of the population and its children, best first; stops once the lower bound is met."""
    rng = np.random.default_rng(seed)
    least = bound(size, limit)
    pop = sorted(pop, key=lambda p: fitness(p, size, limit), reverse=True)
    keep = len(pop)
    for _ in range(children):
        if -fitness(pop[0], size, limit)[0] <= least:
            break
        i, j = np.sort(rng.choice(len(pop), 2, replace=False)) if len(pop) > 1 else (0, 0)
        child = cross(pop[i], pop[j], size, limit, rng)
        pop = sorted([*pop, child], key=lambda p: fitness(p, size, limit), reverse=True)[:keep]
    return pop


_STATE = "block long, island int, uids binary, sizes binary, pop binary, elite binary, bins long, fill double"


def _row(block: int, island: int, uids: np.ndarray, size: np.ndarray, pop: list[np.ndarray], limit: int) -> pa.RecordBatch:
    n, fill = fitness(pop[0], size, limit)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pack([uids]), pack([size]), pack([np.concatenate(pop)]), pack([pop[0]]), pa.array([-n], pa.int64()), pa.array([fill])],
        ["block", "island", "uids", "sizes", "pop", "elite", "bins", "fill"],
    )


def assign(scratch: Scratch, pieces: DataFrame, limit: int, salt: int) -> DataFrame:
    """(uid, block, bin, offset, fill) for pieces (uid, length) with 0 < length <= limit."""
    n = pieces.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(blocks))).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("p"))
    # Blocks have about BLOCK pieces whatever the size of the input, so a list of them is small.
    start = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("p.uid").alias("uids"), F.col("p.length").alias("lengths")).repartition("block", "island")

    def begin(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(batch.num_rows):
            block, island = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            uids, size = batch.column(2)[r].values.to_numpy(), batch.column(3)[r].values.to_numpy().astype(np.int64)
            rng = np.random.default_rng(abs(block) * 31 + island)
            pop = [first_packing(size, limit, None if island == 0 else rng)]
            if -fitness(pop[0], size, limit)[0] > bound(size, limit):
                pop += [first_packing(size, limit, rng) for _ in range(POPULATION - 1)]
            yield _row(block, island, uids, size, evolve(size, pop, CHILDREN, limit, abs(block) * 7 + island), limit)

    def go_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            size = np.frombuffer(r["sizes"], np.int64)
            pop = list(np.frombuffer(r["pop"], np.int32).reshape(-1, len(size)))
            if r["guest"] is not None:
                pop = [*pop[: POPULATION - 1], np.frombuffer(r["guest"], np.int32)]
            yield _row(r["block"], r["island"], np.frombuffer(r["uids"], np.int64), size, evolve(size, pop, CHILDREN, limit, r["block"] * 13 + r["island"] + 1), limit)

    state = scratch.save(arrow_map(start, begin, _STATE))
    for _ in range(EPOCHS - 1):
        guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        new = scratch.save(arrow_map(state.join(guests, ["block", "island"], "left").repartition("block", "island"), go_on, _STATE))
        scratch.drop(state)
        state = new
    best = state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", "elite"), F.struct("bins", -F.col("fill"), "island")).alias("b")).select("block", "b.*")

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            uids, size, into = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["elite"], np.int32)
            order = np.argsort(into, kind="stable")
            total = np.cumsum(size[order]) - size[order]
            first = np.searchsorted(into[order], into[order])
            fill = np.bincount(into, size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(np.full(len(uids), r["block"])), pa.array(into[order].astype(np.int64)), pa.array(total - total[first]), pa.array(fill[into[order]])], ["uid", "block", "bin", "offset", "fill"])

    return scratch.save(arrow_map(best, places, "uid long, block long, bin long, offset long, fill long"))


def pieces(docs: DataFrame, tokenizer: str, drops_space: bool, end: int, limit: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, binary, unsigned 32-bit): documents cut at the limit."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(1))
        for a, b, ids, o in units.encoded(raw, off, tokenizer, drops_space, end, slices(off, 1_500_000)):
            count = -(-np.diff(o) // limit)
            doc = np.repeat(np.arange(b - a), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * limit
            length = np.minimum(limit, np.diff(o)[doc] - start)
            at = o[doc] + start
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = np.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)], np.int64)
            cols = [batch.column(0).take(pa.array(doc + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if keep_ids:
                cols.append(binary(ids, np.append(at, len(ids))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    fields = T._parse_datatype_string("piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids).fields
    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields])
    return arrow_map(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text__")), run, kind)


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 1, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every document's tokens in few sequences.

    A document is its ids and then ``end``; only one of more than ``limit`` ids is cut, into pieces of ``limit`` and a
    last one. The pieces of a sequence stand gapless from offset 0. A null or empty text is the end id alone. Rows with
    a null or repeated id are documents of their own. An empty table gives no rows.
    """
    tune(spark)
    scratch = Scratch(spark, "packing")
    p = scratch.save(pieces(docs, tokenizer, drops_space, end, limit, id_col, text_col, keep_ids).withColumn("uid", F.monotonically_increasing_id()))
    one = assign(scratch, p.where(F.col("length") < limit).select("uid", "length"), limit, 0)
    loose = one.where(F.col("fill") < FULL * limit)
    good = one.where(F.col("fill") >= FULL * limit).select("uid", ((F.col("block") * BLOCK * 64 + F.col("bin")) * 3).alias("sequence_id"), "offset")
    two = assign(scratch, loose.select("uid").join(p.select("uid", "length"), "uid"), limit, 1)
    again = two.select("uid", ((F.col("block") * BLOCK * 64 + F.col("bin")) * 3 + 1).alias("sequence_id"), "offset")
    placed = good.unionByName(again)
    full = p.where(F.col("length") == limit).select(*p.columns, (F.col("uid") * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = p.where(F.col("length") < limit).join(placed, "uid").select(*p.columns, "sequence_id", "offset")
    return full.unionByName(rest).drop("uid")
