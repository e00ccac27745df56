"""Exact top-k search by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, Scratch, arrow_map, binary, settings, tune

#: Rows in a block of candidates, and queries in a block of queries.
CANDIDATES, QUERIES = 8192, 256
#: Blocks of candidates and of queries that meet in one group, about.
MEET_CANDIDATES, MEET_QUERIES = 4, 8
#: Shares of every list that have been read after each round.
ROUNDS = (0.5, 0.8, 0.9, 1.0)
#: Queries of a block of candidates that try all rounds; the others start with the first round that ended one of these.
FIRST = 8
#: Sums under these are exact in floats of 32 bits and in doubles.
EXACT = ((2**24, np.float32), (2**52, np.float64))


class Lists:
    """The components of a block of rows as one sorted list for each dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.n, self.dims = x.shape
        self.order = np.argsort(x, axis=0, kind="stable")
        self.ranked = np.take_along_axis(x, self.order, axis=0)
        rank = np.empty_like(self.order)
        np.put_along_axis(rank, self.order, np.arange(self.n)[:, None].repeat(self.dims, 1), axis=0)
        self.rank = rank
        #: Share of the entries of their lists that the queries so far have read, summed over queries; the round to start with.
        self.read, self.start = 0.0, None

    def top(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of ``q`` the row numbers and scores of its k best, ties to smaller ids; ``own``: the query's id.

        A list is read from the end at which its product with the query is largest, round by round, and each entry once:
        a round adds what it reads. A candidate's bounds take for each list that hasn't shown it the last product read (at
        most) and the product at the far end (at least). A query stops once few candidates have an upper bound that
        reaches its k-th lower bound; their scores are then resolved.
        """
        most = self.dims * max(1, int(np.abs(self.x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
        kind = next((t for bound, t in EXACT if 4 * most < bound), None)
        if kind is None or self.n <= 4 * k:  # sums that doubles can't hold, or few candidates
            self.read += len(q)
            return [self.resolve(np.flatnonzero(self.ids != i), v, k) for i, v in zip(own, q, strict=True)]
        found = []
        if self.start is None:
            self.start, ended = 0, [0] * len(ROUNDS)
            found = self._rounds(q[:FIRST], own[:FIRST], k, kind, ended)
            self.start = next((i for i, n in enumerate(ended) if n), 0)
        return found + self._rounds(q[len(found) :], own[len(found) :], k, kind, [0] * len(ROUNDS))

    def _rounds(self, q: np.ndarray, own: np.ndarray, k: int, kind: type, ended: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [None] * len(q)
        left = np.arange(len(q))
        pos, neg = np.maximum(q, 0).T.astype(kind), np.minimum(q, 0).T.astype(kind)
        values, ranked = self.x.astype(kind), self.ranked.astype(kind)
        ends = np.vstack([pos * ranked[:1].T, neg * ranked[-1:].T])  # the far ends of lists read downwards, upwards
        weight = np.vstack([pos, neg, -ends])
        mine = self.ids[:, None] == own[None, :]
        got = np.zeros((self.n, len(q)), kind)  # by candidate: what has been read, less the far ends of those lists
        done_at = 0
        for number, share in list(enumerate(ROUNDS))[self.start :]:
            depth = max(1, int(np.ceil(self.n * share)))
            shown = np.hstack([self.rank >= self.n - depth, self.rank < depth])
            new = shown & ~np.hstack([self.rank >= self.n - done_at, self.rank < done_at]) if done_at else shown
            got += np.hstack([values * new[:, : self.dims], values * new[:, self.dims :], new]) @ weight[:, left]
            last = np.vstack([pos[:, left] * ranked[self.n - depth][:, None], neg[:, left] * ranked[depth - 1][:, None]])
            far = ends[:, left].sum(axis=0)
            low = np.where(mine[:, left], -np.inf, got)
            floor = np.partition(low, self.n - k, axis=0)[self.n - k] + far
            # Listed products less their far ends, and what lists that haven't shown the candidate can still add to those.
            open_ = (got + far + (~shown).astype(kind) @ (last - ends[:, left]) >= floor) & ~mine[:, left]
            done = open_.sum(axis=0) <= max(8 * k, self.n // 16) if share < 1 else np.ones(len(left), bool)
            for j in np.flatnonzero(done):
                out[left[j]] = self.resolve(np.flatnonzero(open_[:, j]), q[left[j]], k)
            self.read += share * int(done.sum())
            ended[number] += int(done.sum())
            left, got, done_at = left[~done], got[:, ~done], depth
            if not len(left):
                break
        return out

    def resolve(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.x[rows] @ q
        best = np.lexsort((self.ids[rows], -score))[:k]
        return rows[best], score[best]


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (block, dims, ids, vectors) of at most ``size`` vectors; within a block all have the same length."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = batch.column(1)
        off = v.offsets.to_numpy()
        flat = v.values.to_numpy(zero_copy_only=False)[: off[-1]]
        ids, length = batch.column(0).to_numpy(), np.diff(off)
        for d in np.unique(length):
            rows = np.flatnonzero(length == d)
            for a in range(0, len(rows), size):
                r = rows[a : a + size]
                got = flat[(off[r][:, None] + np.arange(d)).ravel()] if d else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), binary(ids[r], [0, len(r)]), binary(got.astype(np.int64), [0, len(got)])], ["dims", "ids", "vectors"])

    return arrow_map(df.select("id", "v"), pack, "dims int, ids binary, vectors binary").withColumn("block", F.monotonically_increasing_id())


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k largest integer inner products of each query over all vectors but its own: query_id, rank, vec_id, score.

    Components become floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component take no
    part. Vectors of another length than the query's aren't compared; an empty table gives no rows. Of rows that share
    an id, each counts as a candidate, and none is a candidate of a query with that id. Of queries that share an id, the
    one with the smallest vector is answered. Other columns are ignored.

    Candidates and queries become packed blocks. Every block of either must meet every one of the other; a few of each meet
    in a group, so no key has all of them, and only k rows for each query and candidate block are shuffled on.
    """
    tune(spark)
    with settings(spark, {BATCH: CANDIDATES}):
        scratch = Scratch(spark, "topk")

        def whole(df: DataFrame) -> DataFrame:
            v = F.col(vector_col)
            fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            return df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

        parts = max(2, spark.sparkContext.defaultParallelism)
        c = scratch.save(_blocks(whole(vectors), CANDIDATES))
        q = scratch.save(_blocks(whole(queries).groupBy("id").agg(F.min("v").alias("v")).coalesce(parts), QUERIES))
    with settings(spark, {BATCH: 1}):  # a row is a block
        return scratch.only(scratch.save(_best(c, q, k)))


def _best(c: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """The k best of each query over candidate blocks ``c`` and query blocks ``q`` (block, dims, ids, vectors)."""
    cs, qs = c.count(), q.count()
    # As many groups as tasks can run, while blocks are few.
    c_salts, q_salts = max(1, -(-cs // MEET_CANDIDATES), min(cs, c.sparkSession.sparkContext.defaultParallelism)), max(1, -(-qs // MEET_QUERIES))
    salt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = c.withColumn("x", salt(c_salts)).withColumn("y", every(q_salts)).drop("block")
    right = q.withColumn("y", salt(q_salts)).withColumn("x", every(c_salts)).drop("block")

    def answer(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, vec_ids, scores = [], [], []
        for row in candidates.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            lists = Lists(np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dims"]), ids) if asked.num_rows else None
            for ask in asked.to_pylist():
                q_ids = np.frombuffer(ask["ids"], np.int64)
                found = lists.top(np.frombuffer(ask["vectors"], np.int64).reshape(len(q_ids), row["dims"]), q_ids, k)
                query_ids.append(np.repeat(q_ids, [len(r) for r, _ in found]))
                vec_ids += [ids[r] for r, _ in found]
                scores += [s for _, s in found]
        flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        return pa.table([flat(query_ids), flat(vec_ids), flat(scores)], ["query_id", "vec_id", "score"])

    keys = ("dims", "x", "y")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
