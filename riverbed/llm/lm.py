"""Language-model scoring with Brown's class-based bigrams.

The most frequent words are put into classes by the exchange algorithm: each word in turn moves to the class that gains
most average mutual information between neighbouring classes. Every other word of the training text joins the class whose
neighbours it shares. Then all words are exchanged, in passes over all blocks of text in which they move at once. A text's
probability is the product of class transitions and of word emissions; what absolute discounting takes from a class's
words is its chance of a word unseen in training.

Texts become blocks of word numbers with a dictionary of their own, so only distinct words of a block are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import BATCH, Scratch, arrow_map, binary, pack, settings, slices, text_buffer, tidy, tune

#: Words that the exchange algorithm starts from, classes, sweeps over the words; bytes of text in a block.
CORE, CLASSES, SWEEPS, BLOCK_BYTES = 1000, 32, 6, 3_000_000
#: Passes in which then all words change classes, at once in each pass.
PASSES = 2
#: A word's gain is worked out in full from so many occurrences on; below, to first order in its counts.
EXACT = 100
#: Words meet in parts, one for so many blocks, and a part is held in memory.
PART_BLOCKS = 6
MET = "part int, block long, h binary, i binary, c binary, w binary, n binary, e binary"
#: The end of a text is a token, and a class of its own.
END = 0x454E44
PULL = 4.0


def block_of(parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """One row: ids, train flags, text offsets and word numbers of a block, and its dictionary (hashes, training counts)."""
    ids = pa.concat_arrays([p[0] for p in parts])
    train = np.concatenate([p[1] for p in parts])
    n = np.concatenate([p[3] for p in parts])
    words, local = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    local = local.astype(np.int32)
    count = np.bincount(local[np.repeat(train, n)], minlength=len(words))
    list_of = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([list_of, pack([train.astype(np.uint8)]), pack([np.concatenate([[0], np.cumsum(n)])]), pack([local]), pack([words]), pack([count.astype(np.int64)])], names)


def tokens_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts back to back, each text with its end, and how many each has."""
    starts, ends, by = rolling.words(raw, off)
    n = np.diff(by) + 1
    tokens = np.full(int(n.sum()), END, np.uint64)
    word = np.ones(len(tokens), bool)
    word[np.cumsum(n) - 1] = False
    tokens[word] = rolling.word_hashes(raw, starts, ends, True)
    return tokens, n


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (id, train, text), with a block number to be written."""
    names = ["ids", "train", "off", "tokens", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            raw, off = text_buffer(b.column(2))
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(off, 1_000_000):
                held.append((b.column(0).slice(lo, hi - lo), train[lo:hi], *tokens_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
                size += int(off[hi] - off[lo])
                if size >= BLOCK_BYTES:
                    yield block_of(held, names)
                    held, size = [], 0
        if held:
            yield block_of(held, names)

    kind = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), *(T.StructField(n, T.BinaryType()) for n in names[1:])])
    return docs.select("id", "train", "text").mapInArrow(tidy(run), kind).withColumn("block", F.monotonically_increasing_id())


@dataclass
class Block:
    """A block row's arrays, read from columns train, off, tokens, and words and counts where they are needed."""

    train: np.ndarray
    off: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Block:
        get = lambda name, kind: np.frombuffer(r.get(name, b""), kind)
        return cls(get("train", np.uint8).astype(bool), get("off", np.int64), get("tokens", np.int32), get("words", np.uint64), get("counts", np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the training tokens, and for each the place before it, or -1 at a text's start."""
        n = np.diff(self.off)
        at = np.flatnonzero(np.repeat(self.train, n))
        first = np.zeros(len(self.tokens), bool)
        first[self.off[:-1]] = True
        return at, np.where(first[at], -1, at - 1)


def gains(big: np.ndarray, right: np.ndarray, left: np.ndarray, s: float, classes: int) -> np.ndarray:
    """What each class gains by a word with these neighbours, ``s`` times its own one; ``big`` is without the word."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    nb = big[:classes]
    gain = (f(nb + right) - f(nb)).sum(axis=1) + (f(big[:, :classes].T + left) - f(big[:, :classes].T)).sum(axis=1)
    d = np.arange(classes)
    dd = big[d, d]
    gain += f(dd + right[d] + left[d] + s) - f(dd) - (f(dd + right[d]) - f(dd)) - (f(dd + left[d]) - f(dd))
    row, col = big.sum(axis=1)[:classes], big.sum(axis=0)[:classes]
    return gain - (f(row + right.sum() + s) - f(row) + f(col + left.sum() + s) - f(col))


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of words 0 .. n - 1 from bigram counts (n + 2 square: then other words, then text ends, classes of their own)."""
    n = len(counts) - 2
    if n <= 0:
        return np.zeros(0, np.int64)
    classes = min(classes, n)
    own = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    one = np.zeros((n + 2, classes + 2))
    one[np.arange(n + 2), own] = 1
    big = one.T @ counts @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a = own[w]
            right = np.bincount(own, counts[w], classes + 2)
            left = np.bincount(own, counts[:, w], classes + 2)
            s = counts[w, w]
            right[a] -= s
            left[a] -= s  # now without w itself
            big[a] -= right
            big[:, a] -= left
            big[a, a] -= s
            b = int(np.argmax(gains(big, right, left, s, classes)))
            own[w] = b
            moved += b != a
            big[b] += right
            big[:, b] += left
            big[b, b] += s
        if not moved:
            break
    return own[:n]


def _sparse(keys: np.ndarray, names: tuple[str, str] = ("k", "c")) -> pa.RecordBatch:
    k, c = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], list(names))


def short(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers from 0 as one binary value for each of the ranges between ``cuts``, seven bits to a byte."""
    n = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(off[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        m = n > k
        out[off[:-1][m] + k] = x[m] >> 7 * k & 127 | (n[m] > k + 1) << 7
    return binary(out, off[cuts])


def steps_of(i: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, anew from each cut: small, so they are short."""
    d = np.diff(i, prepend=0)
    first = cuts[cuts < len(i)]
    d[first] = i[first]
    return d


def values_of(parts: list[bytes]) -> list[np.ndarray]:
    """The numbers of each of some values of :func:`short`."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    place = np.arange(len(b)) - np.repeat(start, end + 1 - start)
    v = np.add.reduceat((b & 127).astype(np.int64) << 7 * place, start) if len(end) else np.zeros(0, np.int64)
    return np.split(v, np.searchsorted(end, np.cumsum([len(x) for x in parts])[:-1])) if parts else []


def flat(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *values_of(parts)])


def numbers(parts: list[bytes]) -> np.ndarray:
    """All the numbers of :func:`steps_of`."""
    return np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, values_of(parts))])


def neighbours_of(b: Block, cls: np.ndarray, free: np.ndarray, m: int, parts: int, block: int, rank: np.ndarray | None = None) -> pa.RecordBatch:
    """A block's words dealt over ``parts``: hash, number, training count, class, and of those that are ``free`` how often
    each class (``cls`` by word, the last of ``m`` is a text's end) stands on the left (0 to m - 1) and on the right (m to
    2 m - 1), and how often the word itself on the left (2 m).

    An entry is a count below 512 in the high bits and a class in the low 7; larger counts take several entries. With
    ``rank``, each word's number within its part, words go by it and not by hash, and those without one (-1) not at all.
    """
    size, tok = len(b.words), b.tokens.astype(np.int64)
    at, before = b.pairs()
    inner = before >= 0
    wide = 2 * m + 1
    left = tok[at] * wide + np.where(inner, cls[tok[before]], m - 1)
    right = tok[before[inner]] * wide + m + cls[tok[at[inner]]]
    twin = tok[at[inner & (tok[at] == tok[before])]]
    found, times = np.unique(np.concatenate([left[free[tok[at]]], right[free[tok[before[inner]]]], twin[free[twin]] * wide + 2 * m]), return_counts=True)
    again = (times + 510) // 511
    last = np.cumsum(again) - 1
    found = np.repeat(found, again)
    amount = np.full(len(found), 511)
    amount[last] = times - 511 * (again - 1)
    word = found // wide
    entry = (amount << 7 | found % wide).astype(np.uint16)
    n = np.bincount(word, minlength=size).astype(np.int32)
    part = (b.words >> np.uint64(17)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    if rank is not None:
        order = order[rank[order] >= 0]
    place = np.empty(size, np.int64)
    place[order] = np.arange(len(order))
    entry = entry[np.argsort(place[word], kind="stable")]
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    ends = np.concatenate([[0], np.cumsum(n[order])])[cuts]
    some = np.flatnonzero(np.diff(cuts))
    at = np.append(cuts[some], len(order))
    # A block has its words in the order of their hashes, and so has a part its ranks: both rise.
    named = binary(b.words[order], at) if rank is None else short(steps_of(rank[order], cuts[some]), at)
    cols = [named, short(steps_of(order, cuts[some]), at), short(b.counts[order], at), binary(cls[order].astype(np.uint8), at), short(n[order], at)]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), *cols, binary(entry, np.append(ends[some], len(entry)))], ["part", "block", "h", "i", "c", "w", "n", "e"])


def parts_of(batches: Iterator[pa.RecordBatch], ranked: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Word hashes (or ranks), blocks, numbers, counts, classes, numbers of entries and the entries of each part, from rows
    sorted by part."""
    held, part = [], None

    def joined() -> tuple[np.ndarray, ...]:
        w, e = (np.frombuffer(b"".join(r[x] for r in held), kind) for x, kind in (("w", np.uint8), ("e", np.uint16)))
        i, c, n = numbers([r["i"] for r in held]), flat([r["c"] for r in held]), flat([r["n"] for r in held])
        h = numbers([r["h"] for r in held]) if ranked else np.frombuffer(b"".join(r["h"] for r in held), np.uint64)
        return h, np.repeat([r["block"] for r in held], [len(r["w"]) for r in held]), i, c, w, n, e

    for b in batches:
        for r in b.to_pylist():
            if held and r["part"] != part:
                yield joined()
                held = []
            part = r["part"]
            held.append(r)
    if held:
        yield joined()


def likeliest(at: np.ndarray, n: np.ndarray, e: np.ndarray, logs: np.ndarray, size: int, was: np.ndarray | None = None, big: np.ndarray | None = None) -> np.ndarray:
    """The class of each of ``size`` words whose neighbours speak most for it: entries ``e``, ``n`` to a row, row's word ``at``.

    With class bigram counts ``big``, words of EXACT occurrences leave class ``was`` for the one that gains most.
    """
    m = len(logs)
    word = np.repeat(at, n)
    order = np.argsort(word, kind="stable")
    word, e = word[order], e[order]
    out = np.zeros(size, np.int64)
    for a in range(0, size, 20_000):
        z = min(size, a + 20_000)
        lo, hi = np.searchsorted(word, [a, z])
        near = np.bincount((word[lo:hi] - a) * (m + 1) + (e[lo:hi] & 127), e[lo:hi] >> 7, (z - a) * (m + 1)).reshape(z - a, m + 1)
        out[a:z] = (near[:, :m] @ logs).argmax(axis=1)
        if big is None:
            continue
        for j in np.flatnonzero(near[:, : m // 2].sum(axis=1) >= EXACT):
            left, right, s, own = near[j, : m // 2], near[j, m // 2 : m], near[j, m], was[a + j]
            left[own] -= s
            right[own] -= s
            rest = big.copy()
            rest[own] -= right
            rest[:, own] -= left
            rest[own, own] -= s
            out[a + j] = gains(rest, right, left, s, logs.shape[1]).argmax()
    return out


def answers(block: np.ndarray, i: np.ndarray, c: np.ndarray, at: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block its words that occur in training: their numbers, then count, class and whether it is the word's first
    block, and their ranks in the part."""
    total = np.zeros(len(cls), np.int64)
    np.add.at(total, at, c)
    first = np.zeros(len(at), bool)
    first[np.unique(at, return_index=True)[1]] = True
    v = total[at] << 7 | cls[at] << 1 | first
    order = np.flatnonzero(total[at] > 0)
    order = order[np.argsort(block[order], kind="stable")]
    blocks, cuts = np.unique(block[order], return_index=True)
    cuts = np.append(cuts, len(order))
    yield pa.RecordBatch.from_arrays([pa.array(blocks), short(steps_of(i[order], cuts[:-1]), cuts), short(v[order], cuts), short(steps_of(at[order], cuts[:-1]), cuts)], ["block", "i", "v", "r"])


def looked_up(n: pa.Scalar, i: pa.Scalar, v: pa.Scalar, r: pa.Scalar | None = None) -> tuple[np.ndarray, ...]:
    """Training count, class (-1 if it has none), the first block's mark and, with ``r``, rank (-1) of a block's ``n`` words."""
    size = n.as_py()
    count, cls, first, rank = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool), np.full(size, -1, np.int64)
    if i.is_valid:
        at, x = numbers(i.as_py()), flat(v.as_py())
        count[at], cls[at], first[at] = x >> 7, x >> 1 & 63, x & 1
        if r is not None:
            rank[at] = numbers(r.as_py())
    return count, cls, first, rank


@dataclass
class Model:
    """Log-probabilities (base 10): transitions between classes, unseen words by class; counts and discounts of classes."""

    step: np.ndarray
    total: np.ndarray
    discount: np.ndarray
    unseen: np.ndarray

    def __post_init__(self):
        joint = self.step + self.unseen[None, :]
        self.unseen_after = np.log10(np.maximum((10**joint).sum(axis=1), 1e-300))
        self.class_after = joint.argmax(axis=1)

    def score(self, b: Block, count: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 probability of each token; ``count`` and ``own`` (class, -1 if unseen) by word of the block's dictionary."""
        cls = own[b.tokens]
        end = len(self.step) - 1
        before = np.empty(len(cls), np.int64)
        before[1:] = cls[:-1]
        before[b.off[:-1]] = end
        # Unseen words take the likeliest class; in a run of them, one after the other.
        new = np.flatnonzero(cls < 0)
        if len(new):
            fresh = np.ones(len(new), bool)
            fresh[1:] = (new[1:] != new[:-1] + 1) | (before[new[1:]] == end)
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(new)), 0))
            depth = np.arange(len(new)) - run_start
            order = np.argsort(depth, kind="stable")
            cuts = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                at = new[order[a:z]]
                cls[at] = self.class_after[before[at]]
                nxt = at + 1
                nxt = nxt[nxt < len(cls)]
                nxt = nxt[before[nxt] < 0]
                before[nxt] = cls[nxt - 1]
        known = own[b.tokens] >= 0
        c = count[b.tokens]
        with np.errstate(divide="ignore"):
            seen = self.step[before, cls] + np.log10(np.maximum(c - self.discount[cls], 1e-9)) - np.log10(np.maximum(self.total[cls], 1))
        return np.where(known, seen, self.unseen_after[before])


def _model(moves: np.ndarray, classes: list) -> Model:
    """From class bigram counts and (cls, total, types, once, twice) rows; the last class is the end of a text."""
    n = len(moves)
    total, types, once, twice = (np.zeros(n) for _ in range(4))
    for r in classes:
        total[r["cls"]], types[r["cls"]], once[r["cls"]], twice[r["cls"]] = r["total"], r["types"], r["once"], r["twice"]
    prior = (moves.sum(axis=0) + 0.5) / (moves.sum() + 0.5 * n)
    step = (moves + PULL * prior[None, :]) / (moves.sum(axis=1, keepdims=True) + PULL)
    d = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
    d[-1] = 0  # one token only
    unseen = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
    unseen[-1] = 0
    return Model(np.log10(step), total, d, np.log10(np.maximum(unseen, 1e-300)))


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    Words are runs between ASCII white space, A to Z lower-cased; the end of a text is a token too, so a null or empty
    text has one. The model learns from rows whose crc32 of the id as text is not 1 modulo 5 (a null id counts as
    such). ``base_score`` is the add-half unigram, ``score`` the class model, both log10 over the training words and one
    unseen word. Without training text both are equal. Repeated rows count and are scored each for itself.
    """
    if classes > 61:
        raise ValueError("61 classes at most")  # what the packed entries hold
    tune(spark)
    # A row is a block of text, and a batch is one row, until the scores are written.
    with settings(spark, {BATCH: 1}):
        scratch = Scratch(spark, "lm")
        return scratch.only(scratch.save(_scores(spark, scratch, docs, id_col, text_col, core, classes)))


def _scores(spark: SparkSession, scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, core: int, classes: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    t = scratch.save(blocks(docs.select(F.col(id_col).alias("id"), (~held).alias("train"), F.coalesce(text_col, F.lit("")).alias("text"))))
    cols = ("train", "off", "tokens", "words", "counts")
    parts = max(8, t.count() // PART_BLOCKS)

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "part").sortWithinPartitions("part")

    def dealt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            b = Block.of(r)
            none = np.zeros(len(b.words), bool)
            yield neighbours_of(b, none.astype(np.int64), none, 1, parts, r["block"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _, c, *_ in parts_of(batches):
            words, at = np.unique(h, return_inverse=True)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, at, c)
            total[words == END] = 0
            best = np.lexsort((words.view(np.int64), -total))[:core]
            best = best[total[best] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(words[best].view(np.int64)), pa.array(total[best])], ["h", "c"])

    # All of a word's blocks meet in one part, so its count there is exact.
    named = met(arrow_map(t.select("block", *cols), dealt, MET)).mapInArrow(tidy(counted), "h long, c long")
    top = np.array([r["h"] for r in named.orderBy(F.desc("c"), "h").limit(core).collect()], np.int64).view(np.uint64)  # `core` rows
    scratch.collect()
    heart, k = np.sort(top), len(top)

    def place(words: np.ndarray) -> np.ndarray:
        """Number in the core; k for other words, k + 1 for the end."""
        at = np.searchsorted(heart, words)
        out = np.where((at < k) & (heart[np.minimum(at, max(k - 1, 0))] == words if k else np.zeros(len(words), bool)), at, k)
        return np.where(words == END, k + 1, out)

    def neighbours(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            b = Block.of(r)
            p = place(b.words)[b.tokens]
            at, before = b.pairs()
            yield _sparse(np.where(before < 0, k + 1, p[before]) * (k + 2) + p[at])

    pairs = scratch.save(arrow_map(t.select(*cols), neighbours, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))
    with settings(spark, {BATCH: 100_000}):
        pairs = pairs.toArrow()  # (core + 2)**2 rows at most
    counts = np.zeros((k + 2) ** 2)
    counts[pairs["k"].to_numpy()] = pairs["c"].to_numpy()
    counts = counts.reshape(k + 2, k + 2)
    own = exchange(counts, classes, SWEEPS)
    n_cls = min(classes, k) if k else 1
    # What a class's members have as neighbours, for the votes: classes, other words, ends.
    group = np.concatenate([own, [n_cls, n_cls + 1]]).astype(np.int64)
    one = np.zeros((k + 2, n_cls + 2))
    one[np.arange(k + 2), group] = 1
    big = one.T @ counts @ one + 0.5
    steps = np.log(big / big.sum(axis=1, keepdims=True))

    logs = np.concatenate([steps[:, :n_cls], steps[:n_cls].T])  # by what stands on the left and on the right

    def seen(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            b = Block.of(r)
            p = place(b.words)
            yield neighbours_of(b, group[p], p == k, n_cls + 2, parts, r["block"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, block, i, c, _, n, e in parts_of(batches):
            words, at = np.unique(h, return_inverse=True)
            p = place(words)
            cls = np.where(p < k, own[np.minimum(p, k - 1)] if k else 0, n_cls)
            free = np.flatnonzero(p == k)
            cls[free] = likeliest(at, n, e, logs, len(words))[free]
            yield from answers(block, i, c, at, cls)

    def told(rows: DataFrame, settle: Callable) -> DataFrame:
        said = met(rows).mapInArrow(tidy(settle), "block long, i binary, v binary, r binary")
        answered = said.groupBy("block").agg(F.collect_list(F.struct("i", "v", "r")).alias("a"))
        return scratch.save(answered.select("block", "a.i", "a.v", "a.r"))

    # Every block's words meet once by word, in parts of the words, and go back with count and class. A word takes its
    # class from its neighbours in all blocks.
    dictionary = told(arrow_map(t.select("block", *cols), seen, MET), settled)
    scratch.collect()

    def joined(*names: str) -> DataFrame:
        return t.select("block", *names, (F.octet_length("words") / 8).cast("int").alias("n")).join(dictionary, "block", "left")

    def again(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Neighbours by the classes of all words, and the block's class bigrams as part -1."""
        for j in range(batch.num_rows):
            b = Block.of({c: batch.column(c)[j].as_py() for c in cols})
            _, cls, _, rank = looked_up(*(batch.column(c)[j] for c in ("n", "i", "v", "r")))
            block = batch.column("block")[j].as_py()
            yield neighbours_of(b, np.maximum(cls, 0), (b.words != END) & (rank >= 0), n_cls + 1, parts, block, rank)
            at, before = b.pairs()
            x = np.where(before < 0, n_cls, cls[b.tokens[before]]) * (n_cls + 1) + cls[b.tokens[at]]
            empty = pack([np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block]), empty, empty, pack([np.bincount(x, minlength=(n_cls + 1) ** 2)]), *[empty] * 3], ["part", "block", "h", "i", "c", "w", "n", "e"])

    def bigrams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x in batch.column(0).to_pylist():
            c = np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(c)], ["k", "c"])

    for _ in range(PASSES if k else 0):
        # Written, so that blocks and parts are not shuffled at one time.
        moved = scratch.save(arrow_map(joined(*cols), again, MET))
        scratch.drop(dictionary)
        big = np.zeros((n_cls + 1) ** 2)
        for r in arrow_map(moved.where("part = -1").select("c"), bigrams, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():  # (classes + 1)**2 rows
            big[r["k"]] = r["c"]
        big = big.reshape(n_cls + 1, n_cls + 1)
        near = np.log(big + 0.5)
        near = np.concatenate([(near - np.log(big.sum(axis=0) + 0.5))[:, :n_cls], (near.T - np.log(big.sum(axis=1) + 0.5))[:, :n_cls]])

        def exchanged(batches: Iterator[pa.RecordBatch], near=near, big=big) -> Iterator[pa.RecordBatch]:
            for at, block, i, c, w, n, e in parts_of(batches, ranked=True):
                was = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
                was[at] = w
                cls = np.where(was == n_cls, n_cls, likeliest(at, n, e, near, len(was), was, big))
                yield from answers(block, i, c, at, cls)

        dictionary = told(moved.where("part >= 0"), exchanged)
        scratch.drop(moved)
    cols = ("train", "off", "tokens")
    # Joined for each of the two passes that are left: writing it would take more room than moving it twice.
    full = joined("ids", *cols).drop("block")

    def transitions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Class bigrams, and after them each class's total, types, and words seen once and twice."""
        for j in range(batch.num_rows):
            b = Block.of({c: batch.column(c)[j].as_py() for c in cols})
            count, cls, first, _ = looked_up(*(batch.column(c)[j] for c in ("n", "i", "v")))
            at, before = b.pairs()
            yield _sparse(np.where(before < 0, n_cls, cls[b.tokens[before]]) * (n_cls + 1) + cls[b.tokens[at]])
            of = lambda x: np.bincount(cls[first], x[first], n_cls + 1)
            kinds = np.concatenate([of(count), of(count > 0), of(count == 1), of(count == 2)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((n_cls + 1) ** 2 + np.arange(len(kinds))), pa.array(kinds)], ["k", "c"])

    sums = np.zeros((n_cls + 1) * (n_cls + 5))
    for r in arrow_map(full.drop("ids"), transitions, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():  # (classes + 1) * (classes + 5) rows
        sums[r["k"]] = r["c"]
    moves, kinds = sums[: (n_cls + 1) ** 2].reshape(n_cls + 1, n_cls + 1), sums[(n_cls + 1) ** 2 :].reshape(4, n_cls + 1).astype(np.int64)
    big_n, big_v = int(kinds[0].sum()), int(kinds[1].sum())
    model = _model(moves, [dict(zip(("cls", "total", "types", "once", "twice"), (j, *x), strict=True)) for j, x in enumerate(kinds.T.tolist())])
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for j in range(batch.num_rows):
            b = Block.of({c: batch.column(c)[j].as_py() for c in cols})
            count, cls, _, _ = looked_up(*(batch.column(c)[j] for c in ("n", "i", "v")))
            c = count[b.tokens]
            base = np.log10((count + 0.5) / (big_n + 0.5 * (big_v + 1)))[b.tokens]
            s = model.score(b, count, cls) if big_n else base
            at = b.off[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("ids")[j].values, pa.array(~b.train), pa.array(np.diff(b.off)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(s, at))], names)

    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])
    out = arrow_map(full, run, kind).withColumn("train_tokens", F.lit(int(big_n)).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
