"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import arrow_map, pack, slices, text_buffer, tidy, tune

#: Labelled documents that training takes at most: those with the smallest hash of their id.
MAX_TRAINING = 8_000
#: Bytes of text that training takes at most, over all those documents; longer texts than 16 times the mean share stay out.
MAX_TRAINING_BYTES = 32_000_000
#: A word is seen whole and by its first bytes of these lengths, so inflected forms share evidence.
PREFIXES = (4, 5, 6)
#: Features are hashed; the table of weights has 2**BITS entries.
BITS = 22
#: A feature is used if its log odds between toxic and clean documents are so many standard errors from none. Few labels
#: leave few such features; then the FEATURES strongest are used, down to WEAK standard errors.
SCREEN, WEAK, FEATURES = 3.5, 2.0, 64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n|"]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence of each feature, document of each sentence, first byte of each sentence).

    A word is a run of letters and digits, lower-cased; ``. ! ? |`` and line ends close a sentence. Every document has
    a sentence at least, so an empty text has a score.
    """
    n = len(raw)
    inside = _LETTER[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    s = rolling.prefix(rolling.LOWER[raw])
    long_ = {k: np.flatnonzero(ends - starts > k) for k in PREFIXES}
    hashed = [rolling.spans(s, starts, ends), *(rolling.spans(s, starts[w], starts[w] + k) + np.uint64(k << 44) for k, w in long_.items())]
    feature = (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int32)
    starts = np.concatenate([starts, *(starts[w] for w in long_.values())])
    opens = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(_STOP[raw]) + 1]))
    opens = opens[opens < n] if n else opens[:0]
    doc = np.searchsorted(offsets, opens, side="right") - 1
    word_sentence = np.searchsorted(opens, starts, side="right") - 1
    has = np.bincount(word_sentence, minlength=len(opens)) > 0
    bare = np.setdiff1d(np.arange(len(offsets) - 1), doc[has])  # documents without a word: one sentence with none
    renumber = np.cumsum(has) - 1
    return feature, renumber[word_sentence], np.concatenate([doc[has], bare]), np.concatenate([opens[has], offsets[bare]])


def noisy_or(z: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentence log-odds to (log of the chance that no sentence is toxic, by document; sentence probabilities)."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs), p


@dataclass
class Model:
    """Weights of the features that are used; all others count for nothing."""

    used: np.ndarray
    values: np.ndarray
    bias: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "weights"}

    @cached_property
    def weights(self) -> np.ndarray:
        """The whole table, made where texts are scored."""
        w = np.zeros(1 << BITS, np.float32)
        w[self.used] = self.values
        return w

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(sentence, self.weights[feature], n) + self.bias

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document scores, and for each document the first byte of its most toxic sentence."""
        if not len(self.used):  # nothing was learnt: the share of toxic documents for all
            return np.full(len(offsets) - 1, 1 / (1 + math.exp(-self.bias))), np.zeros(len(offsets) - 1, np.int64)
        feature, sentence, doc, opens = features(raw, offsets)
        z = self.sentences(feature, sentence, len(doc))
        none, _ = noisy_or(z, doc, len(offsets) - 1)
        order = np.lexsort((-z, doc))
        first = order[np.searchsorted(doc[order], np.arange(len(offsets) - 1))]
        return np.clip(-np.expm1(none), 0.0, 1.0), opens[first] - offsets[:-1]


def fit(texts: list[str], labels: list[int], rounds: int = 40, l2: float = 2e-5, seed: int = 5) -> Model:
    """Weights that maximise the noisy-or likelihood of the document labels (Adam on mini-batches).

    Without both labels the model is constant: the smoothed share of toxic documents.
    """
    y = np.asarray(labels, dtype=float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(rate / (1 - rate)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), bias)
    data = [x.encode() for x in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    cuts = [(a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1_000_000)]
    with_, without = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)  # documents of either label
    for a, _, part, off in cuts:
        f, sentence, doc, _ = features(part, off)
        both = np.unique(doc[sentence].astype(np.int64) << BITS | f)
        f, own = both & ((1 << BITS) - 1), y[a + (both >> BITS)] > 0
        with_ += np.bincount(f[own], minlength=1 << BITS).astype(np.int32)
        without += np.bincount(f[~own], minlength=1 << BITS).astype(np.int32)
    some = np.flatnonzero(with_ + without >= 4)
    p1, p0 = with_[some] + 0.5, without[some] + 0.5
    q1, q0 = y.sum() + 1 - p1, (1 - y).sum() + 1 - p0
    z = np.log(p1 * q0 / (p0 * q1)) / np.sqrt(1 / p1 + 1 / p0 + 1 / q1 + 1 / q0)
    strongest = np.sort(np.abs(z))[::-1][:FEATURES]
    used = some[np.abs(z) >= min(SCREEN, max(WEAK, strongest[-1] if len(strongest) else WEAK))]
    if not len(used):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), bias)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    fs, ss, ds, base = [], [], [], 0
    for a, _, part, off in cuts:
        f, sentence, doc, _ = features(part, off)
        hit = slot[f] >= 0
        fs.append(slot[f[hit]])
        ss.append(sentence[hit] + base)
        ds.append(doc + a)
        base += len(doc)
    feature, sentence, doc = np.concatenate(fs), np.concatenate(ss), np.concatenate(ds)
    order = np.argsort(doc, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    doc, sentence = doc[order], place[sentence]
    by = np.argsort(sentence, kind="stable")
    feature, sentence = feature[by], sentence[by]
    n_docs = len(y)
    first_sentence = np.searchsorted(doc, np.arange(n_docs + 1))
    first_word = np.searchsorted(sentence, np.arange(len(doc) + 1))
    rng = np.random.default_rng(seed)
    theta = np.zeros(len(used))
    bias -= math.log(max(1.0, len(doc) / n_docs))
    m, v, mb, vb, t = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    size = max(32, n_docs // 24)
    weight = np.where(y > 0, min(4.0, (1 - rate) / rate), 1.0)
    for step in range(rounds):
        rate_now = 0.08 * (1 - step / rounds) + 0.004
        perm = np.sort(rng.permutation(n_docs).reshape(-1)[: n_docs // size * size].reshape(-1, size), axis=1)
        for docs in perm:
            s_n = first_sentence[docs + 1] - first_sentence[docs]
            s = np.repeat(first_sentence[docs] - np.concatenate([[0], np.cumsum(s_n)[:-1]]), s_n) + np.arange(s_n.sum())
            w_n = first_word[s + 1] - first_word[s]
            k = np.repeat(first_word[s] - np.concatenate([[0], np.cumsum(w_n)[:-1]]), w_n) + np.arange(w_n.sum())
            f, at = feature[k], np.repeat(np.arange(len(s)), w_n)
            own = np.repeat(np.arange(len(docs)), s_n)
            none, p = noisy_or(np.bincount(at, theta[f], len(s)) + bias, own, len(docs))
            some = np.maximum(-np.expm1(none), 1e-9)
            # d log-likelihood / d sentence log-odds: -p for a clean document, p * (1 - P) / P for a toxic one.
            g = p * np.where(y[docs][own] > 0, (np.exp(none) / some)[own], -1.0) * weight[docs][own] / len(docs)
            grad = np.bincount(f, g[at], len(theta)) - l2 * theta
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            theta += rate_now * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            bias += rate_now * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return Model(used, theta.astype(np.float32), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> DataFrame:
    """At most ``limit`` (text, label) rows: labelled documents outside the held-out fifth, by the smallest hash."""
    known = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(picked, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, max_bytes: int = MAX_TRAINING_BYTES) -> Model:
    """Fits in one task on a bounded sample, ``limit`` rows and ``max_bytes`` of text at most; the driver gets the weights."""
    per_row = max(1, max_bytes // max(1, limit))
    rows = training_rows(docs, labels, limit).where(F.octet_length("text") <= 16 * per_row)
    rows = rows.select("text", "label", F.xxhash64("text").alias("h")).repartition(1).sortWithinPartitions("h", "label").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, size = [], [], 0
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size += len(text.encode())
                if size <= max_bytes:
                    texts.append(text)
                    y.append(label)
        m = fit(texts, y)
        yield pa.RecordBatch.from_arrays([pack([m.used.astype(np.int64)]), pack([m.values]), pa.array([m.bias])], ["used", "weights", "bias"])

    r = rows.mapInArrow(tidy(run), "used binary, weights binary, bias double").first()
    if r is None:  # without rows there may be no task
        return fit([], [])
    return Model(np.frombuffer(r["used"], np.int64), np.frombuffer(r["weights"], np.float32), r["bias"])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_at of every document (``keep`` adds columns of ``docs``).

    The score is the noisy-or of the sentences of the whole text; ``worst_at`` is the first byte of the sentence with
    the largest score. A null text counts as empty and an empty one has one sentence without words. Rows with a null
    or repeated doc_id are scored like any other. Labels for a doc_id that come twice count as toxic if one does.
    Labels with null are ignored; with no usable label, or labels of one kind, all scores are equal. The source, the
    language, the id and the label never enter a score.
    """
    tune(spark)
    model = spark.sparkContext.broadcast(train(docs, labels))  # weights of 2**BITS features at most, at any size of the input
    base = docs.select(F.col("doc_id"), *keep, F.coalesce("text", F.lit("")).alias("text__"))
    names = base.columns[:-1]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, off = text_buffer(batch.column(len(names)))
        for a, b in slices(off, 1_000_000):
            s, at = model.value.score(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(s), pa.array(at.astype(np.int64))], [*names, "score", "worst_at"])

    schema = T.StructType([*base.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("worst_at", T.LongType())])
    out = arrow_map(base, run, schema)
    out = out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", *keep, "held_out", "score", "predicted", "worst_at")
