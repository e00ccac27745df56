"""Idempotent publishing: the first event of a (channel, source, id) counts."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["channel", "source", "id"]
TTL = "180 seconds"
#: Keys that are remembered at most, and parts that they are dealt over.
CAPACITY, PARTS = 1 << 20, 64
#: Bytes of rows that a worker sorts at once and that a block of sorted rows has, rows of a block, and files that are merged at once.
RUN_BYTES, BLOCK_BYTES, BLOCK_ROWS, MERGED = 32 << 20, 1 << 20, 8192, 32


def first_events(df: DataFrame, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first row of each key of a table, by ``order``: ingest_ts and offset unless told, as far as there are such columns.

    No time counts as the earliest; rows that tie in all of them are the same event, and one of them stays.
    """
    key = key or KEY
    order = [c for c in ("ingest_ts", "offset") if c in df.columns] if order is None else order
    if not order:
        return df.dropDuplicates(key)
    # A minimum is taken before the shuffle too, so a key that is repeated often is no hot one.
    first = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("first__"))
    return first.select("first__.*")


def first_events_within(df: DataFrame, ttl_seconds: float = 180, key: list[str] | None = None, ts: str = "ingest_ts") -> DataFrame:
    """A table's events without those that repeat a key within ``ttl_seconds`` of the key's last accepted event.

    A repeated event doesn't extend the lifetime. Only events that follow another one of their key within the lifetime are
    in question; a longer pause begins a run of its own, whose first event is accepted. So the fold over times in order is
    one over the runs of a key and not over all of its times. Ties in time are repeats; of them one stays.
    """
    key = key or KEY
    seconds = F.col(ts).cast("timestamp").cast("double")
    times = df.select(*key, seconds.alias("t__")).distinct()
    in_time = Window.partitionBy(*key).orderBy("t__")
    starts = F.coalesce(F.col("t__") - F.lag("t__").over(in_time) >= ttl_seconds, F.lit(True))
    runs = times.withColumn("starts__", starts.cast("int")).withColumn("run__", F.sum("starts__").over(in_time))
    lists = runs.groupBy(*key, "run__").agg(F.array_sort(F.collect_list("t__")).alias("t__"))
    # The state is the last accepted time and all of them, so a step looks at no more than its end.
    zero = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("all"))
    step = lambda a, t: F.when(t - a["last"] >= ttl_seconds, F.struct(t.alias("last"), F.array_append(a["all"], t).alias("all"))).otherwise(a)
    accepted = lists.select(*key, F.explode(F.aggregate("t__", zero, step)["all"]).alias("at__"))
    both = df.withColumn("at__", seconds).join(accepted, [*key, "at__"])
    return first_events(both, [*key, "at__"], [c for c in ("offset",) if c in df.columns]).select(*df.columns)


def first_events_streaming(df: DataFrame, ttl: str = TTL, key: list[str] | None = None, ts: str = "ingest_ts") -> DataFrame:
    """The same for a stream; state is dropped once the watermark has passed the lifetime."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key or KEY)


class Remembered:
    """Keys of one part with the time at which each is forgotten, as two arrays; the oldest goes when there is no room."""

    def __init__(self, keys: bytes, until: bytes, capacity: int):
        names = np.frombuffer(keys, "S16")
        self.until = dict(zip(names.tolist(), np.frombuffer(until, np.int64).tolist(), strict=True))
        self.capacity = capacity

    def accepts(self, key: bytes, at: int, ttl: int) -> bool:
        """Whether an event of this key at this time is new; it is remembered then. Times don't fall."""
        if self.until.get(key, at) > at:
            return False
        # Accepted keys are put at the end and lifetimes are equal, so the first to be forgotten stand in front.
        self.until.pop(key, None)
        while self.until and (len(self.until) >= self.capacity or next(iter(self.until.values())) <= at):
            del self.until[next(iter(self.until))]
        self.until[key] = at + ttl
        return True

    def state(self) -> tuple[bytes, bytes]:
        return np.array(list(self.until), "S16").tobytes(), np.array(list(self.until.values()), np.int64).tobytes()


def merged(runs: list[Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """Rows of several sorted runs in the order of ``at__``, rows that tie in the order of the runs; one block of each is held."""
    heads = {i: b for i, r in enumerate(runs) if (b := next(r, None)) is not None}
    while heads:
        times = {i: b["at__"].to_numpy() for i, b in heads.items()}
        # No run has anything ahead of the first end of a block but what is held.
        end, first = min((t[-1], i) for i, t in times.items())
        out = []
        for i in sorted(heads):
            n = np.searchsorted(times[i], end, "right" if i <= first else "left")
            if n:
                out.append(heads[i].iloc[:n])
            heads[i] = heads[i].iloc[n:]
            if n == len(times[i]):
                if (b := next(runs[i], None)) is None:
                    del heads[i]
                else:
                    heads[i] = b
        yield pd.concat(out).sort_values("at__", kind="stable") if len(out) > 1 else out[0]


def in_time(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of ``at__``, rows that tie as they came. Beyond RUN_BYTES they are sorted through files of this machine."""

    def ordered(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).sort_values("at__", kind="stable")

    def written(frames: Iterable[pd.DataFrame]):
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for f in frames:
            n = max(1, min(BLOCK_ROWS, len(f) * BLOCK_BYTES // max(1, size_of(f))))
            for a in range(0, len(f), n):
                pickle.dump(f.iloc[a : a + n].copy(), file, protocol=5)
        return file

    def read(file) -> Iterator[pd.DataFrame]:
        with file:
            file.seek(0)
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def put(frames: Iterable[pd.DataFrame], level: int) -> None:
        """Files of a level follow each other; a full level becomes one file of the next."""
        if level == len(files):
            files.append([])
        files[level].append(written(frames))
        if len(files[level]) == MERGED:
            full, files[level] = files[level], []
            put(merged([read(f) for f in full]), level + 1)

    size_of = lambda f: int(f.memory_usage(index=False, deep=True).sum())
    files, held, size = [], [], 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += size_of(b)
        if size > RUN_BYTES:
            put([ordered(held)], 0)
            held, size = [], 0
    last = [ordered(held)] if held else []
    while len(files) > 1:  # the first rows are in the files of the highest level
        low = files.pop(0)
        if len(low) + len(files[0]) > MERGED:
            low = [written(merged([read(f) for f in low]))]
        files[0] += low
    yield from merged([read(f) for level in files for f in level] + [iter(last)])


@lru_cache(1 << 16)
def key_name(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=15).digest() + b"k"


def first_events_bounded(df: DataFrame, ttl_seconds: float = 180, capacity: int = CAPACITY, parts: int = PARTS, key: list[str] | None = None, ts: str = "ingest_ts") -> DataFrame:
    """A stream's first events, with a lifetime that is exact to the event and a bound on the keys that are remembered.

    Keys are dealt by hash over ``parts``, each of which remembers ``capacity / parts`` of them; a part without room forgets
    the key that would be forgotten first. Within a batch, a part's events are taken in the order of their times, NULL first;
    an event that comes late is judged as if it came at the time of the latest before it. No column may be a VARIANT.
    A worker holds its part's keys and RUN_BYTES of rows, however many a batch has.
    """
    key = key or KEY
    size, ttl, columns = max(1, capacity // parts), int(ttl_seconds * 1_000_000), df.columns
    parted = df.withColumn("part__", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).withColumn("at__", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62))))
    # pandas has whole numbers among NULLs as floats, so they come without NULLs and are told to be none beside.
    whole = [c for c in key if isinstance(df.schema[c].dataType, T.IntegralType)]
    for c in whole:
        parted = parted.withColumns({f"{c}__whole": F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)), f"{c}__none": F.col(c).isNull()})

    def values(rows: pd.DataFrame, c: str) -> list:
        if c not in whole:
            return list(rows[c])
        return [None if none else x for x, none in zip(rows[f"{c}__whole"].tolist(), rows[f"{c}__none"].tolist(), strict=True)]

    def judge(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Remembered(*((bytes(x) for x in state.get[:2]) if state.exists else (b"", b"")), size)
        now = state.get[2] if state.exists else -(2**62)
        for rows in in_time(batches):
            new = []
            for k, at in zip(zip(*(values(rows, c) for c in key), strict=True), rows["at__"].tolist(), strict=True):
                now = max(now, at)
                new.append(held.accepts(key_name(repr(k)), now, ttl))
            yield rows.loc[np.array(new, bool), columns]
        state.update((*held.state(), now))

    return parted.groupBy("part__").applyInPandasWithState(judge, df.schema, "keys binary, until binary, now long", "append", GroupStateTimeout.NoTimeout)
