"""Plumbing shared by the operators: scratch tables, row keys and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The setting for rows of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows in one Arrow batch: texts are long, so a batch of these stays at a few MB.
BATCH_ROWS = 512


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".java")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def tune(spark: SparkSession) -> None:
    """Ships the package; small Arrow batches, because one row can be a very long text; shuffle files go once a job is done,
    as nothing but written tables is read again. Results don't depend on these settings, which stay as they bound memory
    and disk of what is evaluated later."""
    ship(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set(BATCH, str(BATCH_ROWS))


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for as long as the block runs; what is lazy must be written within it."""
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in plain local mode, where all is one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Scratch:
    """Written tables that cut lineage, so a lost executor costs a re-read and not a re-run.

    Tables live in the shared folder until :meth:`drop` or the end of the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, *dfs: DataFrame, collect: bool = True) -> None:
        """Deletes tables that nothing will read again; ``collect`` lets Spark delete the shuffle files of finished jobs too."""
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                remove(self.spark, path)
                self._keep = [x for x in self._keep if x is not df]
        if collect:
            self.collect()

    def only(self, df: DataFrame) -> DataFrame:
        """A saved table, all others of this scratch deleted: nothing reads them once it is written."""
        for other in list(getattr(self, "_keep", [])):
            if other is not df:
                self.drop(other, collect=False)
        self.collect()
        return df

    def collect(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()

    def _end(self) -> None:
        try:
            remove(self.spark, self.base)
        except Exception:  # the session is over, and with it the means to delete
            pass


def with_row_key(scratch: Scratch, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written copy (``rid`` unique long, ``id``, ``text`` with null as empty).

    ``rid`` is stable because it is stored: repeated or null ids stay apart.
    """
    kept = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scratch.save(kept.select(F.monotonically_increasing_id().alias("rid"), "id", "text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts back to back, and n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) > 1 else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def give_back() -> None:
    """Returns memory that this process has freed: Spark keeps its Python workers, and the next task may run in another one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over the batches of a partition, memory returned in the end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches; ``f`` makes any number of batches out of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return df.mapInArrow(tidy(run), schema)


def pack(arrays: list[np.ndarray]) -> pa.Array:
    """Each array as one binary value."""
    return pa.array([x.tobytes() for x in arrays], type=pa.binary())


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values out of one flat array and item offsets, without a copy for each value."""
    flat = np.ascontiguousarray(data)
    o = (np.asarray(offsets, dtype=np.int64) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer(o), pa.py_buffer(flat)])


def sha256(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], type=pa.string())
