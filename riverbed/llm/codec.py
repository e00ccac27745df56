"""A context-mixing range coder for token ids, and the binary files written with it.

Blocks of ids are coded independently: orders 0 to 2 predict each id, their mixed chances drive a range coder that writes
all there is of it, and every block starts anew and has a checksum (see ``TokenCoder.java``). A record holds the blocks of whole documents; a file is a
Parquet table of records in ascending order of the documents' ids, with each document's place.

The coder is sequential by nature, and NumPy needs over a microsecond for a token. So it is a Java class of two functions
on binary columns, which Spark's own run-time compiler translates; executors get it as a jar.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units
from .common import Scratch, binary, slices, text_buffer, tidy, tune

#: Tokens in a record, about; a record has whole documents.
RECORD = 1_000_000
_CLASS = "riverbed.llm.TokenCoder"
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession) -> object:
    """The class loader of the compiled coder, once for each application; executors get its classes as a jar."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, "TokenCoder.java").decode())
        classes = compiler.getBytecodes()
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="coder-")), "coder.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name in classes:
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(classes[name]))
        sc._jsc.addJar(f"file://{path}")
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId]


def _function(spark: SparkSession, kind: str, column: Column) -> Column:
    name = f"riverbed_token_ids_{kind.lower()}"
    kind_class = _loader(spark).loadClass(f"{_CLASS}${kind}")
    spark._jsparkSession.udf().register(name, kind_class.newInstance(), spark._jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"'))
    return F.call_function(name, column)


def encode(spark: SparkSession, ids: Column) -> Column:
    """Records of binary ids (little-endian unsigned 32-bit, under 2**24)."""
    return _function(spark, "Encode", ids)


def decode(spark: SparkSession, record: Column) -> Column:
    """The binary ids of records; a damaged one is an error that names the block."""
    return _function(spark, "Decode", record)


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, drops_space: bool = False, end: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes records in ascending id order as a table of (part, before, docs, record): documents' ids and places, and their
    tokens, each document with ``end`` after it. Null ids come first; equal ids in any order. ``before`` counts the part's
    tokens in earlier records. A null text is empty."""
    tune(spark)
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = base.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        before = 0

        def flush() -> pa.RecordBatch:
            part, doc_ids, sizes, ids = (list(x) for x in zip(*held, strict=True))
            size = np.concatenate(sizes)
            rows = pa.StructArray.from_arrays([pa.concat_arrays(doc_ids), pa.array(np.cumsum(size) - size), pa.array(size)], ["id", "at", "n"])
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int32()), pa.array([before]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), binary(flat, [0, len(flat)])], ["part", "before", "docs", "flat"])

        tokens = 0
        for b in batches:
            if not b.num_rows:
                continue
            raw, off = text_buffer(b.column(1))
            for lo, hi, ids, o in units.encoded(raw, off, tokenizer, drops_space, end, slices(off, 1_500_000)):
                held.append((b.column(2)[0].as_py(), b.column(0).slice(lo, hi - lo), np.diff(o), ids))
                tokens += len(ids)
                if tokens >= RECORD:
                    yield flush()
                    before, tokens, held = before + tokens, 0, []
        if held:
            yield flush()

    rows = ordered.mapInArrow(tidy(run), "part int, before long, docs array<struct<id:long,at:long,n:long>>, flat binary")
    rows.select("part", "before", "docs", encode(spark, F.col("flat")).alias("record")).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``tokens``, binary, unsigned 32-bit) from the records under ``path``."""
    table = spark.read.schema("part int, before long, docs array<struct<id:long,at:long,n:long>>, record binary").parquet(path)
    # A row for each part of the writer, so this is as small as its number of partitions, and can be broadcast.
    size = F.element_at("docs", -1)
    parts = table.select("part", (F.col("before") + size["at"] + size["n"]).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    flat = table.select("part", "before", "docs", decode(spark, F.col("record")).alias("flat"))
    rows = flat.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("before")).alias("first"), "flat", F.explode_outer("docs").alias("d"))
    ids = F.substring(F.col("flat"), (4 * F.col("d.at") + 1).cast("int"), (4 * F.col("d.n")).cast("int"))
    return rows.select(F.col("d.id").alias("doc_id"), (F.col("first") + F.col("d.at")).alias("start"), F.col("d.n").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"), *[ids.alias("tokens")] * keep_ids)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes to a scratch folder and reads back."""
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.base}/records"
    write(spark, docs, path, tokenizer, **options)
    return read(spark, path)
