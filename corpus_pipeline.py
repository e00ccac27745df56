"""Documents to packed training sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of documents, whatever else these are called: rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm import decontaminate, lines, neardup, packing, toxicity
from riverbed.llm.catalog import table, tokenizer
from riverbed.llm.common import Scratch, tune

#: SQL can't express the trained, the randomised and the packing stages.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct("*").alias("row__"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; reads the table ``labels``. Without usable labels every document stays."""
    scored = toxicity.score(spark, _with_row(docs), table(spark, sf_dir, "labels"), keep=("row__",))
    return scored.where("predicted = 0").select("row__.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of a source go; a document keeps its row, and its text if nothing goes.

    ``docs`` needs the columns source and n_chars, which is counted anew where lines went; a null source is a source."""
    out = lines.dedup(spark, docs, F.col("source"), lines.text_lines(F.col("text")))
    text = F.when(F.size("kept") == F.size("lines"), F.col("page.text")).otherwise(F.array_join("kept", "\n"))
    n = F.when(F.size("kept") == F.size("lines"), F.col("page.n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    new = {"text": text, "n_chars": n}
    return out.select(*[new.get(c, F.col("page")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 80 % or more connect, the one with the smallest doc_id stays; texts without words all stay."""
    return neardup.keep_first(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go (see ``decontaminate.clean``); reads the table ``benchmark``."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens; a null text is the end id alone."""
    return packing.packed(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; the last one's rows."""
    tune(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
