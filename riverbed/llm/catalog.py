"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, decontaminate, lines, lm, neardup, packing, substring, suffix, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The file of a public tokenizer; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.packed(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and unigram scores of every document."""
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of every document, at 85 %."""
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), num=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 400 that start elsewhere too."""
    return suffix.dedup(spark, table(spark, sf_dir, "documents"), digest=True)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document's ids, read back from the coded files."""
    return codec.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = decontaminate.hits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that its host has on too many pages."""
    out = lines.dedup(spark, table(spark, sf_dir, "pages"), lines.url_host(F.col("url")), lines.html_lines(F.col("html")))
    n, k = F.size("lines").cast("long"), F.size("kept").cast("long")
    return out.select(F.col("page.page_id").alias("page_id"), "host", n.alias("n_lines"), (n - k).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    e = table(spark, sf_dir, "embeddings")
    return topk.search(spark, e, e.where(F.col("vec_id") % 50 == 0))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that start earlier too."""
    return substring.dedup(spark, table(spark, sf_dir, "documents"), digest=True)


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_packing, op2_lm_score, op3_near_duplicates, op4_suffix_dedup, op5_token_ids, op6_decontaminate, op7_toxicity, op8_line_dedup, op9_topk, op10_substring_dedup)}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {_WORDS} w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, ln WHERE len(w) >= n)),
h AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT j) n_hit FROM (SELECT rid, unnest(range(i, i + n)) j FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN it USING (rid)
"""

OP8 = r"""
WITH p AS (SELECT row_number() OVER () rid, page_id,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
    '<(script|style)[^>]*>[^<]*(<[^/][^<]*|</[^s][^<]*)*</(script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
    lambda x: trim(x)), lambda x: x <> '') ls FROM pages),
t AS (SELECT host, count(*) total FROM p GROUP BY host),
c AS (SELECT host, l, count(*) n FROM (SELECT rid, host, unnest(list_distinct(ls)) l FROM p) GROUP BY ALL),
bad AS (SELECT host, l FROM c JOIN t USING (host) WHERE n >= 5 AND n > 0.1 * total),
x AS (SELECT rid, host, unnest(ls) l, unnest(range(len(ls))) i FROM p),
k AS (SELECT rid, string_agg(l, chr(10) ORDER BY i) txt, count(*) kept FROM x ANTI JOIN bad USING (host, l) GROUP BY rid)
SELECT page_id, host, CAST(len(ls) AS BIGINT) n_lines, len(ls) - coalesce(kept, 0) n_dropped, coalesce(txt, '') AS text
FROM p LEFT JOIN k USING (rid)
"""

OP9 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id vec_id,
  CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM s) WHERE r <= 5
"""

ORACLES: dict[str, str] = {"op6_decontaminate": OP6, "op8_line_dedup": OP8, "op9_topk": OP9}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
