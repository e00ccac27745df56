"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each window of ``window`` words keeps the smallest hash of its k-grams. Two texts that share a window keep the same
hash for it, so joining the kept hashes finds every shared window; the hit is then extended to whole windows and
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune
from .native import ascii_lower, let, word_list

#: Words of a k-gram; a window of 13 words has 13 - GRAM + 1 = 8 of them.
GRAM = 6
#: Fingerprints of the benchmark that are broadcast at most, and bytes of the items' words beside them; more are joined by a
#: shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _gram_hashes(h: Column, k: int, least: int) -> Column:
    """Hash of the k words from each position, out of word hashes and by doubling; none if there are under ``least`` words.

    Word hashes are random bits, so shifting by place and exclusive or will do; hits are compared word by word anyway.
    """

    def join(x: Column, y: Column, step: int) -> Column:
        return F.zip_with(x, F.slice(y, F.lit(1 + step), F.greatest(F.size(y), F.lit(1))), lambda a, b: a.bitwiseXOR(F.shiftleft(b, step)))

    def grow(x: Column, n: int, done: Column | None, have: int) -> Column:
        """``x`` has the hashes of n words, ``done`` those of the ``have`` words before; the bits of k say which to join."""
        if k & n:
            done, have = (x if done is None else join(done, x, have)), have + n
        if have == k:
            return done
        keep = done if done is not None else F.lit(None)
        return let(F.struct(join(x, x, n).alias("x"), keep.alias("d")), lambda s: grow(s["x"], 2 * n, None if done is None else s["d"], have))

    none = F.array().cast("array<bigint>")
    hashed = let(h, lambda x: F.slice(grow(x, 1, None, 0), F.lit(1), F.greatest(F.size(x) - (k - 1), F.lit(0))))
    return F.when(F.size(h) >= max(k, least), hashed).otherwise(none)


def _winnow(h: Column, width: int) -> Column:
    """The distinct minima of every ``width`` neighbours (a power of two), by doubling; cut windows at the end do no harm."""
    step = 1
    while step < width:
        h = let(h, lambda x, s=step: F.zip_with(x, F.slice(x, F.lit(1 + s), F.greatest(F.size(x), F.lit(1))), lambda a, b: F.least(a, b)))
        step *= 2
    return F.array_distinct(h)


def _bench(benchmark: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(fp, item, q, words, len): a fingerprint, where it stands in the item, and the item's words; len: of its windows."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.transform(word_list(F.col(text_col)), ascii_lower).alias("iw"))
    items = items.where(F.size("iw") > 0)
    items = items.withColumn("wh", _word_hashes(F.col("iw")))
    long_ = items.where(F.size("iw") >= window).withColumn("ih", _gram_hashes(F.col("wh"), gram, window))
    long_ = long_.withColumn("fp", F.explode(_winnow(F.col("ih"), window - gram + 1)))
    long_ = long_.withColumn("q", F.explode(F.filter(F.sequence(F.lit(0), F.size("iw") - gram), lambda p: F.get(F.col("ih"), p) == F.col("fp"))))
    short = items.where(F.size("iw") < window)
    by_length = F.coalesce(*[F.when(F.size("iw") == n, F.get(_gram_hashes(F.col("wh"), n, n), F.lit(0))) for n in range(1, window)])
    short = short.withColumn("fp", by_length).withColumn("q", F.lit(0))
    return long_.select("fp", "item", "q", "iw", F.lit(window).alias("len")).unionByName(short.select("fp", "item", "q", "iw", F.size("iw").alias("len"))).distinct()


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted strings) and spans (array of start, len).

    A benchmark item of ``window`` words or more has all its runs of that many words as windows, a shorter one is a
    window as a whole, one without words has none. A document word inside any occurrence of a window is hit. Null texts
    have no words. Items without an id take no part; items that are repeated count once by id. Documents with a null or
    repeated id are rows of their own. An empty benchmark hits nothing.

    ``window - gram + 1`` must be a power of two.
    """
    width = window - gram + 1
    if width & (width - 1):
        raise ValueError("window - gram + 1 must be a power of two")
    scratch = Scratch(spark, "decontaminate")
    bench = scratch.save(_bench(benchmark, item_col, item_text, window, gram))
    lengths = sorted(r[0] for r in bench.where(F.col("len") < window).select("len").distinct().collect())  # under `window` values
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_prints, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("iw", "")) + 24 * F.size("iw") + 64), F.lit(0))).first()
    few = n_prints <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    if not few:
        base = scratch.save(base)
    base = base.select("rid", "id", word_list(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w")).withColumn("wh", _word_hashes(F.col("w"))).withColumn("h", _gram_hashes(F.col("wh"), gram, window))
    prints = _winnow(F.col("h"), width)
    if lengths:
        prints = F.concat(prints, *[F.array_distinct(_gram_hashes(F.col("wh"), n, n)) for n in lengths])
    # A null print keeps one row of every document.
    prints = F.concat(prints, F.array(F.lit(None).cast("bigint")))
    if few:
        # Exploding a plain column stays within generated code, so a text isn't copied for each of its prints.
        rows = base.withColumn("prints", prints).withColumn("fp", F.explode_outer("prints")).drop("prints").join(F.broadcast(bench), "fp", "left").where(F.col("item").isNotNull() | F.col("fp").isNull())
    else:
        found = base.select("rid", prints.alias("prints")).select("rid", F.explode_outer("prints").alias("fp")).join(bench, "fp")
        rows = base.join(found, "rid", "left")
    p = F.filter(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0))), lambda i: F.get(F.col("h"), i) == F.col("fp"))
    first = F.greatest(F.col("q") - (width - 1), F.lit(0))
    last = F.least(F.col("q"), F.size("iw") - window)
    text = lambda w, at, n: ascii_lower(F.array_join(F.slice(w, at + 1, n), " "))
    fits = lambda start, n: (start >= 0) & (start + n <= F.col("n_words"))
    long_ = F.flatten(F.transform(p, lambda i: F.transform(F.filter(F.sequence(first, last), lambda s: fits(i - F.col("q") + s, window) & (text(F.col("w"), F.greatest(i - F.col("q") + s, F.lit(0)), window) == text(F.col("iw"), s, window))), lambda s: F.struct((i - F.col("q") + s).alias("start"), F.lit(window).alias("len")))))
    whole = F.array_join("iw", " ")
    short = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col("n_words") - F.col("len"), F.lit(0))), lambda i: text(F.col("w"), i, F.col("len")) == whole), lambda i: F.struct(i.alias("start"), F.col("len").alias("len")))
    none = F.array().cast("array<struct<start:int,len:int>>")
    rows = rows.select("rid", "id", "n_words", "item", F.when(F.col("item").isNull(), none).when(F.col("len") < window, short).otherwise(long_).alias("at"))
    per = rows.groupBy("rid").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
        F.array_sort(F.collect_set(F.when(F.size("at") > 0, F.col("item")))).alias("items"),
    )
    # Sorted spans join into runs: (end so far, words so far).
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    joined = F.aggregate("at", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")))
    return per.select("id", F.col("n_words").cast("long").alias("n_words"), joined["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("at").alias("spans"))


def contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark passage.

    One whole window of ``window`` words is enough to drop a document, however long it is. A shorter item is a window by
    itself and may be a common phrase, so such hits drop a document only if they make up a twentieth of its words. Null
    and empty texts stay, as does everything if the benchmark is empty; repeated rows and ids are judged each for itself.
    """
    tune(spark)
    scratch = Scratch(spark, "clean")
    base = scratch.save(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))
    found = hits(spark, base.select("rid", F.col("row")[text_col].alias("text")), benchmark, "rid", "text", item_col, item_text, window, gram)
    whole = F.exists("spans", lambda s: s["len"] >= window)
    bad = scratch.save(found.where(whole | contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("rid")))
    # Eight bytes a row, so a broadcast of them has a proven size.
    few = bad.count() <= BROADCAST_ROWS
    return base.join(F.broadcast(bad) if few else bad, "rid", "left_anti").select("row.*")
