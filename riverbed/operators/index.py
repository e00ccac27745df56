"""Ordered-map and interval-map operations as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Name = str


def ascending(df: DataFrame, key: Name) -> DataFrame:
    return df.orderBy(F.col(key).asc())


def descending(df: DataFrame, key: Name) -> DataFrame:
    return df.orderBy(F.col(key).desc())


def at_most(df: DataFrame, key: Name, bound: object) -> DataFrame:
    """Keys up to the bound, the largest first; the filter reaches the scan."""
    return df.where(F.col(key) <= F.lit(bound)).orderBy(F.col(key).desc())


def at_least(df: DataFrame, key: Name, bound: object) -> DataFrame:
    """Keys from the bound on, the smallest first."""
    return df.where(F.col(key) >= F.lit(bound)).orderBy(F.col(key).asc())


def first(df: DataFrame, key: Name) -> DataFrame:
    """The row of the smallest key: a top-1, so nothing is sorted as a whole."""
    return df.orderBy(F.col(key).asc()).limit(1)


def keys(df: DataFrame, key: Name) -> DataFrame:
    return df.select(key)


def entries(df: DataFrame, *columns: Name) -> DataFrame:
    """Every entry once, in no order: a plain scan of the columns."""
    return df.select(*columns)


def get(df: DataFrame, key: Name, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def put(df: DataFrame, rows: DataFrame, key: Name) -> DataFrame:
    """The map with ``rows`` put in, replacing rows of equal keys."""
    return remove(df, rows, key).unionByName(rows)


def remove(df: DataFrame, rows: DataFrame, key: Name) -> DataFrame:
    return df.join(rows.select(key).distinct(), key, "left_anti")


def add(held: DataFrame, ids: DataFrame) -> DataFrame:
    """A set of ids with more put in; what is there already stays once."""
    return held.unionByName(ids).distinct()


def discard(held: DataFrame, ids: DataFrame) -> DataFrame:
    """A set of ids with some taken out, whether they are there or not."""
    return held.join(ids.distinct(), held.columns, "left_anti")


def contains(asked: DataFrame, held: DataFrame, key: Name, name: Name) -> DataFrame:
    """``asked`` with a boolean that says whether each key is in the set."""
    return asked.join(held.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def delivery_order(events: DataFrame, batch: Name, *within: Name) -> DataFrame:
    """``events`` with ``offset``, their place in their own request; a sink sorts by both. Requests are of bounded size."""
    return events.withColumn("offset", F.row_number().over(Window.partitionBy(batch).orderBy(*within)) - 1)


def keys_starting_with(df: DataFrame, key: Name, prefix: str) -> DataFrame:
    """Keys that begin with the prefix; pushed to the scan."""
    return df.where(F.startswith(F.col(key), F.lit(prefix)))


def prefixes_of(df: DataFrame, text: Name, prefixes: DataFrame, prefix: Name, lengths: list[int] | None = None) -> DataFrame:
    """Join of each text with the stored prefixes that it begins with.

    An equi-join on (length, head) for each length that occurs among the prefixes; the lengths are few, and are read
    from the prefixes unless given.
    """
    if lengths is None:
        lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]
    heads = [F.when(F.length(text) >= n, F.left(F.col(text), F.lit(n))) for n in sorted(x for x in lengths if x is not None)]
    if not heads:
        return df.join(prefixes, F.lit(False))
    probes = df.withColumn("head__", F.explode(F.array_compact(F.array(*heads))))
    return probes.join(prefixes, F.col("head__") == F.col(prefix)).drop("head__")


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def ordered(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Reversed bounds are swapped; a range without either bound has none."""
    whole = lo.isNotNull() & hi.isNotNull()
    return F.when(whole, F.least(lo, hi)), F.when(whole, F.greatest(lo, hi))


def stab(points: DataFrame, x: Name, ranges: DataFrame, lo: Name, hi: Name, width: float | None = None) -> DataFrame:
    """Join of points with the closed ranges that hold them; reversed ranges are swapped.

    With ``width`` ranges are dealt over bins of that width and the join is an equi-join on bins; without it Spark
    compares directly, which suits a small set of ranges. Ranges with null bounds hold nothing.
    """
    a, b = ordered(F.col(lo), F.col(hi))
    if width is None:
        return points.join(ranges, F.col(x).between(a, b))
    r = ranges.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("bin__", F.explode(_bins(a, b, width)))
    p = points.withColumn("bin__", F.floor(F.col(x) / width).cast("long"))
    return p.join(r, "bin__").where(F.col(x).between(a, b)).drop("bin__")


def overlap(left: DataFrame, l_lo: Name, l_hi: Name, right: DataFrame, r_lo: Name, r_hi: Name, width: float | None = None) -> DataFrame:
    """Join of closed ranges that share a point; with ``width`` by bins, each pair told in the first bin they share."""
    a, b = ordered(F.col(l_lo), F.col(l_hi))
    c, d = ordered(F.col(r_lo), F.col(r_hi))
    if width is None:
        return left.join(right, (a <= d) & (c <= b))
    x = left.withColumn("bin__", F.explode(_bins(a, b, width)))
    y = right.withColumn("bin__", F.explode(_bins(c, d, width)))
    first_shared = F.floor(F.greatest(a, c) / width).cast("long")
    return x.join(y, "bin__").where((a <= d) & (c <= b) & (F.col("bin__") == first_shared)).drop("bin__")


def exact_range(left: DataFrame, l_lo: Name, l_hi: Name, right: DataFrame, r_lo: Name, r_hi: Name) -> DataFrame:
    """Join of ranges with the same bounds, reversed or not."""
    a, b = ordered(F.col(l_lo), F.col(l_hi))
    c, d = ordered(F.col(r_lo), F.col(r_hi))
    return left.join(right, (a == c) & (b == d))


def in_order(ranges: DataFrame, lo: Name, hi: Name) -> DataFrame:
    return ranges.orderBy(lo, hi)


def extremes(ranges: DataFrame, lo: Name, hi: Name) -> DataFrame:
    """The smallest and the largest range, by lower and then upper bound."""
    r = F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    return ranges.agg(F.min(r).alias("first"), F.max(r).alias("last"))


def cardinality(registry: DataFrame, weight: Column | None = None) -> DataFrame:
    """How much is stored: the sum of weights, a row counting 1 by default."""
    return registry.agg(F.coalesce(F.sum(weight if weight is not None else F.lit(1)), F.lit(0)).alias("size"))
