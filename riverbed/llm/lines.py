"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

#: A line goes if it stands on a larger share of its host's pages than this ...
MAX_SHARE = 0.1
#: ... and on so many of them at least.
MIN_PAGES = 5
#: Lines to drop, over all hosts, that are broadcast at most; more meet their pages by a shuffle.
BROADCAST_LINES = 200_000
_SCRIPTS, _TAGS = r"<(script|style)[^>]*>[^<]*(<[^/][^<]*|</[^s][^<]*)*</(script|style)>", r"<[^>]*>"


def url_host(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """The pieces of text between tags, without scripts and styles, trimmed, none empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _SCRIPTS, "\n"), _TAGS, "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup(spark: SparkSession, pages: DataFrame, host: Column, lines: Column, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` in ``page`` (a struct), with host, ``lines`` and ``kept`` (arrays), in line order.

    A line is dropped from every page of a host if the pages of that host which contain it are ``min_pages`` or more
    and more than ``max_share`` of the host's pages. Lines that are blank after trimming count for nothing and stay. A
    null host is a host of its own, as is the empty one; a null page has no lines. A line that is repeated on a page
    counts once for that page. Repeated rows are pages of their own, whatever their id. No row is dropped: a page of
    nothing but boilerplate keeps an empty array.

    Lines are counted by (host, 128-bit hash), pre-aggregated before the shuffle, so a host with most of the pages or a
    line on all of them is no hot key. A host has at most 1 / max_share times the lines of its mean page to drop, so they
    go to the pages as one array for each host while all of them are few, and pages aren't shuffled; otherwise pages meet
    their dropped lines by row key.
    """
    tune(spark)
    scratch = Scratch(spark, "lines")
    first, second = (lambda x: F.xxhash64(x)), (lambda x: F.xxhash64(F.lit(17), x))
    base = pages.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("page"), F.coalesce(F.concat(F.lit("h"), host), F.lit("")).alias("host"), lines.alias("lines"))
    key = lambda x: F.struct(first(x).alias("a"), second(x).alias("b"))
    full = F.filter("lines", lambda x: F.trim(x) != "")

    def counted(base: DataFrame) -> DataFrame:
        return base.select("rid", "host", F.explode(F.array_distinct(F.transform(full, key))).alias("k")).select("rid", "host", "k.a", "k.b")

    total = base.groupBy("host").agg(F.count("*").alias("total"))
    often = counted(base).groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bad = scratch.save(often.join(total, "host").where(F.col("n") > max_share * F.col("total")).select("host", "a", "b"))
    if bad.count() <= BROADCAST_LINES:
        gone = bad.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad"))
        out = base.join(F.broadcast(gone), "host", "left").withColumn("gone", F.array_intersect(F.transform(full, key), "bad"))
    else:
        base = scratch.save(base)
        gone = counted(base).join(bad, ["host", "a", "b"]).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
        out = base.join(gone, "rid", "left")
    kept = F.when(F.coalesce(F.size("gone"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("gone", key(x))))
    return out.select("page", F.when(F.col("host") != "", F.substring("host", 2, 1 << 30)).alias("host"), "lines", kept.alias("kept"))
