"""Whole events to (path, scalar) rows, and helpers on text and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.paths import Path, path_text
from ..streaming import folders
from .resolve import VariantEvent, variant_tag

#: Levels that one plan descends; deeper events are written in between.
LEVELS = 24


def _segment(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def depth(event: Column) -> Column:
    """How deep the containers of an event are nested; 0 for a scalar."""
    plain = F.regexp_replace(F.to_json(event), r"\\.", "")  # no escapes, so a string ends at the next quote
    steps = F.split(F.regexp_replace(plain, r'"[^"]*+"|[^\[\]{}"]++', ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(steps, zero, step)["most"]


def _descend(level: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (path, v, done) with containers that aren't done replaced by their children; arrays stay as well, done."""
    path, v, done = (F.col(f"node__.{c}") for c in ("path", "v", "done"))
    below = lambda name: F.when(path.isNull(), name).otherwise(F.concat(path, F.lit("/"), name))
    node = lambda p, x, d: F.struct(p.alias("path"), x.alias("v"), F.lit(d).alias("done"))
    kind = F.when(~done, F.schema_of_variant(v))
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: node(below(_segment(e["key"])), e["value"], False))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: node(below(i.cast("string")), x, False))
    own = F.array(node(path, v, True))
    array = F.when(path.isNull(), items).otherwise(F.concat(own, items))
    children = F.when(F.col("kind__").startswith("OBJECT"), fields).when(F.col("kind__").startswith("ARRAY"), array).otherwise(own)
    return level.withColumn("kind__", kind).select(*key, F.explode(children).alias("node__"))


def flatten(df: DataFrame, key: list[str], event: str = "event") -> DataFrame:
    """(key.., path, tag, num, str, bool, elements): every scalar and array below an event, at any depth.

    Arrays give a row with their scalar elements and are descended into by offset; objects are only descended into. A batch
    operation: one job finds the depth, and then a single pass without a shuffle descends a level at a time.
    """
    spark = df.sparkSession
    level = df.select(*key, F.struct(F.lit(None).cast("string").alias("path"), F.col(event).alias("v"), F.lit(False).alias("done")).alias("node__")).where(F.col("node__.v").isNotNull())
    left = df.agg(F.max(depth(F.col(event)))).first()[0] or 0
    while left > 0:
        for _ in range(min(left, LEVELS)):
            level = _descend(level, key)
        left -= LEVELS
        if left > 0:
            path = folders.fresh(spark, "flatten")
            level.write.parquet(path)
            level = spark.read.schema(level.schema).parquet(path)
    rows = level.where(F.col("node__.path").isNotNull()).select(*key, "node__.path", "node__.v")  # the root has no path
    tag = variant_tag(F.col("v"))
    rows = rows.withColumn("tag", F.coalesce(tag, F.lit("array")))
    of = lambda t, kind: F.when(F.col("tag") == t, F.try_variant_get("v", "$", kind))
    return rows.select(*key, "path", "tag", of("number", "double").alias("num"), of("string", "string").alias("str"), of("bool", "boolean").alias("bool"), F.when(F.col("tag") == "array", VariantEvent("v").elements(())).alias("elements"))


def flatten_paths(df: DataFrame, key: list[str], paths: list[Path], event: str = "event") -> DataFrame:
    """Only the given paths, each read once in one projection: (key.., path, tag, num, str, bool)."""
    e = VariantEvent(event)
    found = F.array(*[F.struct(F.lit(path_text(p)).alias("path"), e.scalar(p).struct().alias("s")) for p in paths])
    rows = df.select(*key, F.explode(F.filter(found, lambda x: x["s"].isNotNull())).alias("x"))
    return rows.select(*key, "x.path", "x.s.*")


def compare_tags(a: Column, b: Column) -> Column:
    """Whether two scalars (structs) are of one type; a missing one is of none."""
    return F.coalesce(a["tag"] == b["tag"], F.lit(False))


def order_key(s: Column) -> Column:
    """A struct that sorts scalars like the typed order null < boolean < number < string."""
    rank = F.when(s["tag"] == "null", 0).when(s["tag"] == "bool", 1).when(s["tag"] == "number", 2).when(s["tag"] == "string", 3)
    return F.struct(rank.alias("rank"), s["bool"].alias("bool"), s["num"].alias("num"), s["str"].alias("str"))


def utf8_prefix(text: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` UTF-8 bytes that doesn't cut a character."""
    b = F.encode(text, "UTF-8")
    starts = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80
    cut = F.coalesce(*[F.when(starts(F.lit(n + 1 - j)), n - j) for j in range(4) if n - j >= 0], F.lit(0))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(b, F.lit(1), cut), "UTF-8"))


#: The usual base64 digits, and digits in the order of their bytes.
USUAL, ORDERED = (f"{a}{b}" for a, b in (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789+/"), ("-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "_abcdefghijklmnopqrstuvwxyz")))


def radix64(data: Column) -> Column:
    """Bytes as text of 64 digits that sorts as the bytes do, also where one is a prefix of the other."""
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), USUAL, ORDERED)


def from_radix64(text: Column) -> Column:
    """The bytes again."""
    usual = F.translate(text, ORDERED, USUAL)
    return F.unbase64(F.rpad(usual, F.length(usual) + (4 - F.length(usual) % 4) % 4, "="))


def long_bytes(x: Column) -> Column:
    """A long as its 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def long_of(data: Column) -> Column:
    """The long of 8 bytes."""
    h = F.hex(data)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.when(F.octet_length(data) == 8, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def random_id(n: int = 15) -> Column:
    """Random bytes as base64."""
    return F.base64(F.to_binary(F.substring(F.concat(F.sha2(F.uuid(), 256), F.sha2(F.uuid(), 256)), 1, 2 * n), F.lit("hex")))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
