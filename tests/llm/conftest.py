"""Documents that are odd in every way the operators have to bear."""

from __future__ import annotations

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))
WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "ia", "on", "ute")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, repeated rows and ids, long texts, special strings, near copies."""
    rng = random.Random(7)
    base, other = prose(rng, 150), prose(rng, 150)
    near = base.split(" ")
    near[70] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\r\n\v\f "), (4, "one"), (4, "one"), (5, "One"), (6, "one two three"), (7, base), (8, base.upper()), (9, " ".join(near)), (9, " ".join(near)), (10, other), (None, other), (None, None), (11, LONG),
        (12, LONG + " tail"), (13, "<|endoftext|> <|startoftext|> a\x00b     nbsp glued 日本語 𝄞 é́"), (14, "x" * 5000), (15, "x" * 5000 + "y"), (16, base + " " + base), (17, "　".join(["全角", "空白"] * 30)), (18, "word " * 300), (-3, other + " " + base),
        (19, "a\u0085b\x1cc\x1dd\x1ee\x1ff"), (20, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(700))), (2**40, base[:500]),
    ]
    for i in range(40):
        part = prose(rng, 40)
        rows += [(100 + 2 * i, prose(rng, rng.randrange(1, 60)) + " " + part), (101 + 2 * i, part + " " + prose(rng, rng.randrange(1, 60)))]
    rng.shuffle(rows)
    return rows


CLASHES = ("rid", "id", "comp", "cid", "n", "h", "row", "row__", "text__", "score", "rank", "key", "size", "kept", "page", "lines", "host", "fp", "item", "w", "block", "label")


@pytest.fixture(scope="session")
def odd(spark):
    """The rows as (doc_id, text), in many columns of names that operators use inside."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.select("doc_id", "text", *[F.lit(i).cast("string").alias(c) for i, c in enumerate(CLASHES)])
    return rows, df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def as_rows(df, *columns):
    """Rows as sortable tuples, null ids first."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


@pytest.fixture(scope="session")
def collected():
    return as_rows
