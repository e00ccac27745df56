"""Column helpers for operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once: higher-order functions would otherwise inline it into their lambdas."""
    return F.transform(F.array(x), f)[0]


def ascii_lower(x: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(x, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def inner(p: Column) -> Column:
        """Only the first and the last part can be empty."""
        first = (F.get(p, F.lit(0)) == "").cast("int")
        last = ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int")
        return F.slice(p, first + 1, F.size(p) - first - last)

    return let(parts, inner)
