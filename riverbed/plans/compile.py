"""Queries to boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resolve import Scalar, TypedEvent, VariantEvent
from .query import Conjunction, Literal, Prefix, Query, Range

Event = VariantEvent | TypedEvent


def _value(s: Scalar, lit: Literal) -> tuple[Column, Column]:
    """The side of a scalar that compares with a literal of this tag, and the literal."""
    if lit.tag == "number":
        whole = lit.value.is_integer() and abs(lit.value) < 2**53
        return s.num, F.lit(int(lit.value) if whole and s.only else lit.value)
    return (s.text, F.lit(lit.value)) if lit.tag == "string" else (s.flag, F.lit(lit.value))


def _tagged(s: Scalar, tag: str, test: Column) -> Column:
    """The test under the tag; where the type is known beforehand the tag needn't be looked at."""
    if s.only:
        return test if s.only == tag else F.lit(False)
    return (s.tag == tag) & test


def equal(s: Scalar, lit: Literal) -> Column:
    """Present, of the same type and the same value; may be NULL instead of false."""
    if lit.tag == "null":
        return s.tag == "null"
    have, want = _value(s, lit)
    return _tagged(s, lit.tag, have == want)


def in_range(s: Scalar, r: Range) -> Column:
    if r.tag == "null":
        return s.tag == "null"
    tests = []
    for lit, low in ((r.low, True), (r.high, False)):
        if lit is not None:
            have, want = _value(s, lit)
            tests.append(have >= want if low else have <= want)
    return _tagged(s, r.tag, reduce(Column.__and__, tests))


def starts_with(s: Scalar, text: str) -> Column:
    return _tagged(s, "string", s.text.startswith(text) if text else s.text.isNotNull())


def contains(elements: Column, lit: Literal) -> Column:
    side = {"number": "num", "string": "str", "bool": "bool"}.get(lit.tag)
    return F.exists(elements, lambda x: (x["tag"] == lit.tag) & ((x[side] == F.lit(lit.value)) if side else F.lit(True)))


def conjunction(c: Conjunction, event: Event) -> Column:
    """NULL counts as false at the top of a filter; under NOT it is made false first."""
    tests = [equal(event.scalar(p), v) for p, v in c.equal.items()]
    if isinstance(c.inequality, Range):
        tests.append(in_range(event.scalar(c.inequality.path), c.inequality))
    elif isinstance(c.inequality, Prefix):
        tests.append(starts_with(event.scalar(c.inequality.path), c.inequality.text))
    tests += [contains(event.elements(p), v) for p, v in c.contains]
    tests += [~F.coalesce(equal(event.scalar(p), v), F.lit(False)) for p, v in c.unequal]
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def where(q: Query, event: Event) -> Column:
    """For ``filter``: comparisons stay bare, so that they can be pushed down."""
    return reduce(Column.__or__, [conjunction(c, event) for c in q.conjunctions])


def matches(q: Query, event: Event) -> Column:
    """For ``select``: never NULL."""
    return F.coalesce(where(q, event), F.lit(False))


def filter_events(df: DataFrame, q: Query, event: Event) -> DataFrame:
    return df.where(where(q, event))
