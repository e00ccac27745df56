"""The query language: ``key=value`` terms joined by ``&`` into conjunctions, and those by ``;``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from urllib.parse import unquote_plus

from .errors import QueryError
from .paths import Path, parse_key

__all__ = ["Conjunction", "Literal", "Prefix", "Query", "QueryError", "Range", "parse", "parse_literal"]

MAX_TERMS = 32


@dataclass(frozen=True)
class Literal:
    """A JSON scalar: tag is null, bool, number or string."""

    tag: str
    value: None | bool | float | str = None

    def order(self) -> tuple:
        return (("null", "bool", "number", "string").index(self.tag), self.value.encode() if isinstance(self.value, str) else self.value if self.value is not None else 0)


@dataclass(frozen=True)
class Range:
    """At least ``low`` and at most ``high``; None is unbounded. Open bounds are told by exclusions beside it."""

    path: Path
    low: Literal | None = None
    high: Literal | None = None

    @property
    def tag(self) -> str:
        return (self.low or self.high).tag


@dataclass(frozen=True)
class Prefix:
    path: Path
    text: str


@dataclass(frozen=True)
class Conjunction:
    """All of: equalities by path, one range or prefix, contained elements, and exclusions."""

    equal: dict[Path, Literal] = field(default_factory=dict)
    inequality: Range | Prefix | None = None
    contains: tuple[tuple[Path, Literal], ...] = ()
    unequal: tuple[tuple[Path, Literal], ...] = ()
    #: One entry for each term as it was written.
    paths: tuple[Path, ...] = ()

    @property
    def positive(self) -> int:
        return len(self.equal) + (self.inequality is not None) + len(self.contains)


@dataclass(frozen=True)
class Query:
    conjunctions: tuple[Conjunction, ...]
    text: str = ""


def parse_literal(text: str, key: str = "", max_value_bytes: int | None = None) -> Literal:
    """A JSON null, boolean, number or string; anything else is a string as it stands."""

    def whole(s: str) -> Literal:
        if max_value_bytes is not None and len(s.encode()) > max_value_bytes:
            raise QueryError("string-too-long", key=key, maxValueLength=max_value_bytes)
        return Literal("string", s)

    def refuse(name: str):
        raise ValueError(name)

    try:
        v = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return whole(text)
    if v is None:
        return Literal("null")
    if isinstance(v, bool):
        return Literal("bool", v)
    if isinstance(v, (int, float)):
        try:
            return Literal("number", float(v))
        except OverflowError:
            return Literal("number", float("inf") if v > 0 else float("-inf"))
    return whole(v) if isinstance(v, str) else whole(text)


def _terms(text: str) -> dict[str, list[str]]:
    """Percent-decoded keys with their values, keys in order of first use; a bare key has the empty value."""
    out: dict[str, list[str]] = {}
    for part in text.split("&"):
        if part:
            key, _, value = part.partition("=")
            out.setdefault(unquote_plus(key), []).append(unquote_plus(value))
    return out


def parse_conjunction(text: str, max_terms: int = MAX_TERMS, max_value_bytes: int | None = None) -> Conjunction:
    equal: dict[Path, Literal] = {}
    ineq: Range | Prefix | None = None
    contains: dict[tuple[Path, Literal], None] = {}
    unequal: dict[tuple[Path, Literal], None] = {}
    paths: list[Path] = []
    used: str | None = None  # the inequality operator so far, with its path and value
    used_path, used_value = None, None
    for key, values in _terms(text).items():
        for value in values:
            if len(paths) >= max_terms:
                raise QueryError("too-many-terms", allowedTerms=max_terms)
            path = parse_key(key)
            paths.append(path)
            op = next((o for o in ("<=", ">=", "<", ">", "~", "[", "!") if value.startswith(o)), "")
            if value == "":
                equal[path] = Literal("string", "")
                ineq = None if ineq and ineq.path == path else ineq
                continue
            # The bytes of the path count against the budget too.
            left = None if max_value_bytes is None else max_value_bytes - sum(len(s.encode()) for s in path)
            lit = parse_literal(value[len(op) :], key, left)
            if op in ("<", "<=", ">", ">="):
                if used is not None:
                    other = ">" if op[0] == "<" else "<"
                    if not used.startswith(other) or used_path != path:
                        raise QueryError("inequality-operator-already-used", operator=used)
                    if lit.tag != used_value.tag:
                        raise QueryError("incompatible-types-in-between", key=key)
                    used = "between"
                    low, high = sorted((lit, used_value), key=Literal.order)  # reversed bounds are swapped
                    ineq = Range(path, low, high)
                else:
                    used = op
                    ineq = Range(path, high=lit) if op[0] == "<" else Range(path, low=lit)
                equal.pop(path, None)
                if len(op) == 1:
                    unequal[path, lit] = None
                used_path, used_value = path, lit
            elif op == "~":
                if used is not None:
                    raise QueryError("inequality-operator-already-used", operator=used)
                if lit.tag != "string":
                    raise QueryError("non-string-for-starts-with", value=value[1:])
                used, used_path, used_value = op, path, lit
                ineq = Prefix(path, lit.value)
                equal.pop(path, None)
            elif op == "[":
                contains[path, lit] = None
            elif op == "!":
                unequal[path, lit] = None
            elif path in equal:
                raise QueryError("equality-operator-already-used", key=key)
            else:
                equal[path] = lit
                ineq = None if ineq and ineq.path == path else ineq
    return Conjunction(equal, ineq, tuple(contains), tuple(unequal), tuple(paths))


def parse(text: str, max_terms: int = MAX_TERMS, max_value_bytes: int | None = None, body: str | None = None) -> Query:
    """The query of a query string. All of it is read before anything is accepted; an empty conjunction matches all."""
    if body:
        raise QueryError("unexpected-body")
    return Query(tuple(parse_conjunction(c, max_terms, max_value_bytes) for c in text.split(";")), text)
