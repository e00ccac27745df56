"""Events against all standing queries at once.

The stream stays partitioned as it is and the queries go to it. ``match_by_filter`` compiles every query into one
projection and suits a few queries; ``match_by_join`` looks conjunctions up by one anchor term each and checks the others
on what is found, and suits many.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resolve import SCALAR
from ..plans.compile import Event, matches
from ..plans.paths import path_text
from ..plans.registry import STANDING, TERM, Registry

#: Rows of the registry that are broadcast at most; a larger one is joined by a shuffle on its anchors.
BROADCAST_CONJUNCTIONS = 100_000
#: Conjunctions of a query up to which one is told only if none before it holds; matches of longer queries are made distinct.
CHECKED_BEFORE = 16


def match_by_filter(events: DataFrame, registry: Registry, event: Event, channel: str = "channel") -> DataFrame:
    """``events`` with client_id and query_id, a row for each matching query."""
    hits = []
    for (ch, client, qid), q in registry.entries.items():
        hits.append(F.when((F.col(channel) == ch) & matches(q, event), F.struct(F.lit(client).alias("client_id"), F.lit(qid).alias("query_id"))))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<client_id:string,query_id:string>>")
    return events.withColumn("hit__", F.explode(found)).select(*events.columns, "hit__.client_id", "hit__.query_id")


def scalar_key(s: Column) -> Column:
    """A scalar as text that is equal for equal scalars only, see ``registry.lookup_key``."""
    num = s["num"] + F.lit(0.0)
    return F.when(s["tag"] == "string", F.concat(F.lit("s"), s["str"])).when(s["tag"] == "number", F.concat(F.lit("n"), F.hex(F.xxhash64(num)))).when(s["tag"] == "bool", F.concat(F.lit("b"), s["bool"].cast("string"))).when(s["tag"] == "null", F.lit("z"))


def _same(t: Column, s: Column) -> Column:
    v = F.when(t["tag"] == "number", s["num"] == t["num"]).when(t["tag"] == "string", s["str"] == t["str"]).when(t["tag"] == "bool", s["bool"] == t["bool"]).otherwise(F.lit(True))
    return F.coalesce((s["tag"] == t["tag"]) & v, F.lit(False))


def _between(t: Column, s: Column) -> Column:
    def side(low: bool, has: Column, end: str) -> Column:
        cmp = lambda f: (s[f] >= t[f + end]) if low else (s[f] <= t[f + end])
        return ~has | F.when(t["tag"] == "number", cmp("num")).when(t["tag"] == "string", cmp("str")).when(t["tag"] == "bool", cmp("bool")).otherwise(F.lit(True))

    return F.coalesce((s["tag"] == t["tag"]) & side(True, t["low"], "") & side(False, t["high"], "_hi"), F.lit(False))


def holds(t: Column, scalars: Column, arrays: Column) -> Column:
    """Whether a term of the registry holds for an event's maps of scalars and arrays; never NULL."""

    def scalar_holds(s: Column) -> Column:
        prefix = F.coalesce((s["tag"] == "string") & F.startswith(s["str"], t["str"]), F.lit(False))
        return F.when(t["kind"] == "eq", _same(t, s)).when(t["kind"] == "ne", ~_same(t, s)).when(t["kind"] == "range", _between(t, s)).otherwise(prefix)

    found = F.coalesce(F.exists(F.element_at(arrays, t["path"]), lambda x: _same(t, x)), F.lit(False))
    # As an array of one, the scalar is looked up once and not at each mention.
    return F.when(t["kind"] == "has", found).otherwise(F.transform(F.array(F.element_at(scalars, t["path"])), scalar_holds)[0])


def unsettled(r: tuple) -> list[tuple]:
    """The terms of a registry row that its anchor doesn't settle: numbers are looked up by a hash, everything else as it is."""
    settles = {"eq": "eq", "prefix": "prefix", "block": "range"}.get(r[5])
    return [t for t in r[8] if t[0] != settles or t[1] != r[6] or t[0] == "eq" and t[2] == "number"]


def extracted(events: DataFrame, registry: Registry, event: Event) -> DataFrame:
    """``events`` with maps ``scalars__`` and ``arrays__`` of the paths that queries look at, and nothing else."""
    paths = registry.paths()
    in_arrays = sorted({p for q in registry.entries.values() for c in q.conjunctions for p, _ in c.contains})
    none = F.create_map().cast(f"map<string,{SCALAR}>")
    scalars = F.create_map(*[x for p in paths for x in (F.lit(path_text(p)), event.struct(p))]) if paths else none
    arrays = F.create_map(*[x for p in in_arrays for x in (F.lit(path_text(p)), event.elements(p))]) if in_arrays else F.create_map().cast(f"map<string,array<{SCALAR}>>")
    return events.withColumns({"scalars__": scalars, "arrays__": arrays})


@dataclass
class Ranks:
    """The bounds that ranges of a path have, of one type, in order; a value's place among them.

    Bound j (from 0) has the place 2 j + 1, and a value between bounds an even one, so a range is a run of places.
    """

    path: str
    tag: str
    bounds: list

    @property
    def side(self) -> str:
        return "num" if self.tag == "number" else "str"

    def run(self, low, high) -> tuple[int, int]:
        """First and last place of a range; None is unbounded."""
        order = (lambda x: x) if self.tag == "number" else str.encode
        at = lambda v: 2 * bisect_left(self.bounds, order(v), key=order) + 1
        return (0 if low is None else at(low)), (2 * len(self.bounds) if high is None else at(high))

    def add_place(self, df: DataFrame, v: Column, name: str) -> DataFrame:
        """``df`` with a value's place as a column; NULL if it is of another type."""
        n, fits = len(self.bounds), (v["tag"] == self.tag) & v[self.side].isNotNull()
        v = v[self.side]
        # A constant, whatever their number, made of one literal.
        bounds = F.from_json(F.lit(json.dumps(self.bounds)), f"array<{'double' if self.tag == 'number' else 'string'}>")
        steps = F.lit([1 << i for i in range(n.bit_length() - 1, -1, -1)])
        # How many bounds the value reaches, by halves.
        reached = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.get(bounds, F.least(a + s, F.lit(n)) - 1) <= v), a + s).otherwise(a))
        df, i = df.withColumn(name, F.when(fits, reached)), F.col(name)
        return df.withColumn(name, F.when(i.isNotNull(), 2 * i - ((i > 0) & (F.get(bounds, F.greatest(i - 1, F.lit(0))) == v)).cast("int")))


def blocks_of(first: int, last: int) -> list[tuple[int, int]]:
    """The run of places first to last as few blocks (level, number) of 2**level places; a place is in one of them."""
    out, level = [], 0
    while first <= last:
        if first & 1:
            out.append((level, first))
            first += 1
        if not last & 1:
            out.append((level, last))
            last -= 1
        first, last, level = first >> 1, last >> 1, level + 1
    return out


def by_rank(rows: list[tuple]) -> tuple[list[tuple], list[tuple[Ranks, list[int]]]]:
    """Registry rows with ranges on numbers and strings dealt over blocks of places, and the ranks with the levels in use.

    A range among n bounds takes 2 log n blocks at most, and an event meets exactly the ranges that hold it.
    """
    ends = {}
    for r in rows:
        if r[5] == "range":
            t = next(t for t in r[8] if t[0] == "range" and t[1] == r[6])
            if t[2] in ("number", "string"):
                lo, hi = (t[3], t[8]) if t[2] == "number" else (t[4], t[9])
                ends[r[3]] = (r[6], t[2], lo if t[6] else None, hi if t[7] else None)
    seen: dict[tuple[str, str], set] = {}
    for path, tag, lo, hi in ends.values():
        seen.setdefault((path, tag), set()).update(x for x in (lo, hi) if x is not None)
    ranks = {k: Ranks(*k, sorted(v, key=lambda x: x.encode() if isinstance(x, str) else x)) for k, v in seen.items()}
    levels: dict[tuple[str, str], set[int]] = {k: set() for k in ranks}
    out = []
    for r in rows:
        if r[3] not in ends:
            out.append(r)
            continue
        path, tag, lo, hi = ends[r[3]]
        for level, number in blocks_of(*ranks[path, tag].run(lo, hi)):
            levels[path, tag].add(level)
            out.append((*r[:5], "block", path, f"{tag} {level} {number}", *r[8:]))
    return out, [(ranks[k], sorted(levels[k])) for k in sorted(ranks)]


def asking(events: DataFrame, rows: list[tuple], ranks: list[tuple[Ranks, list[int]]]) -> DataFrame:
    """A row for each event and anchor that could find something in the registry, as ``at__`` (a: anchor, p: path, k: key).

    First a row for each way to ask, with the scalar it is about, then the keys: what stands behind an explode is worked
    out once, however often the keys mention it.
    """
    v = F.col("ask__.s")
    asks: list[tuple[str, Column]] = []  # paths with the keys that their scalars ask for
    key = lambda anchor, p, k: F.struct(F.lit(anchor).alias("a"), F.lit(p).alias("p"), k.alias("k"))
    if paths := sorted({r[6] for r in rows if r[5] == "eq"}):
        asks += [(p, F.array(key("eq", p, scalar_key(v)))) for p in paths]
    sizes: dict[str, set[int]] = {}
    for r in rows:
        if r[5] == "prefix":
            sizes.setdefault(r[6], set()).add(len(r[7]))
    for p, ns in sorted(sizes.items()):
        asks.append((p, F.array(*[key("prefix", p, F.when(F.length(v["str"]) >= n, F.left(v["str"], F.lit(n)))) for n in sorted(ns)])))
    for j, (r, levels) in enumerate(ranks):
        asks.append((r.path, F.array(*[key("block", r.path, F.concat(F.lit(f"{r.tag} {n} "), F.shiftright(F.col(f"place_{j}__"), n).cast("string"))) for n in levels])))
    asks += [(p, F.array(key("range", p, F.lit("")))) for p in sorted({r[6] for r in rows if r[5] == "range"})]
    ways = [F.struct(F.lit(i).alias("i"), F.element_at("scalars__", p).alias("s")) for i, (p, _) in enumerate(asks)]
    if any(r[5] == "all" for r in rows):
        ways.append(F.struct(F.lit(len(ways)).alias("i"), F.lit(None).cast(SCALAR).alias("s")))
        asks.append(("", F.array(key("all", "", F.lit("")))))
    kept = events.columns
    events = events.withColumn("ask__", F.explode(F.array(*ways)))
    for j, (r, _) in enumerate(ranks):
        events = r.add_place(events, v, f"place_{j}__")
    keys = F.coalesce(*[F.when(F.col("ask__.i") == i, k) for i, (_, k) in enumerate(asks)])
    return events.select(*kept, F.explode(keys).alias("at__")).where(F.col("at__.k").isNotNull())


def match_by_join(events: DataFrame, registry: Registry, event: Event, channel: str = "channel", key: list[str] | None = None) -> DataFrame:
    """``events`` with client_id and query_id, a row for each matching query.

    An event that matches several conjunctions of one query is told once, by the first that holds; nothing is shuffled
    for that but the matches of queries with more than CHECKED_BEFORE conjunctions. ``key`` names the columns that
    identify an event there; without it, every column counts.

    Events are read once: each asks for its anchors in one array, which one join looks up. Conjunctions that any event of
    a channel meets (match-alls, and ranges of null or booleans) are no key for a shuffle, so beyond the bound of a
    broadcast they are broadcast in slices of it.
    """
    spark = events.sparkSession
    kept = events.columns
    standing = registry.rows()
    rows, ranks = by_rank(standing)
    if not rows:
        return events.withColumns({"client_id": F.lit(""), "query_id": F.lit("")}).where(F.lit(False))
    e = extracted(events, registry, event)
    asked = asking(e, rows, ranks)
    queries: dict[tuple, list[tuple]] = {}
    for r in standing:
        queries.setdefault(r[:3], []).append((r[3], r[8]))
    many = {q for q, c in queries.items() if len(c) > CHECKED_BEFORE}
    before = lambda r: [] if r[:3] in many else [terms for n, terms in queries[r[:3]] if n < r[3]]
    same_number = F.when((F.col("anchor") == "eq") & F.col("key").startswith("n"), F.concat(F.lit("n"), F.hex(F.xxhash64(F.expr("try_cast(substring(key, 2) AS double)"))))).otherwise(F.coalesce("key", F.lit("")))

    def met(rows: list[tuple], send: bool) -> DataFrame:
        table = spark.createDataFrame([(*r[:4], r[:3] in many, *r[5:8], unsettled(r), before(r)) for r in rows], f"{STANDING}, earlier array<array<{TERM}>>")
        table = table.select(F.col("channel").alias("channel__"), "client_id", "query_id", "several", "anchor", F.coalesce("path", F.lit("")).alias("path"), same_number.alias("key"), "terms", "earlier")
        found = (F.col(channel) == F.col("channel__")) & (F.col("at__.a") == F.col("anchor")) & (F.col("at__.p") == F.col("path")) & (F.col("at__.k") == F.col("key"))
        all_hold = lambda terms: F.forall(terms, lambda t: holds(t, F.col("scalars__"), F.col("arrays__")))
        left = all_hold(F.col("terms")) & ~F.exists("earlier", all_hold)
        return asked.join(F.broadcast(table) if send else table, found & left).select(*kept, "client_id", "query_id", "several")

    if len(rows) <= BROADCAST_CONJUNCTIONS:
        found = met(rows, True)
    else:
        wide = [r for r in rows if r[5] in ("range", "all")]
        found = met([r for r in rows if r[5] not in ("range", "all")], False)
        for a in range(0, len(wide), BROADCAST_CONJUNCTIONS):
            found = found.unionByName(met(wide[a : a + BROADCAST_CONJUNCTIONS], True))
    if not many:
        return found.drop("several")
    once = found.where("several").drop("several").dropDuplicates([*(key or kept), "client_id", "query_id"])
    return found.where("not several").drop("several").unionByName(once)


def per_client(found: DataFrame, key: list[str]) -> DataFrame:
    """One row for each event and client, with the sorted ids of the client's matching queries."""
    return found.groupBy(*key, "client_id").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))


def responders(found: DataFrame, key: list[str]) -> DataFrame:
    """Each event with the distinct clients that it goes to."""
    return found.select(*key, "client_id").distinct()
