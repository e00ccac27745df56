"""The engine's queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import flatten as fl
from .functions.resolve import TypedEvent, VariantEvent
from .operators import dedupe, index
from .operators.match import match_by_filter, match_by_join, per_client, responders
from .plans.compile import filter_events
from .plans.paths import Path
from .plans.query import parse
from .plans.registry import DurableRegistry, Registry
from .sources import envelope
from .streaming import folders, pipeline, sse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENT_COLUMNS: dict[Path, str] = {("type",): "event_type", ("data", "user_id"): "user_id", ("data", "value"): "value"}
_E = "SELECT event_id, event_type, user_id, value FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def typed_filter(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A standing query as a filter of the typed events table; comparisons reach the scan."""
    e = table(spark, sf_dir, "events")
    return filter_events(e, parse(text), TypedEvent(e, EVENT_COLUMNS)).select("event_id", "event_type", "user_id", "value")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in its envelope, one VARIANT for each event."""
    e = table(spark, sf_dir, "events")
    data = {"user_id": F.col("user_id"), "value": F.col("value"), "props": F.from_json("props", "k bigint")}
    return envelope.table_events(e, "main", "//events", "event_id", "event_type", data)


def variant_filter(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return filter_events(events(spark, sf_dir), parse(text), VariantEvent("event")).select("event_id", "event_type", "user_id", "value")


_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
#: name -> (query string, SQL condition, whether it looks into JSON)
FILTERS: dict[str, tuple[str, str, bool]] = {
    "f_eq_str": ('../type="error"', "event_type = 'error'", False),
    "f_eq_bare_str": ("../type=error", "event_type = 'error'", False),
    "f_eq_num": ("user_id=12", "user_id = 12", False),
    "f_eq_empty": ("../type=", "event_type = ''", False),
    "f_eq_null": ("value=null", "value IS NULL", False),
    "f_ne": ('../type=!"view"', "event_type <> 'view'", False),
    "f_ne_missing": ("nosuch=!1", "true", False),
    "f_ne_type": ('user_id=!"12"', "true", False),
    "f_lt": ("value=<50", "value < 50", False),
    "f_le": ("value=<=50", "value <= 50", False),
    "f_ge": ("value=>=50", "value >= 50", False),
    "f_gt": ("value=>50", "value > 50", False),
    "f_between_oo": ("value=>10&value=<50", "value > 10 AND value < 50", False),
    "f_between_cc": ("value=>=10&value=<=50", "value >= 10 AND value <= 50", False),
    "f_between_co": ("user_id=>=10&user_id=<50", "user_id >= 10 AND user_id < 50", False),
    "f_between_reversed": ("value=>50&value=<10", "value > 10 AND value < 50", False),
    "f_range_str": ("../type=>=\"p\"", "event_type >= 'p'", False),
    "f_type_strict": ('value=<"6"', "false", False),
    "f_prefix": ('../type=~"s"', "starts_with(event_type, 's')", False),
    "f_prefix_all": ("../type=~", "true", False),
    "f_and": ('../type="purchase"&value=>=20&user_id=!7', "event_type = 'purchase' AND value >= 20 AND user_id <> 7", False),
    "f_or": ('../type="click";value=<5', "event_type = 'click' OR value < 5", False),
    "f_dnf": ('../type="click"&value=>90;../type=~"s"&user_id=7;user_id=3', "(event_type = 'click' AND value > 90) OR (starts_with(event_type, 's') AND user_id = 7) OR user_id = 3", False),
    "f_match_all": ("", "true", False),
    "f_trailing_or": ("user_id=1;", "true", False),
    "f_json_path": ("/props/k=<50", f"{_K} < 50", True),
    "f_json_eq": ("/props/k=7", f"{_K} = 7", True),
    "f_json_ne": ("/props/k=!7", f"{_K} <> 7", True),
    "f_json_missing": ("/props/z=!7&/props=!7", "true", True),
    "f_json_type_strict": ('/props/k="7"', "false", True),
    "f_json_and": ('/props/k=>=10&/props/k=<=20&../type="purchase"', f"{_K} BETWEEN 10 AND 20 AND event_type = 'purchase'", True),
    "f_json_envelope": ('../source="//events"&../specversion="1.0"&user_id=<=20', "user_id <= 20", True),
}
for _name, (_text, _cond, _json) in FILTERS.items():
    QUERIES[_name] = (lambda f, t: lambda spark, sf_dir: f(spark, sf_dir, t))(variant_filter if _json else typed_filter, _text)
    ORACLES[_name] = f"{_E} WHERE {_cond}"


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("roles"))


def _roles_where(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    r = roles(spark, sf_dir)
    return filter_events(r, parse(text), TypedEvent(r, {("data", "roles"): "roles"})).select("conv_id", F.size("roles").cast("long").alias("turns"))


_R = "SELECT conv_id, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id HAVING "
_FIRST = "list_extract(list(role ORDER BY turn, role), 1)"
for _name, _text, _cond in (
    ("f_contains", 'roles=["system"', "list_contains(list(role), 'system')"),
    ("f_contains_all", 'roles=["user"&roles=["assistant"', "list_contains(list(role), 'user') AND list_contains(list(role), 'assistant')"),
    ("f_array_index", '/roles/0="user"', f"{_FIRST} = 'user'"),
    ("f_array_index_ne", '/roles/0=!"user"&/roles/00=!"user"', f"{_FIRST} IS DISTINCT FROM 'user'"),
):
    QUERIES[_name] = (lambda t: lambda spark, sf_dir: _roles_where(spark, sf_dir, t))(_text)
    ORACLES[_name] = _R + _cond


@query("f_single_predicate", f"{_E} WHERE user_id = 5 AND value >= 10")
def f_single_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_filter(spark, sf_dir, "user_id=5&value=>=10")


# Fan-out: registries of standing queries against every event.


def registry(kind: str) -> Registry:
    r = Registry()
    types = ("view", "click", "signup", "purchase", "error")
    if kind in ("eq", "mixed"):
        for i in range(40):
            r.add("main", f"c{i % 4}", f"eq{i}", f"user_id={i * 3}" + ("&../type=!\"view\"" if i % 2 else ""))
    if kind in ("range", "mixed"):
        for i in range(12):
            r.add("main", f"c{i % 3}", f"rg{i}", f"value=>={i * 8}&value=<{i * 8 + 4}")
    if kind in ("prefix", "mixed"):
        for i, t in enumerate(types):
            r.add("main", f"c{i}", f"px{i}", f'../type=~"{t[:2]}"&user_id=!{i}')
    if kind == "mixed":
        r.add("main", "c0", "or0", '../type="error";value=<1;user_id=3')
        r.add("main", "c1", "ne0", '../type=!"view"&user_id=<10')
        r.add("main", "c2", "all", "")
        r.add("other", "c9", "elsewhere", "")
    return r


def _registry_sql(kind: str) -> str:
    """The same registry as a relation of SQL conditions, one SELECT for each query."""
    parts = []
    types = ("view", "click", "signup", "purchase", "error")
    say = lambda client, qid, cond: parts.append(f"SELECT event_id, '{client}' AS client_id, '{qid}' AS query_id FROM events WHERE {cond}")
    if kind in ("eq", "mixed"):
        for i in range(40):
            say(f"c{i % 4}", f"eq{i}", f"user_id = {i * 3}" + (" AND event_type <> 'view'" if i % 2 else ""))
    if kind in ("range", "mixed"):
        for i in range(12):
            say(f"c{i % 3}", f"rg{i}", f"value >= {i * 8} AND value < {i * 8 + 4}")
    if kind in ("prefix", "mixed"):
        for i, t in enumerate(types):
            say(f"c{i}", f"px{i}", f"starts_with(event_type, '{t[:2]}') AND user_id <> {i}")
    if kind == "mixed":
        say("c0", "or0", "event_type = 'error' OR value < 1 OR user_id = 3")
        say("c1", "ne0", "event_type <> 'view' AND user_id < 10")
        say("c2", "all", "true")
    return " UNION ALL ".join(parts)


def fan_out(spark: SparkSession, sf_dir: str, kind: str, join: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("channel", F.lit("main"))
    match = match_by_join if join else match_by_filter
    options = {"key": ["event_id"]} if join else {}
    e = e.select("channel", "event_id", "event_type", "user_id", "value")
    return match(e, registry(kind), TypedEvent(e, EVENT_COLUMNS), **options).select("event_id", "client_id", "query_id")


for _kind in ("eq", "range", "prefix", "mixed"):
    QUERIES[f"m_fanout_{_kind}"] = (lambda k: lambda spark, sf_dir: fan_out(spark, sf_dir, k))(_kind)
    ORACLES[f"m_fanout_{_kind}"] = _registry_sql(_kind)


def one_sided() -> Registry:
    """Bounds on one side only, on numbers and on strings, among them open ones."""
    r = Registry()
    for i in range(10):
        r.add("main", f"c{i % 2}", f"lt{i}", f"value=<{i * 3}")
        r.add("main", f"c{i % 2}", f"le{i}", f"user_id=<={i * 2}")
        r.add("main", f"c{i % 2}", f"gt{i}", f"value=>{100 - i}")
        r.add("main", f"c{i % 2}", f"ge{i}", f'../type=>="s"&user_id=!{i}')
    return r


_ONE_SIDED = " UNION ALL ".join(
    f"SELECT event_id, '{q}{i}' AS query_id FROM events WHERE {c}"
    for i in range(10)
    for q, c in (("lt", f"value < {i * 3}"), ("le", f"user_id <= {i * 2}"), ("gt", f"value > {100 - i}"), ("ge", f"event_type >= 's' AND user_id <> {i}"))
)


@query("m_fanout_one_sided", _ONE_SIDED)
def m_fanout_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("main").alias("channel"), "event_id", "event_type", "user_id", "value")
    return match_by_join(e, one_sided(), TypedEvent(e, EVENT_COLUMNS), key=["event_id"]).select("event_id", "query_id")


@query("m_fanout_contains", " UNION ALL ".join(f"SELECT conv_id, 'has_{w}' AS query_id FROM conversations GROUP BY conv_id HAVING list_contains(list(role), '{w}')" for w in ("system", "user", "assistant")) + " UNION ALL SELECT conv_id, 'later' FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'assistant') AND list_extract(list(role ORDER BY turn, role), 1) <> 'assistant'")
def m_fanout_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Registry()
    for w in ("system", "user", "assistant"):
        r.add("main", "c", f"has_{w}", f'roles=["{w}"')
    r.add("main", "c", "later", 'roles=["assistant"&roles=!"assistant"&/roles/0=!"assistant"')
    e = roles(spark, sf_dir).withColumn("channel", F.lit("main"))
    return match_by_join(e, r, TypedEvent(e, {("data", "roles"): "roles"}), key=["conv_id"]).select("conv_id", "query_id")


@query("m_channels", "SELECT event_id, 'a' AS query_id FROM events WHERE event_id % 3 = 0 AND user_id < 30 UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 3 = 1 AND user_id < 30 UNION ALL SELECT event_id, 'all' FROM events WHERE event_id % 3 = 1")
def m_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries see the events of their own channel only; a client on two channels has a query on each."""
    r = Registry()
    r.add("c0", "x", "a", "user_id=<30")
    r.add("c1", "x", "b", "user_id=<30")
    r.add("c1", "y", "all", "")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("event_id") % 3).alias("channel"), "event_id", "user_id")
    return match_by_join(e, r, TypedEvent(e, {("data", "user_id"): "user_id"}), key=["event_id"]).select("event_id", "query_id")


@query("m_fanout_filter", _registry_sql("mixed"))
def m_fanout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_out(spark, sf_dir, "mixed", join=False)


@query("m_fanout_variant", _registry_sql("mixed"))
def m_fanout_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("channel", "event_id", "event")
    return match_by_join(e, registry("mixed"), VariantEvent("event"), key=["event_id"]).select("event_id", "client_id", "query_id")


@query("m_collect_queries", f"SELECT event_id, client_id, string_agg(DISTINCT query_id, ',' ORDER BY query_id) AS query_ids FROM ({_registry_sql('mixed')}) GROUP BY event_id, client_id")
def m_collect_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_client(fan_out(spark, sf_dir, "mixed"), ["event_id"]).withColumn("query_ids", F.array_join("query_ids", ","))


@query("m_responders", f"SELECT DISTINCT event_id, client_id FROM ({_registry_sql('mixed')})")
def m_responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responders(fan_out(spark, sf_dir, "mixed"), ["event_id"])


# Joins of the index library.

_RANGES = [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate([(1, 5), (4, 9), (30, 20), (45, 50), (7, 7), (48, 60)])]
_RANGES_SQL = "(VALUES " + ", ".join(f"({i}, {lo}, {hi})" for i, lo, hi in _RANGES) + ") r(range_id, lo, hi)"
_SWAP = "least(r.lo, r.hi) AND greatest(r.lo, r.hi)"


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RANGES, "range_id int, lo double, hi double")


@query("m_interval_stab", f"SELECT l_orderkey, l_linenumber, range_id FROM lineitem, {_RANGES_SQL} WHERE l_quantity BETWEEN {_SWAP}")
def m_interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stab(table(spark, sf_dir, "lineitem"), "l_quantity", ranges(spark), "lo", "hi").select("l_orderkey", "l_linenumber", "range_id")


@query("m_interval_stab_binned", f"SELECT l_orderkey, l_linenumber, range_id FROM lineitem, {_RANGES_SQL} WHERE l_quantity BETWEEN {_SWAP}")
def m_interval_stab_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stab(table(spark, sf_dir, "lineitem"), "l_quantity", ranges(spark), "lo", "hi", width=4.0).select("l_orderkey", "l_linenumber", "range_id")


@query("m_interval_overlap", f"SELECT p_partkey, range_id FROM part, {_RANGES_SQL} WHERE p_size <= greatest(r.lo, r.hi) AND least(r.lo, r.hi) <= p_size + 3")
def m_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_size") + 3).cast("double").alias("b"))
    return index.overlap(p, "a", "b", ranges(spark), "lo", "hi", width=5.0).select("p_partkey", "range_id")


@query("m_interval_exact", f"SELECT p_partkey, range_id FROM part, {_RANGES_SQL} WHERE p_size = least(r.lo, r.hi) AND p_size + 5 = greatest(r.lo, r.hi)")
def m_interval_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_size") + 5).cast("double").alias("b"))
    return index.exact_range(p, "b", "a", ranges(spark), "lo", "hi").select("p_partkey", "range_id")


@query("m_interval_range", f"SELECT min(least(r.lo, r.hi)) AS lowest, max(least(r.lo, r.hi)) AS highest FROM {_RANGES_SQL}")
def m_interval_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = index.ordered(F.col("lo"), F.col("hi"))
    r = index.extremes(index.in_order(ranges(spark).select(lo.alias("lo"), hi.alias("hi")), "lo", "hi"), "lo", "hi")
    return r.select(F.col("first.lo").alias("lowest"), F.col("last.lo").alias("highest"))


_PREFIXES = ["Brand", "Brand#1", "Brand#12", "Brand#3", "X", ""]
_PREFIXES_SQL = "(VALUES " + ", ".join(f"('{p}')" for p in _PREFIXES) + ") x(prefix)"


@query("m_prefix_of", f"SELECT p_partkey, prefix FROM part, {_PREFIXES_SQL} WHERE starts_with(p_brand, prefix)")
def m_prefix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(x,) for x in _PREFIXES], "prefix string")
    return index.prefixes_of(table(spark, sf_dir, "part"), "p_brand", p, "prefix", sorted({len(x) for x in _PREFIXES})).select("p_partkey", "prefix")


@query("m_prefix_scan", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#2')")
def m_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.keys_starting_with(table(spark, sf_dir, "part"), "p_brand", "Brand#2").select("p_partkey", "p_brand")


# Ordered maps.

_O = "SELECT o_orderkey, o_totalprice FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("o_asc", _O)
def o_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.ascending(_orders(spark, sf_dir), "o_orderkey")


@query("o_desc", _O)
def o_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.descending(_orders(spark, sf_dir), "o_orderkey")


@query("o_le_desc", f"{_O} WHERE o_orderkey <= 2000")
def o_le_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.at_most(_orders(spark, sf_dir), "o_orderkey", 2000)


@query("o_ge_asc", f"{_O} WHERE o_orderkey >= 9000")
def o_ge_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.at_least(_orders(spark, sf_dir), "o_orderkey", 9000)


@query("o_min", f"{_O} ORDER BY o_orderkey LIMIT 1")
def o_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.first(_orders(spark, sf_dir), "o_orderkey")


@query("o_keys", "SELECT o_orderkey FROM orders")
def o_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.keys(_orders(spark, sf_dir), "o_orderkey")


@query("o_scan", _O)
def o_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries in no order."""
    return index.entries(_orders(spark, sf_dir), "o_orderkey", "o_totalprice")


@query("o_get", f"{_O} WHERE o_orderkey = 77")
def o_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.get(_orders(spark, sf_dir), "o_orderkey", 77)


@query("o_put_remove", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0")
def o_put_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    o = index.put(o, o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey")
    return index.remove(o, _orders(spark, sf_dir).where("o_orderkey % 5 = 0"), "o_orderkey")


@query("o_range", f"{_O} WHERE o_orderkey BETWEEN 500 AND 1500")
def o_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.at_least(_orders(spark, sf_dir).where("o_orderkey <= 1500"), "o_orderkey", 500)


@query("o_identity_set", "SELECT o_custkey, count(*) > 0 AS member FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey UNION ALL SELECT DISTINCT o_custkey, false FROM orders WHERE o_custkey % 7 = 0")
def o_identity_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of ids: added with repeats, some taken out, then each id asked for."""
    ids = table(spark, sf_dir, "orders").select("o_custkey")
    held = index.discard(index.add(ids.where("false"), ids), ids.where("o_custkey % 7 = 0"))
    return index.contains(ids.distinct(), held, "o_custkey", "member")


@query("o_delivery_order", """
SELECT event_id, CAST(event_id // 300 AS BIGINT) AS batch_id, CAST((event_id % 300) // 256 AS BIGINT) AS chunk, CAST(row_number() OVER (PARTITION BY event_id // 300 ORDER BY event_id) - 1 AS INTEGER) AS "offset" FROM events
""")  # fmt: skip
def o_delivery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one request keep its order and go out in chunks of 256."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 300).alias("batch_id"))
    return index.delivery_order(e, "batch_id", "event_id").select("event_id", "batch_id", F.floor((F.col("event_id") % 300) / 256).alias("chunk"), "offset")


# Streams, registry, sinks and sources.


@query("t_dedupe", "SELECT '//events' AS source, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'early' ELSE 'first' END AS copy FROM events")
def t_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event three times; the earliest counts, and of those of one time the first of its request."""
    e = table(spark, sf_dir, "events").select(F.lit("main").alias("channel"), F.lit("//events").alias("source"), F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2 == 0).alias("even"))
    copy = lambda name, seconds, offset: e.select("channel", "source", "id", F.lit(name).alias("copy"), (F.col("ts") + F.expr(f"INTERVAL '1' SECOND") * seconds).alias("ingest_ts"), F.lit(offset).alias("offset"))
    late, first = copy("late", F.lit(2), 0), copy("first", F.lit(1), 1)
    early = copy("early", F.when(F.col("even"), 0).otherwise(1), 2)
    return dedupe.first_events(late.unionAll(early).unionAll(first)).select("source", "id", "copy")


@query("t_dedupe_ttl", """
WITH RECURSIVE t AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS s FROM events GROUP BY ALL),
a AS (SELECT user_id, event_type, min(s) AS s FROM t GROUP BY user_id, event_type
  UNION ALL SELECT a.user_id, a.event_type, (SELECT min(t.s) FROM t WHERE t.user_id = a.user_id AND t.event_type = a.event_type AND t.s >= a.s + 86400)
  FROM a WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = a.user_id AND t.event_type = a.event_type AND t.s >= a.s + 86400))
SELECT user_id, event_type, count(*) AS accepted FROM a GROUP BY user_id, event_type
""")  # fmt: skip
def t_dedupe_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ingest_ts"))
    first = dedupe.first_events_within(e, 86_400, ["user_id", "event_type"])
    return first.groupBy("user_id", "event_type").agg(F.count("*").alias("accepted"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream of requests, each told twice, with an arrival time."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    out = envelope.table_events(e, "main", "//events", "event_id", "event_type", {"user_id": F.col("user_id"), "value": F.col("value")})
    out = out.withColumn("ingest_ts", F.to_timestamp_ltz(F.lit("2024-01-01 00:00:00")))
    twice = out.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.select("channel", "source", "id", "ingest_ts", "raw")


def _run_stream(spark: SparkSession, df: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", folders.fresh(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("t_stream_dedupe", "SELECT DISTINCT '//events' AS source, CAST(event_id AS VARCHAR) AS id FROM events")
def t_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folders.fresh(spark, "out")
    _run_stream(spark, dedupe.first_events_streaming(streamed(spark, sf_dir)).select("source", "id"), lambda b, _: b.write.mode("append").parquet(out))
    return spark.read.schema("source string, id string").parquet(out)


@query("t_stream_ttl", """
SELECT user_id, count(*) AS told FROM (SELECT DISTINCT user_id, event_id // ((SELECT max(event_id) FROM events) // 4 + 1) AS quarter FROM events) GROUP BY user_id
""")  # fmt: skip
def t_stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is told again once its lifetime is over: the events come in four batches, an hour of the stream's clock apart.

    State goes by the watermark, which follows what has been read, so two more events between the batches move the clock.
    """
    folder, out = folders.fresh(spark, "timed"), folders.fresh(spark, "out")
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    width = e.agg(F.max("event_id")).first()[0] // 4 + 1
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds)).alias("ingest_ts")
    for i in range(4):
        quarter = e.where((F.col("event_id") >= i * width) & (F.col("event_id") < (i + 1) * width))
        quarter.select("user_id", F.timestamp_seconds(i * 3600 + F.col("event_id") % 100).alias("ingest_ts")).coalesce(1).write.mode("append").parquet(folder)
        for seconds in (1800, 1900):
            spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), at(i * 3600 + seconds)).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema("user_id long, ingest_ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    told = dedupe.first_events_streaming(rows, "180 seconds", ["user_id"])
    _run_stream(spark, told, lambda b, _: b.select("user_id").write.mode("append").parquet(out))
    return spark.read.schema("user_id long").parquet(out).where("user_id >= 0").groupBy("user_id").agg(F.count("*").alias("told"))


@query("t_stream_capacity", "SELECT event_id, user_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM user_id")
def t_stream_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for one key, an event is new unless the one before it had the same."""
    out = folders.fresh(spark, "out")
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    e = e.select("event_id", "user_id", F.timestamp_seconds("event_id").alias("ingest_ts"))
    new = dedupe.first_events_bounded(e, ttl_seconds=1e9, capacity=1, parts=1, key=["user_id"])
    _run_stream(spark, new, lambda b, _: b.select("event_id", "user_id").write.mode("append").parquet(out))
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("t_stream_fanout", f"SELECT CAST(event_id AS VARCHAR) AS id, client_id, string_agg(DISTINCT query_id, ',' ORDER BY query_id) AS query_ids FROM ({_registry_sql('mixed')}) GROUP BY event_id, client_id")
def t_stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folders.fresh(spark, "out")
    e = dedupe.first_events_streaming(streamed(spark, sf_dir)).withColumn("event", F.parse_json("raw"))
    save = lambda b, _: b.select("id", "client_id", F.array_join("query_ids", ",").alias("query_ids")).write.mode("append").parquet(out)
    pipeline.publish(e, registry("mixed"), save, folders.fresh(spark, "stream")).awaitTermination()
    return spark.read.schema("id string, client_id string, query_ids string").parquet(out)


def _standing_sql(kind: str) -> str:
    """The registry's query strings as a relation (channel, client, qid, text), and their conjunctions and terms."""
    texts = [f"('{ch}', '{client}', '{qid}', '{q.text.replace(chr(39), chr(39) * 2)}')" for (ch, client, qid), q in registry(kind).entries.items()]
    return f"""WITH q(channel, client, qid, text) AS (VALUES {", ".join(texts)}),
c AS (SELECT channel, client, qid, unnest(string_split(text, ';')) AS conj FROM q),
t AS (SELECT channel, client, qid, split_part(term, '=', 1) AS k FROM (SELECT channel, client, qid, unnest(string_split(conj, '&')) AS term FROM c) WHERE term <> ''),
p AS (SELECT channel, CASE WHEN k[1:3] = '../' THEN k[4:] WHEN k[1:1] = '/' THEN 'data' || k ELSE 'data/' || k END AS path FROM t) """


@query("r_key_counts", _standing_sql("mixed") + "SELECT channel, path, count(*) AS n FROM p GROUP BY channel, path")
def r_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry("mixed").key_counts_df(spark).withColumnRenamed("count", "n")


@query("r_active", _standing_sql("mixed") + "SELECT channel, count(*) AS n FROM c GROUP BY channel")
def r_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry("mixed").standing(spark).groupBy("channel").agg(F.count("conj_id").alias("n"))


@query("r_meta", _standing_sql("mixed") + "SELECT channel, qid AS query_id, text AS query, 'registration' AS change FROM q")
def r_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the meta channel tells of each registration."""
    m = registry("mixed").meta_events(spark).withColumn("event", F.parse_json("value"))
    get = lambda path: F.variant_get("event", f"$.{path}", "string")
    return m.select(get("data.channel").alias("channel"), get("data.queryID").alias("query_id"), get("data.query").alias("query"), F.substring_index(get("type"), ".", -1).alias("change"))


_LEFT = "c.client NOT IN ('c0', 'c3') AND c.qid NOT LIKE 'rg%' AND c.qid <> 'ne0'"


@query("r_removed", _standing_sql("mixed") + f"SELECT qid AS query_id, count(*) AS conjunctions FROM c WHERE {_LEFT} GROUP BY qid UNION ALL SELECT 'replaced', 2")
def r_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a durable registry after two clients have gone, queries have been taken back and one replaced.

    It is read anew from its folder, as after a restart.
    """
    folder, kept = folders.fresh(spark, "registry"), registry("mixed")
    r = DurableRegistry(spark, folder)
    for (channel, client, qid), q in kept.entries.items():
        r.add(channel, client, qid, q.text)
    r.disconnect("c0")
    r.disconnect("c3")
    for channel, client, qid in list(r.entries):
        if qid.startswith("rg") or qid == "ne0":
            r.remove(channel, client, qid)
    r.add("main", "c7", "replaced", "a=1")
    r.add("main", "c7", "replaced", "a=2;b=3")
    return DurableRegistry(spark, folder).standing(spark).groupBy("query_id").agg(F.count("*").alias("conjunctions"))


@query("r_size", _standing_sql("mixed") + "SELECT count(*) AS size FROM c")
def r_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cardinality(registry("mixed").standing(spark))


@query("t_meta_stream", "SELECT * FROM (VALUES ('watch', 'registration', 'q1'), ('watch', 'registration', 'q2'), ('watch', 'registration', 'w'), ('watch', 'removal', 'q1')) t(client_id, change, query_id)")
def t_meta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a durable registry reach their watcher without other events, once, over a restart of the stream.

    The client ``gone`` can't be reached, so its query is removed, which is told as well.
    """
    out, checkpoint, events = folders.fresh(spark, "out"), folders.fresh(spark, "stream"), folders.fresh(spark, "none")
    r = DurableRegistry(spark, folders.fresh(spark, "registry"))
    r.add("meta", "watch", "w", "")
    r.add("meta", "gone", "q1", "type=never;../type=~\"riverbed.\"")
    schema = "channel string, source string, id string, raw string, ingest_ts timestamp"
    table(spark, sf_dir, "events").limit(0).select(*[F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in schema.split(", ")]).write.parquet(events)

    def sink(b: DataFrame, _: int) -> list[str]:
        b.where("client_id = 'watch'").select("client_id", "raw").write.mode("append").parquet(out)
        return [x["client_id"] for x in b.where("client_id = 'gone'").select("client_id").distinct().collect()]

    for text in ("a=1", None):
        if text:
            r.add("main", "c", "q2", text)
        e = dedupe.first_events_streaming(spark.readStream.schema(schema).parquet(events)).withColumn("event", F.parse_json("raw"))
        pipeline.publish(e, r, sink, checkpoint).awaitTermination()
    event = F.parse_json("raw")
    get = lambda path: F.variant_get(event, f"$.{path}", "string")
    return spark.read.schema("client_id string, raw string").parquet(out).select("client_id", F.substring_index(get("type"), ".", -1).alias("change"), get("data.queryID").alias("query_id"))


_RAW = """concat('{"n":', user_id, chr(10), '}')"""


@query("k_sse", f"SELECT event_id, concat('event: data', chr(10), 'id: %2F%2Fevents+', event_id, chr(10), 'data: ', replace({_RAW}, chr(10), chr(10) || 'data: '), chr(10), chr(10)) AS payload FROM events")
def k_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"n":'), F.col("user_id").cast("string"), F.lit("\n}"))
    return table(spark, sf_dir, "events").select("event_id", sse.body(F.lit("//events"), F.col("event_id").cast("string"), raw).alias("payload"))


@query("k_session", f"""
SELECT client_id, 0 AS place, concat('event: connect', chr(10), chr(10)) AS payload FROM (VALUES ('c0'), ('c1'), ('quiet')) t(client_id)
UNION ALL SELECT 'c' || (event_id % 2), CAST(row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS INTEGER),
  concat('event: data', chr(10), 'id: %2F%2Fevents+', event_id, chr(10), 'data: ', user_id, chr(10), chr(10)) FROM events
""")  # fmt: skip
def k_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's output: the connect event, then its frames in the events' order; a client without events is connected too."""
    clients = spark.createDataFrame([("c0",), ("c1",), ("quiet",)], "client_id string")
    found = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("event_id") % 2).alias("client_id"), "event_id", "user_id")
    return sse.session(found, clients, ["event_id"], sse.body(F.lit("//events"), F.col("event_id").cast("string"), F.col("user_id").cast("string")))


@query("k_ping", "SELECT 'u' || user_id AS client_id, concat('event: ping', chr(10), chr(10)) AS payload FROM events GROUP BY user_id HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) >= 30000000")
def k_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients without output for half a minute before the last event."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("client_id"), F.col("ts").cast("timestamp").alias("sent_ts"))
    now = e.agg(F.max("sent_ts").alias("now__"))
    return sse.pings(e, F.lit(now.first()["now__"]))


@query("k_metrics", "SELECT 'events_total' AS name, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'active_queries', 63.0")
def k_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges of a finished stream, read back from their Prometheus text."""
    gauges = pipeline.Gauges(registry("mixed"))
    spark.streams.addListener(gauges)
    try:
        e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
        _run_stream(spark, e.select("event_id"), lambda b, _: b.write.format("noop").mode("overwrite").save())
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        for _ in range(100):  # progress comes to Python by a channel of its own
            if gauges.rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(gauges)
    lines = spark.createDataFrame([(x,) for x in gauges.text().splitlines()], "line string").where("line NOT LIKE '#%'")
    name, value = F.regexp_extract("line", r"^riverbed_(\S+) (\S+)$", 1), F.regexp_extract("line", r"^riverbed_(\S+) (\S+)$", 2)
    return lines.select(name.alias("name"), value.cast("double").alias("value")).where("name IN ('events_total', 'active_queries')")


_PATHS = (
    ("source", "string", "'//events'", None), ("id", "string", "CAST(event_id AS VARCHAR)", None), ("type", "string", "event_type", None),
    ("specversion", "string", "'1.0'", None), ("data/user_id", "number", None, "user_id"), ("data/value", "number", None, "value"), ("data/props/k", "number", None, _K),
)
_FLAT = " UNION ALL ".join(f"SELECT event_id, '{p}' AS path, '{t}' AS tag, CAST({s or 'NULL'} AS VARCHAR) AS str, CAST({n or 'NULL'} AS DOUBLE) AS num FROM events" for p, t, s, n in _PATHS)


@query("x_flatten", _FLAT)
def x_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flatten(events(spark, sf_dir), ["event_id"]).select("event_id", "path", "tag", "str", "num")


@query("x_flatten_pruned", " UNION ALL ".join(x for x in _FLAT.split(" UNION ALL ") if "'type'" in x or "props" in x))
def x_flatten_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flatten_paths(events(spark, sf_dir), ["event_id"], [("type",), ("data", "props", "k"), ("data", "gone")]).select("event_id", "path", "tag", "str", "num")


@query("x_flatten_deep", """
SELECT s_suppkey, rtrim(repeat('0/', n), '/') AS path, CASE WHEN n = 30 THEN 'number' ELSE 'array' END AS tag, CASE WHEN n = 30 THEN CAST(s_nationkey AS DOUBLE) END AS num
FROM supplier, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS n)
""")  # fmt: skip
def x_flatten_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty levels of arrays, more than one plan descends."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.parse_json(F.concat(F.lit("[" * 30), F.col("s_nationkey").cast("string"), F.lit("]" * 30))).alias("event"))
    return fl.flatten(s, ["s_suppkey"]).select("s_suppkey", "path", "tag", "num")


@query("x_compare_tags", "SELECT event_id, event_id % 4 = user_id % 4 AS same FROM events")
def x_compare_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scalars of one of four types each."""
    def some(c: Column) -> Column:
        m = c % 4
        tag = F.when(m == 0, "null").when(m == 1, "bool").when(m == 2, "number").otherwise("string")
        return F.struct(tag.alias("tag"), F.when(m == 2, c.cast("double")).alias("num"), F.when(m == 3, c.cast("string")).alias("str"), F.when(m == 1, F.lit(True)).alias("bool"))

    return table(spark, sf_dir, "events").select("event_id", fl.compare_tags(some(F.col("event_id")), some(F.col("user_id"))).alias("same"))


@query("x_radix64", "SELECT p_partkey, p_brand AS back, translate(rtrim(to_base64(encode(p_brand)), '='), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', '-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz') AS coded, rank() OVER (ORDER BY encode(p_brand)) AS place FROM part")
def x_radix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text that sorts alike, and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", fl.radix64(F.encode("p_brand", "UTF-8")).alias("coded"))
    places = p.groupBy("coded").count().select("coded", (F.sum("count").over(Window.orderBy("coded")) - F.col("count") + 1).alias("place"))  # a row for each brand
    return p.join(places, "coded").select("p_partkey", F.decode(fl.from_radix64(F.col("coded")), "UTF-8").alias("back"), "coded", "place")


@query("x_long_bytes", "SELECT o_orderkey, o_orderkey - 5000 AS back, printf('%016X', o_orderkey - 5000) AS bytes FROM orders")
def x_long_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fl.long_bytes(F.col("o_orderkey") - 5000)
    return table(spark, sf_dir, "orders").select("o_orderkey", fl.long_of(b).alias("back"), F.hex(b).alias("bytes"))


@query("x_utf8_prefix", """
WITH c AS (SELECT doc_id, unnest(range(0, 13)) AS n, text FROM documents)
SELECT doc_id, substr(text, 1, CAST(max(n) AS BIGINT)) AS head FROM c WHERE strlen(substr(text, 1, n)) <= 12 GROUP BY doc_id, text
""")  # fmt: skip
def x_utf8_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fl.utf8_prefix(F.col("text"), 12).alias("head"))


@query("x_typed_order", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY r, b NULLS FIRST, n NULLS FIRST, s NULLS FIRST) AS BIGINT) AS place FROM (
  SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END r, CASE WHEN event_id % 4 = 1 THEN user_id % 2 = 0 END b,
    CASE WHEN event_id % 4 = 2 THEN value END n, CASE WHEN event_id % 4 = 3 THEN event_type END s FROM events)
""")  # fmt: skip
def x_typed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """null < boolean < number < string, and each type in its own order; place is how many of a user's sort up to here."""
    m = F.col("event_id") % 4
    tag = F.when(m == 0, "null").when(m == 1, "bool").when(m == 2, "number").otherwise("string")
    s = F.struct(tag.alias("tag"), F.when(m == 2, F.col("value")).alias("num"), F.when(m == 3, F.col("event_type")).alias("str"), F.when(m == 1, F.col("user_id") % 2 == 0).alias("bool"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", fl.order_key(s).alias("k"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("k")).alias("place"))


@query("x_url", "SELECT p_partkey, replace(replace(p_brand || ' é/' || p_size, ' ', '+'), 'é/', '%C3%A9%2F') AS coded FROM (SELECT p_partkey, replace(p_brand, '#', '%23') AS p_brand, p_size FROM part)")
def x_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form encoding and back: the id of a frame, and the name of a channel."""
    name = F.concat("p_brand", F.lit(" é/"), F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.url_encode(name).alias("coded"))
    return p.where(envelope.channel_name(F.col("coded")) == F.col("name")).select("p_partkey", "coded")


#: What is wrong with each of the requests below, by event_id modulo their number, and the status; 0 to 2 are fine.
WRONG = (
    (None, 202), (None, 202), (None, 202), ("invalid-data-field", 400), ("missing-event-id", 400), ("invalid-content-type", 400), ("missing-event-source", 400), ("conflicting-data-type-headers", 400),
    ("missing-content-type", 400), ("invalid-channel", 400), ("disallowed-meta-channel-send", 403), ("invalid-json-body", 400), ("invalid-json-body", 400), ("body-too-large", 413), ("partial-content", 400),
    ("missing-content-length", 400), ("invalid-content-length", 400), ("body-timeout", 408), ("missing-event-source", 400), ("missing-event-id", 400),
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all modes out of the events table, some of them wrong in each way that there is."""
    e = table(spark, sf_dir, "events").withColumn("m", F.col("event_id") % len(WRONG))
    m, eid = F.col("m"), F.col("event_id").cast("string")
    data = F.to_json(F.struct("user_id", "value"))
    fields = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    inner = F.struct("user_id", "value")
    whole = fields(source=F.lit("//events"), id=eid, data=inner)
    odd = F.when(F.col("user_id") % 2 == 0, whole).otherwise('{"source":"a","id":1,"data":{}}')
    structured = m.isin(1, 3, 12, 18, 19)
    kind = F.when(m == 8, None).when(m == 5, "text/plain").when(m == 2, envelope.BATCH).when(structured, envelope.STRUCTURED + "; charset=utf-8").otherwise(envelope.HEADER)
    body = (
        F.when(m == 1, whole).when(m == 2, F.concat(F.lit("["), whole, F.lit(","), odd, F.lit("]"))).when(m == 3, '{"source":"s","id":"i","data":[1]}').when(m == 11, F.concat(data, F.lit("}")))
        .when(m == 12, F.concat(F.lit("["), whole, F.lit("]"))).when(m == 13, F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), 400), F.lit('"}')))
        .when(m == 18, fields(source=F.lit(None).cast("string"), id=eid, data=inner)).when(m == 19, fields(source=F.lit("s"), id=F.col("event_id"), data=inner)).otherwise(data)
    )
    length = F.when(m == 14, F.octet_length(body) + 1).otherwise(F.octet_length(body)).cast("string")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    headers = F.array_compact(F.array(
        F.when(m != 15, pair("Content-Length", F.when(m == 16, F.lit("12 bytes")).otherwise(length))),
        F.when(~structured & (m != 6), pair("CE-Source", F.lit("//events"))), F.when(m == 0, pair("ce-source", F.lit("another"))),
        F.when(~structured & ~m.isin(4, 6), pair("ce-id", eid)), F.when(m == 7, pair("ce-datacontenttype", F.lit("text/xml"))),
    ))
    channel = F.when(m == 9, "").when(m == 10, "meta").otherwise("main")
    return e.select("event_id", channel.alias("channel"), kind.alias("content_type"), F.map_from_entries(headers).alias("headers"), body.alias("body"), (m == 17).alias("late"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.judged(requests(spark, sf_dir), max_body=300, counted=True, timed_out=F.col("late"))


_WRONG_SQL = "(VALUES " + ", ".join(f"({i}, {repr(c) if c else 'NULL'}, {st})" for i, (c, st) in enumerate(WRONG)) + ") w(m, code, status)"


@query("s_ingest", f"""
SELECT event_id, CAST(-1 AS INTEGER) AS "offset", code, status FROM events JOIN {_WRONG_SQL} ON event_id % {len(WRONG)} = m WHERE m <> 2
UNION ALL SELECT event_id, o, CASE WHEN user_id % 2 = 0 THEN NULL WHEN o = 0 THEN 'batch-refused' ELSE 'missing-event-id' END, CASE WHEN user_id % 2 = 0 THEN 202 ELSE 400 END
FROM events, (VALUES (0), (1)) t(o) WHERE event_id % {len(WRONG)} = 2
""")  # fmt: skip
def s_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("event_id", F.coalesce("offset", F.lit(-1)).alias("offset"), "code", "status")


@query("s_responses", f"""
SELECT event_id, CASE WHEN m = 2 AND user_id % 2 = 1 THEN 400 ELSE status END AS status,
  '{{"code":"' || CASE WHEN m = 2 AND user_id % 2 = 1 THEN 'missing-event-id' ELSE coalesce(code, 'accepted') END || '"}}' AS body
FROM events JOIN {_WRONG_SQL} ON event_id % {len(WRONG)} = m
""")  # fmt: skip
def s_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each request."""
    return envelope.responses(_judged(spark, sf_dir), ["event_id"])


@query("s_admission", """
WITH o AS (SELECT event_id, event_type, 1 + user_id % 3 AS n, coalesce(sum(1 + user_id % 3) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM events)
SELECT event_id, CASE WHEN ahead >= 150 THEN 'exceeded-outstanding-event-limit' END AS code, CASE WHEN ahead >= 150 THEN 429 ELSE 202 END AS status FROM o
""")  # fmt: skip
def s_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one to three events; each channel takes them until 150 are under way."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), (1 + F.col("user_id") % 3).alias("n"))
    return envelope.admission(e, "event_id", F.col("n"), 150).select("event_id", "code", "status")


@query("s_accepted", """
SELECT event_id, '//events' AS source, CAST(event_id AS VARCHAR) AS id, user_id FROM events WHERE event_id % 20 IN (0, 1)
UNION ALL SELECT event_id, '//events', CAST(event_id AS VARCHAR), user_id FROM events, (VALUES (0), (1)) t(o) WHERE event_id % 20 = 2 AND user_id % 2 = 0
""")  # fmt: skip
def s_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = envelope.accepted(_judged(spark, sf_dir))
    return good.select("event_id", "source", "id", F.variant_get("event", "$.data.user_id", "bigint").alias("user_id"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
