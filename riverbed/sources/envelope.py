"""Requests to events: header mode, structured mode and batches, with the reasons for refusal.

Requests are rows (channel, content_type, headers map<string,string>, body string). What passes is
(channel, source, id, ingest_ts, event variant, raw string); what doesn't is kept with its code and, in a batch, offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import META

MAX_BODY = 10 * 1024 * 1024
OVERLOAD = "exceeded-outstanding-event-limit"
HEADER, STRUCTURED, BATCH = "application/json", "application/cloudevents+json", "application/cloudevents-batch+json"


def media_type(content_type: Column) -> Column:
    return F.substring_index(content_type, ";", 1)


def channel_name(encoded: Column) -> Column:
    """A percent-decoded channel; NULL if it is empty or not decodable."""
    return F.nullif(F.try_url_decode(encoded), F.lit(""))


def folded(headers: Column) -> Column:
    """Headers by lower-cased name. Of names that differ in case alone, the first in byte order counts; NULL is no headers."""

    def first_of_each(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))

    lower = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.transform(F.array(lower), first_of_each)[0]


def attributes(headers: Column, content_type: Column) -> Column:
    """``ce-*`` headers as string attributes, names lower-cased and bare; datacontenttype from the content type."""
    return _attributes(folded(headers), content_type)


def _attributes(names: Column, content_type: Column) -> Column:
    ours = F.transform_keys(F.map_filter(names, lambda k, _: F.startswith(k, F.lit("ce-"))), lambda k, _: F.substring(k, 4, 1 << 20))
    rest = F.map_filter(ours, lambda k, _: k != "datacontenttype")
    return F.map_concat(rest, F.create_map(F.lit("datacontenttype"), content_type))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as VARIANT; NULL otherwise.

    The parser ignores what follows a value. Within brackets only one of theirs may follow, and within braces only one of
    those, so a text that is fine in both has nothing behind its value.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    only = F.try_variant_get(listed, "$[1]", "variant").isNull() & named.isNotNull()
    return F.when(only, F.try_variant_get(listed, "$[0]", "variant"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _envelope_code(v: Column) -> Column:
    return F.when(~is_text(_field(v, "source")), "missing-event-source").when(~is_text(_field(v, "id")), "missing-event-id").when(~is_object(_field(v, "data")), "invalid-data-field")


def _body_code(headers: Column, max_body: int, counted: bool, timed_out: Column | None) -> Column:
    """What is wrong with a body as bytes. ``counted``: it needs a Content-Length, which holds; else its own size is looked at."""
    size, late = F.octet_length("body"), F.lit(False) if timed_out is None else F.coalesce(timed_out, F.lit(False))
    if not counted:
        return F.when(late, "body-timeout").when(size > max_body, "body-too-large")
    told = F.element_at(headers, "content-length")
    n = told.try_cast("int")
    return (
        F.when(told.isNull(), "missing-content-length").when(n.isNull() | (n <= 0), "invalid-content-length").when(n > max_body, "body-too-large")
        .when(late, "body-timeout").when(F.coalesce(size, F.lit(0)) != n, "partial-content")
    )


def judged(requests: DataFrame, max_body: int = MAX_BODY, counted: bool = False, timed_out: Column | None = None) -> DataFrame:
    """Every event of every request with ``code`` (NULL if it is fine), ``status`` and ``offset`` in its batch.

    One bad event refuses its whole batch: the others carry the code ``batch-refused``. ``counted`` holds bodies against
    their Content-Length header; ``timed_out`` says which of them didn't come in time.
    """
    kind = media_type(F.col("content_type"))
    r = requests.withColumn("names", folded(F.col("headers")))
    r = r.withColumns({"kind": kind, "attr": _attributes(F.col("names"), F.col("content_type")), "parsed": whole_json(F.col("body"))})
    bad_json = F.col("parsed").isNull()
    bad_body = _body_code(F.col("names"), max_body, counted, timed_out)
    conflict = F.element_at("names", "ce-datacontenttype")
    code = (
        F.when(F.col("channel").isNull() | (F.col("channel") == ""), "invalid-channel")
        .when(F.col("channel") == META, "disallowed-meta-channel-send")
        .when(F.col("content_type").isNull(), "missing-content-type")
        .when(~kind.isin(HEADER, STRUCTURED, BATCH), "invalid-content-type")
        .when((kind == HEADER) & F.element_at("attr", "source").isNull(), "missing-event-source")
        .when((kind == HEADER) & F.element_at("attr", "id").isNull(), "missing-event-id")
        .when((kind == HEADER) & (conflict != F.col("content_type")), "conflicting-data-type-headers")
        .when(bad_body.isNotNull(), bad_body)
        .when(bad_json, "invalid-json-body")
        .when((kind == BATCH) & ~F.startswith(F.schema_of_variant("parsed"), F.lit("ARRAY")), "invalid-json-body")
        .when((kind != BATCH) & ~is_object(F.col("parsed")), "invalid-json-body")
    )
    r = r.withColumn("code0", code)
    # The envelope around a header-mode body is put together as text, attributes first.
    attrs = F.to_json("attr")
    raw = F.when(kind == HEADER, F.concat(F.substring(attrs, F.lit(1), F.length(attrs) - 1), F.lit(',"data":'), F.col("body"), F.lit("}"))).otherwise(F.col("body"))
    one = F.array(F.try_parse_json(raw))
    events = F.when(F.col("code0").isNotNull(), F.array(F.lit(None).cast("variant"))).when(kind == BATCH, F.try_variant_get("parsed", "$", "array<variant>")).otherwise(one)
    r = r.withColumn("codes", F.transform(events, lambda v: F.coalesce(F.col("code0"), _envelope_code(v)))).withColumn("events", events)
    refused = F.exists("codes", lambda c: c.isNotNull())
    keep = [c for c in requests.columns if c not in ("headers", "body", "content_type")]
    flat = r.select(*keep, "kind", refused.alias("refused"), "codes", F.posexplode_outer("events").alias("offset", "event"))
    own = F.get("codes", F.col("offset"))
    final = F.coalesce(own, F.when(F.col("refused"), "batch-refused"))
    status = F.when(final == "disallowed-meta-channel-send", 403).when(final == "body-too-large", 413).when(final == "body-timeout", 408).when(final.isNotNull(), 400).otherwise(202)
    return flat.select(*keep, F.when(F.col("kind") == BATCH, F.col("offset")).alias("offset"), final.alias("code"), status.alias("status"), "event")


def accepted(events: DataFrame) -> DataFrame:
    """The good ones as (.., source, id, event, raw)."""
    e = events.where("code IS NULL AND event IS NOT NULL")
    keep = [c for c in e.columns if c not in ("code", "status", "event", "offset")]
    return e.select(*keep, "offset", F.variant_get("event", "$.source", "string").alias("source"), F.variant_get("event", "$.id", "string").alias("id"), "event", F.to_json("event").alias("raw"))


def refused(events: DataFrame) -> DataFrame:
    return events.where("code IS NOT NULL").drop("event")


def responses(events: DataFrame, key: list[str]) -> DataFrame:
    """(key.., status, body): the answer to each request, with the code of its first bad event or ``accepted``."""
    own = F.when(F.col("code") != "batch-refused", F.col("code"))
    first = F.min_by(own, F.when(own.isNotNull(), F.coalesce("offset", F.lit(0))))
    answers = events.groupBy(*key).agg(F.max("status").alias("status"), first.alias("code__"))
    return answers.select(*key, "status", F.to_json(F.struct(F.coalesce("code__", F.lit("accepted")).alias("code"))).alias("body"))


def structured(lines: DataFrame, channel: Column, value: str = "value") -> DataFrame:
    """Lines of structured events, as a text or Kafka source gives them, to requests."""
    rest = [c for c in lines.columns if c != value]
    return lines.select(*rest, channel.alias("channel"), F.lit(STRUCTURED).alias("content_type"), F.create_map().cast("map<string,string>").alias("headers"), F.col(value).cast("string").alias("body"))


def table_events(df: DataFrame, channel: str, source: str, id_col: str, type_col: str, data: dict[str, Column]) -> DataFrame:
    """A table as events: (channel, source, id, event, raw), with ``data`` as the payload."""
    body = F.to_json(F.struct(F.lit(source).alias("source"), F.col(id_col).cast("string").alias("id"), F.col(type_col).alias("type"), F.lit("1.0").alias("specversion"), F.struct(*[c.alias(k) for k, c in data.items()]).alias("data")), {"ignoreNullFields": "false"})
    out = df.withColumns({"channel": F.lit(channel), "source": F.lit(source), "id": F.col(id_col).cast("string"), "raw": body})
    return out.withColumn("event", F.parse_json("raw"))


def admitted(outstanding: int, incoming: int, routers: int, limit: int) -> dict | None:
    """Back-pressure for push sources: None, or the 429 body when too much is under way already."""
    if outstanding >= limit:
        return {"code": OVERLOAD, "status": 429, "count": outstanding, "limit": limit, "refused": incoming * routers}
    return None


def admission(requests: DataFrame, order: str, size: Column, limit: int, channel: str = "channel") -> DataFrame:
    """Requests of a batch with ``outstanding`` events ahead of each on its channel, in ``order``, and ``code`` and ``status``.

    A request is refused, whole, once what was taken before it has reached ``limit``; a refused one adds nothing.
    """
    ahead = F.coalesce(F.sum(size).over(Window.partitionBy(channel).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = requests.withColumn("outstanding", ahead)
    full = F.col("outstanding") >= limit
    # Sizes aren't negative, so all that comes after a refused request is refused as well, and the sum ahead of it is what was taken.
    return r.withColumns({"code": F.when(full, OVERLOAD), "status": F.when(full, 429).otherwise(202)})
