"""Source, validation, dedupe, fan-out and sink as one streaming query."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.resolve import VariantEvent
from ..operators.dedupe import KEY, TTL, first_events_streaming
from ..operators.match import match_by_filter, match_by_join, per_client
from ..plans.compile import Event
from ..plans.registry import META, DurableRegistry, Registry
from ..sources.envelope import accepted, judged

#: Conjunctions up to which a batch is matched in one projection; with 10 it is twice as fast as the join, with 100 a third.
FEW = 25


def fan_out(batch: DataFrame, registry: Registry, event: Event | None = None, key: list[str] | None = None) -> DataFrame:
    """Matches of a batch by whichever way suits the size of the registry."""
    event = event or VariantEvent("event")
    if registry.active() <= FEW:
        return match_by_filter(batch, registry, event)
    return match_by_join(batch, registry, event, key=key or KEY)


def ingest(requests: DataFrame, ttl: str = TTL) -> DataFrame:
    """A stream of requests (with ingest_ts) to accepted events, each key once within its lifetime."""
    return first_events_streaming(accepted(judged(requests)), ttl)


def publish(events: DataFrame, registry: Registry, sink: Callable[[DataFrame, int], Iterable[str] | None], checkpoint: str, event: Event | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream. Each batch sees the registry as it is then, so queries come and go while it runs.

    ``sink`` gets (channel, source, id, client_id, query_ids, raw) and the batch number; clients that it returns couldn't be
    reached, and their queries are removed. Registry changes are events of the meta channel: those of a durable registry are
    a stream of their own, told without other traffic and once, restarts included; others come with the next batch.
    """
    told = {"n": 0}
    cols = ["channel", "source", "id", "raw", "event"]
    durable = isinstance(registry, DurableRegistry)
    if durable:
        events = events.select(*cols).unionByName(registry.changes())

    def each(batch: DataFrame, number: int) -> None:
        if durable:
            registry.refresh()
        snapshot = Registry(registry.max_terms, registry.max_value_bytes, registry.source, dict(registry.entries), list(registry.log))
        rows = batch.select(*cols)
        if not durable and len(snapshot.log) > told["n"]:
            meta = snapshot.meta_events(batch.sparkSession, told["n"]).withColumn("event", F.parse_json("value"))
            rows = rows.unionByName(meta.select("channel", F.variant_get("event", "$.source", "string").alias("source"), F.variant_get("event", "$.id", "string").alias("id"), F.col("value").alias("raw"), "event"))
        found = fan_out(rows, snapshot, event).drop("event")
        for client in sink(per_client(found, ["channel", "source", "id", "raw"]), number) or ():
            registry.disconnect(client)
        told["n"] = len(snapshot.log)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stop(query: StreamingQuery, registry: Registry, clients: Iterable[str] = ()) -> None:
    """Ends a stream and unregisters the clients that it served."""
    query.stop()
    for client in clients:
        registry.disconnect(client)


def without_meta(events: DataFrame) -> DataFrame:
    """Events that producers may send."""
    return events.where(F.col("channel") != META)


class Gauges(StreamingQueryListener):
    """Counts of a running stream, and their Prometheus text."""

    def __init__(self, registry: Registry):
        self.registry, self.rows, self.state_rows, self.batch_ms, self.behind = registry, 0, 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.state_rows = sum(s.numRowsTotal for s in p.stateOperators)
        self.batch_ms = p.batchDuration
        # Sources with offsets, such as Kafka, tell how far behind their end the stream is.
        self.behind = sum(int(float((s.metrics or {}).get("maxOffsetsBehindLatest", 0))) for s in p.sources)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def text(self) -> str:
        values = {"events_total": self.rows, "idempotency_keys": self.state_rows, "batch_milliseconds": self.batch_ms, "outstanding_events": self.behind, "active_queries": self.registry.active()}
        return "".join(f"# TYPE riverbed_{k} gauge\nriverbed_{k} {v}\n" for k, v in values.items())


def backoff(attempt: int, jitter: float, base_ms: float = 10, power: float = 2, most_ms: float = 10_000) -> float:
    """Milliseconds to wait before a retry: polynomial in the attempt, spread by ``jitter`` in [0, 1)."""
    return min(most_ms, base_ms * (attempt + 1) ** power) * (0.5 + jitter / 2)
