"""Matches as server-sent event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flatten import iso_now


def event_id(source: Column, id_: Column) -> Column:
    return F.url_encode(F.concat_ws(" ", source, id_))


def frame(source: Column, id_: Column, raw: Column, stamp: Column | None = None) -> Column:
    """The ``data`` event of one match; line ends in the payload continue it."""
    head = F.concat(F.lit(': {"timestamp":"'), stamp if stamp is not None else iso_now(), F.lit('"}\n'))
    return F.concat(head, body(source, id_, raw))


def body(source: Column, id_: Column, raw: Column) -> Column:
    """The frame without the comment that tells the time."""
    return F.concat(F.lit("event: data\nid: "), event_id(source, id_), F.lit("\ndata: "), F.replace(raw, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


CONNECT = "event: connect\n\n"
PING = "event: ping\n\n"
#: Seconds without output after which a client gets a ping.
IDLE = 30


def session(found: DataFrame, clients: DataFrame, order: list[str], payload: Column | None = None) -> DataFrame:
    """(client_id, place, payload): what each of ``clients`` gets, the connect event at place 0 and then its frames in ``order``."""
    payload = frame(F.col("source"), F.col("id"), F.col("raw")) if payload is None else payload
    place = F.row_number().over(Window.partitionBy("client_id").orderBy(*order))
    hello = clients.select("client_id", F.lit(0).alias("place"), F.lit(CONNECT).alias("payload"))
    return hello.unionByName(found.select("client_id", place.alias("place"), payload.alias("payload")))


def pings(last: DataFrame, now: Column, idle: int = IDLE, sent: str = "sent_ts") -> DataFrame:
    """(client_id, payload): a ping for each client whose last output, in ``last``, is ``idle`` seconds ago or more."""
    due = F.unix_micros(now) - F.unix_micros(F.max(sent)) >= idle * 1_000_000
    return last.groupBy("client_id").agg(due.alias("due")).where("due").select("client_id", F.lit(PING).alias("payload"))


def payloads(found: DataFrame) -> DataFrame:
    """(client_id, source, id, query_ids, payload) of matches per client with their raw events."""
    return found.select("client_id", "source", "id", "query_ids", frame(F.col("source"), F.col("id"), F.col("raw")).alias("payload"))


def connect(clients: DataFrame, path: str) -> None:
    """Opens the output of clients with the connect event; called once for each, before its first frames."""
    clients.select("client_id", F.lit(CONNECT.removesuffix("\n")).alias("value")).write.mode("append").partitionBy("client_id").text(path)


def write_frames(found: DataFrame, path: str) -> None:
    """Appends frames as text, a folder for each client; a batch of a stream is one call."""
    payloads(found).select("client_id", F.col("payload").alias("value")).write.mode("append").partitionBy("client_id").text(path)
