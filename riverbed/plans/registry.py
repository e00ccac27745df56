"""Standing queries: who asks what on which channel."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .paths import Path, path_text
from .query import MAX_TERMS, Conjunction, Literal, Prefix, Query, Range, parse

META = "meta"

TERM = "struct<kind:string,path:string,tag:string,num:double,str:string,bool:boolean,low:boolean,high:boolean,num_hi:double,str_hi:string,bool_hi:boolean>"
#: ``anchor`` is how a conjunction is looked up: eq, prefix, range or all; ``key`` is what eq and prefix look up.
STANDING = f"channel string, client_id string, query_id string, conj_id long, several boolean, anchor string, path string, key string, terms array<{TERM}>"


def _sides(lit: Literal | None) -> tuple:
    v = lit.value if lit else None
    t = lit.tag if lit else None
    return (float(v) if t == "number" else None, v if t == "string" else None, v if t == "bool" else None)


def _row(kind: str, path: Path, lit: Literal | None, hi: Literal | None = None, tag: str | None = None) -> tuple:
    return (kind, path_text(path), tag or (lit or hi).tag, *_sides(lit), lit is not None, hi is not None, *_sides(hi))


def lookup_key(lit: Literal) -> str:
    """A literal as the text that an event's scalar gets, see ``match.scalar_key``."""
    if lit.tag == "number":
        return "n" + repr(lit.value + 0.0)
    return {"null": "z", "bool": "b" + str(lit.value).lower(), "string": f"s{lit.value}"}[lit.tag]


@dataclass
class Registry:
    """Queries by (channel, client, query). A query of which any part is wrong is refused as a whole."""

    max_terms: int = MAX_TERMS
    max_value_bytes: int | None = None
    source: str = "//riverbed"
    entries: dict[tuple[str, str, str], Query] = field(default_factory=dict)
    #: Registrations and removals, as events of the meta channel.
    log: list[dict] = field(default_factory=list)

    def add(self, channel: str, client_id: str, query_id: str, text: str) -> Query:
        """Registers or replaces; the change is on the meta channel before it counts."""
        if not channel:
            raise QueryError("invalid-channel")
        query = parse(text, self.max_terms, self.max_value_bytes)
        self._tell("registration", channel, client_id, query_id, text)
        self.entries[channel, client_id, query_id] = query
        return query

    def remove(self, channel: str, client_id: str, query_id: str | None = None) -> int:
        """Removes one query, or all of a client's; how many there were."""
        gone = [k for k in self.entries if k[:2] == (channel, client_id) and query_id in (None, k[2])]
        for k in gone:
            self._tell("removal", *k, self.entries[k].text)
            del self.entries[k]
        return len(gone)

    def disconnect(self, client_id: str) -> int:
        """Removes all queries of a client that has gone, on every channel."""
        return sum(self.remove(channel, client_id) for channel in {k[0] for k in self.entries if k[1] == client_id})

    def _tell(self, what: str, channel: str, client_id: str, query_id: str, text: str) -> None:
        n = self.changed
        self._keep({"source": self.source, "id": f"{query_id}-{n}", "specversion": "1.0", "type": f"riverbed.query.{what}", "data": {"channel": channel, "clientID": client_id, "queryID": query_id, "query": text}})

    def _keep(self, change: dict) -> None:
        self.log.append(change)

    def meta_events(self, spark: SparkSession, since: int = 0) -> DataFrame:
        """(channel, value) rows of the changes after ``since``, to be united with the events of other channels."""
        rows = [(META, json.dumps(e)) for e in self.log[since:]]
        return spark.createDataFrame(rows, "channel string, value string")

    @property
    def changed(self) -> int:
        """How many changes there have been."""
        return len(self.log)

    def active(self) -> int:
        """Each conjunction counts as one."""
        return sum(len(q.conjunctions) for q in self.entries.values())

    def paths(self, channel: str | None = None) -> list[Path]:
        """Every path that a query looks at: what has to be read of an event."""
        return sorted({p for k, q in self.entries.items() if channel in (None, k[0]) for c in q.conjunctions for p in c.paths})

    def key_counts(self, channel: str) -> Counter[str]:
        """How often each path is looked at by the live queries of a channel."""
        return Counter(path_text(p) for k, q in self.entries.items() if k[0] == channel for c in q.conjunctions for p in c.paths)

    def key_counts_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k[0], path_text(p)) for k, q in self.entries.items() for c in q.conjunctions for p in c.paths]
        return spark.createDataFrame(rows, "channel string, path string").groupBy("channel", "path").count()

    def key_tree(self, channel: str) -> dict:
        """The counts as nested objects, one level for each segment."""
        root: dict = {}
        for k, q in self.entries.items():
            for p in (p for c in q.conjunctions for p in c.paths if k[0] == channel):
                node = root
                for segment in p:
                    node = node.setdefault("subKeys", {}).setdefault(segment, {})
                node["references"] = node.get("references", 0) + 1
        return root

    def _anchor(self, c: Conjunction, distinct: Counter[Path]) -> tuple[str, str | None, str | None]:
        """Equality on the path with the most values in the registry, else prefix, else range, else all."""
        if c.equal:
            path = max(c.equal, key=lambda p: (distinct[p], p))
            return "eq", path_text(path), lookup_key(c.equal[path])
        if isinstance(c.inequality, Prefix):
            return "prefix", path_text(c.inequality.path), c.inequality.text
        if isinstance(c.inequality, Range):
            return "range", path_text(c.inequality.path), None
        return "all", None, None

    def rows(self) -> list[tuple]:
        seen = {(p, v) for q in self.entries.values() for c in q.conjunctions for p, v in c.equal.items()}
        distinct = Counter(p for p, _ in seen)
        out = []
        for (channel, client, qid), q in self.entries.items():
            for c in q.conjunctions:
                terms = [_row("eq", p, v) for p, v in c.equal.items()]
                if isinstance(c.inequality, Range):
                    terms.append(_row("range", c.inequality.path, c.inequality.low, c.inequality.high))
                elif isinstance(c.inequality, Prefix):
                    terms.append(_row("prefix", c.inequality.path, Literal("string", c.inequality.text)))
                terms += [_row("has", p, v) for p, v in c.contains] + [_row("ne", p, v) for p, v in c.unequal]
                out.append((channel, client, qid, len(out), len(q.conjunctions) > 1, *self._anchor(c, distinct), terms))
        return out

    def standing(self, spark: SparkSession) -> DataFrame:
        """The registry as a table, one row for each conjunction."""
        return spark.createDataFrame(self.rows(), STANDING)


#: Changes after which a durable registry writes down what is registered, so a restart reads no more of them than that.
SNAPSHOT = 1000


class DurableRegistry(Registry):
    """A registry whose changes are files of a shared folder, one for each: what is registered outlives the process.

    A change counts once its file is there. The folder is a stream of the meta channel's events, so watchers hear of changes
    whether other events come or not, and each of them once, as the stream's checkpoint says. One process changes a folder
    at a time; others see its changes with :meth:`refresh`.
    """

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 5, wait: float = 0.05, **options):
        super().__init__(**options)
        self.spark, self.folder, self.attempts, self.wait = spark, folder.rstrip("/"), attempts, wait
        #: Changes before those of ``log``, which a snapshot has stood for.
        self.before = 0
        self._restore()
        self.refresh()

    @property
    def changed(self) -> int:
        return self.before + len(self.log)

    def _restore(self) -> None:
        fs = self._fs()
        taken = sorted(x.getPath().getName() for x in fs.listStatus(self._path(".")) if x.getPath().getName().startswith("_snapshot-"))
        if taken:
            text = self._read(taken[-1])
            self.before = int(taken[-1].removeprefix("_snapshot-"))
            self.entries = {(e[0], e[1], e[2]): parse(e[3], self.max_terms, self.max_value_bytes) for e in json.loads(text)}
            for name in taken[:-1]:
                fs.delete(self._path(name), False)

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(path)
        return fs

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def refresh(self) -> int:
        """Takes in changes that aren't known yet, in their order; how many there were."""
        fs, had = self._fs(), len(self.log)
        while fs.exists(self._path(f"{self.changed:012d}.json")):
            change = json.loads(self._read(f"{self.changed:012d}.json"))
            self.log.append(change)
            d = change["data"]
            key = (d["channel"], d["clientID"], d["queryID"])
            if change["type"].endswith(".removal"):
                self.entries.pop(key, None)
            else:
                self.entries[key] = parse(d["query"], self.max_terms, self.max_value_bytes)
        return len(self.log) - had

    def _keep(self, change: dict) -> None:
        for attempt in range(self.attempts):
            try:
                self._write(f"{self.changed:012d}.json", json.dumps(change))
                break
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * (attempt + 1) ** 2)
        # What is registered now is without this change, so the snapshot is of all the changes before it.
        if self.changed % SNAPSHOT == 0 and self.changed:
            self._write(f"_snapshot-{self.changed:012d}", json.dumps([[*k, q.text] for k, q in self.entries.items()]))
        super()._keep(change)

    def _write(self, name: str, text: str) -> None:
        """Under another name first, so nobody reads half a change."""
        fs, tmp = self._fs(), self._path(f"_{uuid.uuid4().hex}")
        if fs.exists(self._path(name)):
            raise OSError(f"{name} is another process's change; refresh first")
        out = fs.create(tmp)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(tmp, self._path(name)):
            raise OSError(f"{name} can't be written")

    def changes(self) -> DataFrame:
        """The folder as a stream of (channel, source, id, raw, event)."""
        lines = self.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").text(self.folder)
        event = F.parse_json("value")
        return lines.select(F.lit(META).alias("channel"), F.variant_get(event, "$.source", "string").alias("source"), F.variant_get(event, "$.id", "string").alias("id"), F.col("value").alias("raw"), event.alias("event"))
