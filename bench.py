"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riverbed import Registry, catalog, match_by_filter, match_by_join
from riverbed.functions.resolve import TypedEvent

HEADLINE = ("f_dnf", "f_json_and", "m_fanout_mixed", "m_fanout_variant", "m_collect_queries", "m_interval_stab_binned", "m_prefix_of", "o_le_desc", "t_dedupe", "x_flatten", "s_ingest")


def selective(n: int) -> Registry:
    """n queries that few events match: an equality each, every other one with a range."""
    r = Registry()
    for i in range(n):
        r.add("main", f"c{i % 50}", f"q{i}", f"user_id={i * 7 % 100_000}" + ("&value=>=20" if i % 2 else ""))
    return r


def ranges(n: int) -> Registry:
    """n narrow ranges."""
    r = Registry()
    for i in range(n):
        r.add("main", f"c{i % 50}", f"q{i}", f"value=>={i * 100 / n}&value=<{i * 100 / n + 0.02}")
    return r


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, f) -> None:
        f().write.format("noop").mode("overwrite").save()  # compiles and warms
        t = time.time()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, sf))
    e = catalog.table(spark, sf, "events").withColumn("channel", F.lit("main"))
    n_events = e.count()
    event = TypedEvent(e, catalog.EVENT_COLUMNS)
    rates = {}
    for n in (10, 100, 1000, 10_000):
        r = selective(n)
        timed(f"join_{n}", lambda r=r: match_by_join(e, r, event, key=["event_id"]))
        rates[f"join_{n}"] = round(n_events / took[f"join_{n}"])
        if n <= 100:
            timed(f"scan_{n}", lambda r=r: match_by_filter(e, r, event))
            rates[f"scan_{n}"] = round(n_events / took[f"scan_{n}"])
    timed("ranges_10000", lambda r=ranges(10_000): match_by_join(e, r, event, key=["event_id"]))
    rates["ranges_10000"] = round(n_events / took["ranges_10000"])
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "events_per_sec": rates, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
