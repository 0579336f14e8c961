"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local threads).
"""

from __future__ import annotations

import json
import os
import time

from sluice.plans import pushdown
from sluice.plans.catalog import CATALOG, GAP, HOP
from sluice.session import build_session, shared_folder
from sluice.sources import mapped
from sluice.streaming.catalog import CATALOG as STREAM_CATALOG

QUERIES = [
    "q0", "q1", "q2", "q2_modulo", "q3", "q3_incremental", "q5", "q5_counts", "q8", "q8_pairs", "q11",
    "q11_composite", "q11_early", "scan_json", "scan_savings", "keygroup_string", "deal_out", "route_rules",
    "wordcount_all", "wordcount_running", "irate", "role_usage", "variant_compare",
]
RUNS = 2

# Queries over stored JSON records, with and without pushdown.
OVER_TOPICS = {"q1": {}, "q2": {}, "q3": {}, "q5": HOP, "q11": {"gap": GAP}}


# Streams over all stored rows, from the first micro-batch to the end of the input; the first one also warms up.
STREAMS = [
    "stream_q1", "stream_q3", "stream_q5", "stream_q8", "stream_q11", "stream_q11_early", "stream_q3_incremental"]


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(make) -> float:
    return round(min(timed(make) for _ in range(RUNS)), 3)


def stored_records(spark, folder) -> dict:
    """The topics as record files, so that only the scan is timed."""
    path = shared_folder(spark, "bench-topics")
    made = {
        "bid": mapped.bid_records(spark, folder), "auction": mapped.auction_records(spark, folder),
        "person": mapped.person_records(spark, folder),
    }
    for topic, records in made.items():
        records.write.parquet(f"{path}/{topic}")
    return {topic: spark.read.parquet(f"{path}/{topic}") for topic in made}


def pushdown_seconds(spark, folder) -> dict:
    records = stored_records(spark, folder)
    report = {}
    for name, parameters in OVER_TOPICS.items():
        for pushed in (True, False):
            label = f"{'pushed' if pushed else 'unpushed'}_{name}"
            report[label] = best(lambda: pushdown.over_topics(
                name, records, pushdown=pushed, on_malformed="drop", **parameters))
    return report


def bytes_saved(spark, folder) -> dict:
    records = {
        "bid": mapped.bid_records(spark, folder), "auction": mapped.auction_records(spark, folder),
        "person": mapped.person_records(spark, folder),
    }
    return {f"{r.query}/{r.topic}": round(r.bytes_saved / r.bytes_read, 3) for r in pushdown.savings(records).collect()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["q0"](spark, folder).count()  # start-up
    seconds = {}
    for name in QUERIES:
        seconds[name] = best(lambda: CATALOG[name](spark, folder))
    over_topics, saved = pushdown_seconds(spark, folder), bytes_saved(spark, folder)
    streams = {name: round(timed(lambda: STREAM_CATALOG[name](spark, folder)), 3) for name in STREAMS}
    rows = CATALOG["q0"](spark, folder).count()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(folder.rstrip("/").rsplit("sf", 1)[-1]), "events": rows,
        "topic_seconds": over_topics, "stream_seconds": streams, "share_of_bytes_saved": saved,
    }))


if __name__ == "__main__":
    main()
