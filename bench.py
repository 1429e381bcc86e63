"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tallymark import EmitOptions, registry
    from tallymark.plans.storage import clean

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    diff = lambda pair, *o: registry.diff_of(spark, SF_DIR, pair, *o)
    queries = {
        "keyed_counts": lambda: diff("orders").counts(),
        "keyed_rows": lambda: registry.QUERIES["diff_keyed_rows"](spark, SF_DIR),
        "all_keys": lambda: registry.QUERIES["all_keys_multiset"](spark, SF_DIR),
        "similarity": lambda: registry.QUERIES["similarity_pairs"](spark, SF_DIR),
        "moves": lambda: registry.QUERIES["move_flags"](spark, SF_DIR),
        "ordered_report": lambda: diff("orders").report(),
        "summary": lambda: diff("orders").emit("summary"),
        "jsonl_changes": lambda: diff("orders").emit("jsonl", EmitOptions(changes_only=True)),
        "csv": lambda: diff("orders").emit("csv"),
        "events": lambda: registry.QUERIES["event_snapshot_diff"](spark, SF_DIR),
        "segments": lambda: registry.QUERIES["segments_rebuild_both"](spark, SF_DIR),
        "html_escape": lambda: registry.QUERIES["html_escape"](spark, SF_DIR),
    }
    took = {}
    for name, query in queries.items():
        best = []
        for _ in range(1 if took else 2):  # the very first run also starts the session
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
            clean(spark)
        took[name] = round(min(best), 3)
        print(name, best, file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
