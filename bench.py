"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores.  Each query runs once to warm up and then three times; the median
counts.  Results are consumed whole by a noop write, so no column is pruned away by a count.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siltworks.operators import dq
from siltworks.plans.registry import QUERIES, load_all, table
from siltworks.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def line_rules():
    from siltworks.functions.rules import Rule

    return [
        Rule("l_quantity", "FLOAT", "RANGE", "ERROR", "1:45"),
        Rule("l_discount", "FLOAT", "RANGE", "WARN", "0:0.05"),
        Rule("l_tax", "FLOAT", "CUSTOM", "ERROR", "NEGATIVE_CHECK=true"),
        Rule("l_returnflag", "STRING", "CUSTOM", "WARN", "ALLOWED_VALUES=A,N"),
        Rule("l_linestatus", "STRING", "REGEX", "ERROR", "[A-Z]$"),
        Rule("l_shipdate", "TIMESTAMP", "NOT_NULL", "BLOCK"),
        Rule("l_orderkey", "INTEGER", "UNIQUE", "INFO"),
    ]


def lines_split(spark, sf):
    """Six row rules and one UNIQUE over every line item: the clean rows."""
    return dq.valid_rows(dq.flag(table(spark, sf, "lineitem"), line_rules()))


def lines_report(spark, sf):
    return dq.details(dq.flag(table(spark, sf, "lineitem"), line_rules()), line_rules())


def profile_all(spark, sf):
    return QUERIES["key_candidates"](spark, sf)


def main() -> int:
    load_all()
    spark = build_session(f"local[{CPUS}]", "bench", shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    headline = {
        "lines_split": lines_split,
        "lines_report": lines_report,
        "silver_upsert": QUERIES["silver_upsert_composite"],
        "layer_run": QUERIES["layer_run"],
        "profile_tables": profile_all,
        "labels_frameworks": QUERIES["labels_frameworks"],
        "labels_sources": QUERIES["labels_sources"],
        "dq_unique_text": QUERIES["dq_unique"],
        "catalog_merge": QUERIES["catalog_merge"],
        "table_checks": QUERIES["table_checks"],
        "flow_paths": QUERIES["flow_paths"],
    }
    names = sys.argv[1:] or list(headline)
    times = {}
    for name in names:
        runs = []
        for i in range(4):
            start = time.perf_counter()
            headline[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total of the median seconds per headline query", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
