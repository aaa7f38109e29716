"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan is
executed, nothing is collected) and is timed separately. Before timing, the
flagship runs once on the smallest tables (sf0.001) to warm up the JVM (class
loading, code generation); that pass is not timed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from procweave.plans.queries import QUERIES  # noqa: E402
from procweave.session import get_spark  # noqa: E402

HEADLINE = [
    "top_called",            # flagship: extraction -> resolve -> in-degree -> top-k
    "proc_calls",            # regex extraction over the whole corpus
    "field_usage",           # select/insert/update/transform fields
    "proc_levels",           # iterative peeling (dependency levels)
    "impact",                # multi-root BFS crawl, depth 3, every procedure
    "catalog_columns",       # columns x PK x FK assembly
    "table_ddl",             # ordered string aggregation per table
    "table_levels",          # iterative peeling over the FK graph
    "relations",             # twelve relation types over DDL objects
    "degrees",
    "field_profile_lineitem",
    "semantic_topk_multi",   # many-query exact vector search
    "sql_audit",
    "token_by_operation",
    "code_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    only = set(sys.argv[1:])
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["top_called"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        if only and key not in only:
            continue
        t0 = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
