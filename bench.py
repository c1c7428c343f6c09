"""Benchmark: time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
``value`` is the total wall time of the timed queries.  A warm-up query runs
first so JVM start-up and code generation are not charged to the first query.
Each query's result is fully materialised on the executors (``write`` to the
``noop`` sink), not collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_status",
    "code_confusion_edges",
    "subcode_confusion_edges",
    "confusion_weights",
    "eval_report_by_model",
    "span_prf",
    "preference_pairs",
    "strategy_distribution",
    "token_weights",
    "preference_loss_metrics",
    "doc_code_confusion_edges",
    "doc_eval_report_by_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from spanpref.plans.queries import QUERIES
    from spanpref.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus))))))
    names = only or HEADLINE
    QUERIES["context_fields"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_wall_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
