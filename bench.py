"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is fully materialised with the ``noop`` sink (every column is
computed, nothing is collected). One warm-up run on the smallest data starts
the JVM code paths and Python workers first. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gazette.plans.queries import QUERIES  # noqa: E402
from gazette.session import get_session  # noqa: E402

HEADLINE = [
    "collect_pipeline", "relevance", "classify_keyword", "classify_nearest", "vote_weighted", "tfidf",
    "classify_nb", "lang_detect", "neighbor_pairs", "dbscan", "clusters", "digest_basic", "digest_gated",
    "store_insert_new", "method_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", app="gazette-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g", "gazette.input.partitions": str(cpus)})
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        QUERIES["digest_basic"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()      # each query is measured on its own
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
