"""Times the headline queries and prints one JSON line.

Each query is run once to warm up the JVM and then RUNS times; the median counts. A run
plans the query and computes all of its rows, which are not kept.

Environment: BENCH_SF_DIR (test tables), BENCH_CPUS (local threads).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from vitaloom.plans import inputs
from vitaloom.plans.queries import QUERIES
from vitaloom.session import build_session

HEADLINE = (
    "profiles",
    "missing_rate",
    "doc_lines",
    "doc_sections",
    "contact_phone",
    "strict_validate",
    "ledger",
    "render_context",
    "layout_lines",
    "apply_edits",
    "unresolved_missing",
    "blueprint_match",
    "artifact_state",
    "debug_artifact_map",
    "corpus_failures",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs.PARTITIONS = int(cpus)  # the test tables are one file each
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    resumes = documents + spark.read.parquet(f"{sf_dir}/customer.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
                "cpus": int(cpus),
                "documents": documents,
                "profiles_per_sec": round(resumes / timings["profiles"], 1)
                if "profiles" in timings
                else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
