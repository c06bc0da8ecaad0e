"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then ``BENCH_RUNS`` times (default 5) into
Spark's ``noop`` sink (full execution, no collect); the median is reported.
Prints one JSON line. ``BENCH_EVENT_LOG_DIR`` (an existing folder) turns on
Spark's event log there, for stage and task times.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from promolift.plans import catalog, report  # noqa: E402
from promolift.session import build_session, work_dir  # noqa: E402
from promolift.sources import fixtures, store  # noqa: E402

HEADLINE = [
    "baselines", "analyze_promotions", "promo_rollup", "top_promos", "strategy", "forecast_match",
    "prepare", "overview", "profile", "article_uplift", "promo_types", "effectiveness", "quadrants",
    "article_kpis", "valid_articles",
]


def builds(spark, sf_dir: str) -> dict[str, float]:
    """Seconds to build the saved tables from the given ones, their writes included (one run each)."""
    work = f"{work_dir(spark)}/bench-{uuid.uuid4().hex}"
    out = {}
    for name, build, write in (
            ("build_prepared", lambda: report.prepared_sales(spark, sf_dir, save_rows=True), store.write_sales_table),
            ("build_raw_sales", lambda: fixtures.RAW["sales_a"](spark, sf_dir), store.write_csv)):
        t0 = time.perf_counter()
        write(build(), f"{work}/{name}")
        out[name] = round(time.perf_counter() - t0, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    extra = {}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    if log_dir:  # stage and task times for later study, without the web UI
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra_conf=extra)
    times: dict[str, float] = {}
    for name in names:
        df = catalog.run(name, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    times |= builds(spark, sf_dir)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times[n] for n in names), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "shuffle_partitions": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
