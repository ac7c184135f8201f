"""Times the headline queries; prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads.

One warm-up run, then the median of three runs of each query into the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ("cutflow_weighted_mc_data", "hist_weighted", "hist_dense", "hist_2d", "define_elementwise", "reduce_sum", "systematic_weights", "skim_flat")


def main() -> None:
    from eventloom.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    nested = {"nesting": lambda: catalog.order_events(spark, sf_dir).df}
    for name, query in (nested | {q: (lambda q=q: catalog.QUERIES[q](spark, sf_dir)) for q in HEADLINE}).items():
        taken = []
        for _ in range(4):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")}
    total = round(sum(times[q] for q in HEADLINE), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "conf": conf}))
    spark.stop()


if __name__ == "__main__":
    main()
