"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; its time is the median. Caches are
dropped before every run, so no run reads the result of another.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from shelfmargin.registry import QUERIES
from shelfmargin.session import build_session

HEADLINES = (
    "star_orders",
    "product_catalog_flat",
    "order_recap_flat",
    "discount_base",
    "facet_options",
    "discount_kpis",
    "product_summary",
    "discount_insights",
    "discount_conclusions",
    "high_sales_low_profit",
    "scatter_sample",
    "hidden_segments",
    "hidden_kpis",
    "top_region_category",
    "hidden_drilldown",
    "trap_products",
    "bought_together",
    "bought_together_top",
)


def run(spark, sf_dir: str, name: str) -> float:
    spark.catalog.clearCache()
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        run(spark, sf_dir, name)
        timings[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "spark": spark.version,
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
