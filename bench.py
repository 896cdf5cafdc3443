"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the sample tables, ``BENCH_CPUS`` the local cores.  Every
query runs to a no-op sink, so all rows and columns are computed; exports write
their files.  Each time is the better of two runs.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tradewind.registry.queries import QUERIES

HEADLINES = [
    "scan_orders",
    "f_amounts",
    "f_has_had_state",
    "f_products_together",
    "f_coupons_together",
    "f_manufacturer",
    "f_has_payment",
    "geo_both",
    "geo_region",
    "c_in_group",
    "customer_value",
    "enriched_orders",
    "flat_orders",
    "count_flat",
    "relational_closure",
    "reference_bundle",
    "anonymize",
    "csv_safe_value",
    "mask_email",
    "log_redact",
    "sink_csv",
    "export_relational",
    "export_flat",
    "file_manifest",
    "retention_split",
    "top_recent_jobs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("flat_orders")
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
