"""Times the catalogue's queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from codelake import catalogue

HEADLINE = ("q09_four_way_join", "q10_two_role_dim", "q13_left_join_coalesce", "q16_not_in_subquery_chain", "q21_count_distinct", "q22_sum_left_coverage", "q30_placement_counts", "q31_treemap_rollup_a", "q41_degree", "q43_representative", "q44_reachability", "q51_ffill_state", "q54_layout_offsets", "q60_fk_audit")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total of the median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("/")[2]}))


if __name__ == "__main__":
    main()
