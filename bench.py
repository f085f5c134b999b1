"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line, seconds of the second run of each.

Lookups and searches read the kept cells, as a user's would; `cells_all` is the build of those cells from the rows (all
grains, dimensions, measures and pairs), and `cells_*` and `welch_t` compute from the rows as well.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.operators.cells import build_cells, select_pairs
from plumbline.plans import evidence
from plumbline.sources import tables

HEADLINE = ("breakdown", "trend", "contribution", "cells_month", "cells_pair", "profile_counts", "percentiles", "welch_t", "drill_dimensions", "correlations", "discover_candidates", "discovery_feed")


def cells_all(spark, sf_dir):
    rows = tables.sales(spark, sf_dir)
    pairs = select_pairs({"r_name": 5, "n_name": 25, "c_mktsegment": 5, "o_orderpriority": 5, "l_returnflag": 3})
    return build_cells(rows, "day", tables.SALES_DIMS, list(tables.SALES_MEASURES), pairs)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        # aggregates of many columns become methods that the JVM would otherwise leave uncompiled
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {"cells_all": cells_all} | {name: evidence.QUERIES[name] for name in HEADLINE}
    seconds = {}
    for name, run in runs.items():
        for _ in range(2):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
