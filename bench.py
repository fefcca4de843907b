"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and then BENCH_RUNS (default 3) times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = {
    "flow_matrix": "RS01_flow_matrix",
    "plate_vector": "AG09_plate_vector",
    "mixture_matrix": "RS02_mixture_matrix",
    "accident_target": "JN06_target",
    "section_matrix": "JN05_section_matrix",
    "trajectory_bundle": "TR01_trajectory_bundle",
    "macro_metrics": "AG17_macro_metrics",
    "densest_windows": "WN08_densest_windows",
    "far_threshold": "ML19_far_threshold",
    "roc_auc": "ML21_roc_auc",
    "batch_rollup": "AG11_batch_rollup",
    "parse_detections": "SRC01_parse_detections",
    "snap_to_roads": "JN10_nearest_road_point",
    "column_profile": "AG27_column_profile",
    "oversampling": "ML16_smote",
    "headway_stream": "SS03_headway_stream",
}


def main() -> None:
    from tollspan.plans import QUERIES
    from tollspan.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, key in HEADLINE.items():
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(taken[1:]), 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
        "spark": spark.version,
    }
    spark.stop()
    sys.stdout.write(json.dumps(line) + "\n")


if __name__ == "__main__":
    main()
