"""Time headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cairnfield.plans import load_queries
from cairnfield.plans.registry import QUERIES
from cairnfield.session import build_session

HEADLINE = [
    "g10_fit_methods", "g13_loo_residuals", "j01_apply_fit", "g01_path_length", "g03_signed_area", "w02_cumulative_length", "j18_junctions",
    "j03_near_ends", "t05_split_trails", "t06_join_pairs", "t03_maps_needing_cleanup", "t02_snap_ends", "t13_smooth", "t12_simplify",
    "j07_tile_cover", "k04_cell_neighbourhood", "f05_document_escape", "s11_gpx", "r01_color_mask", "g16_color_histogram", "w11_rolling_count", "x05_schedule_starts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "cairnfield-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
