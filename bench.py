"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.  Every query runs to its
last row into the no-op sink; BENCH_ALL=1 times every query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "w1_w2_t8_best_scene_per_tile_and_month", "w3_composite_scenes", "a2_a3_a4_e4_e7_window_reports", "t1_t3_d3_d7_radar_pair_plan",
    "a7_product_coverage", "j2_items_in_overlapping_windows", "s3_p1_to_p6_normalised_items", "s4_many_searches", "g2_dissolve_per_source_and_month",
    "g8_points_in_polygons", "t5_s10_nearest_hazard", "j1_f1_to_f4_t7_f15_resolution", "j11_fallbacks", "j7_gaps", "j8_reusable_files",
    "j10_files_over_areas", "a12_library_summary", "j14_reconciled_recipe", "x1_periods_in_text", "x2_x3_places_in_text", "j15_x4_keyword_rules",
    "j16_a22_closest_example_per_rule", "r3_nearest_regrid", "r4_mosaic", "i2_best_scene_per_month_stream",
)


def main() -> None:
    from queries import load
    from tilewright.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 1))
    queries, _ = load()
    names = list(queries) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in queries]
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        if os.environ.get("BENCH_ALL"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
