"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from roadsift.plans import registry, scene
from roadsift.session import build_session

HEADLINE = [
    "P10_reference_state", "J03_lane_match", "J13_trajectory_conflict", "J15_minimum_distance", "R04_short_headway_following", "R21_crossing_path_conflict", "G01_longitudinal_pair",
    "E06_validation_label_scan", "W04_risk_quartiles", "W07_balanced_delivery", "W12_two_phase_order", "A02_numeric_distribution", "A05_log_histogram", "A09_prediction_summary", "A12b_paired_bootstrap",
    "K03_kinematics_stage", "K05_lane_compliance", "K07_collision_stage", "M09_path_arrival_gap", "P26_actor_features", "D03_greedy_diversity", "K12_whole_funnel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    # tables that several queries share (tracks, actors, pairs' features) are built first, on their own line
    start = time.time()
    scene.actors(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {"shared_tables": round(time.time() - start, 3)}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
