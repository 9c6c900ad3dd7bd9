"""R01-R39 (best match per scenario) and G01-G22 (every match of a strategy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions.formulas import rounded
from roadsift.oracles.rules_sql import build, finish
from roadsift.plans import scene
from roadsift.plans.registry import add
from roadsift.rules.catalog import RULES
from roadsift.rules.detector import detect

STRATEGIES = {
    "G01_longitudinal_pair": ["lead_hard_brake", "lead_sudden_stop", "slow_lead_blockage", "short_headway_following", "rear_vehicle_rapid_approach"],
    "G02_longitudinal_triple": ["chain_braking", "multi_vehicle_gap_squeeze"],
    "G03_lane_change_pair": ["adjacent_vehicle_cut_in"],
    "G04_lane_change_gap": ["narrow_gap_lane_change"],
    "G05_cyclist_merge_gap": ["cyclist_vehicle_merge"],
    "G06_motorcyclist_filtering": ["motorcyclist_filtering_conflict"],
    "G07_three_vehicle_reveal": ["cut_out_reveals_slow_vehicle"],
    "G08_simultaneous_lane_change": ["simultaneous_lane_change_conflict"],
    "G09_blockage_avoidance": ["forced_lane_change_around_blockage"],
    "G10_merge_pair": ["ramp_merge_small_gap", "lane_drop_merge_competition", "merge_without_yield", "bike_lane_vehicle_merge_conflict"],
    "G11_merge_triple": ["zipper_merge_multi_vehicle"],
    "G12_diverge_crossing": ["late_lane_change_before_diverge", "diverge_lane_crossing_conflict"],
    "G13_conflict_point_pair": ["unprotected_left_turn_conflict", "right_turn_vehicle_conflict", "crossing_path_conflict", "intersection_creep_conflict"],
    "G14_mutual_yield": ["mutual_yield_deadlock"],
    "G15_u_turn": ["abrupt_u_turn_conflict"],
    "G16_intersection_occupancy": ["intersection_blocking_vehicle"],
    "G17_vru_vehicle_conflict": ["crosswalk_pedestrian_crossing", "jaywalking_pedestrian_crossing", "roadside_pedestrian_emergence", "cyclist_crossing",
                                 "turning_vehicle_crosswalk_conflict"],
    "G18_group_pedestrian": ["group_pedestrian_crossing"],
    "G19_wrong_way": ["wrong_way_vehicle"],
    "G20_stopped_reentry": ["stopped_vehicle_reentry"],
    "G21_static_blockage": ["construction_object_lane_blockage", "static_object_avoidance"],
    "G22_cut_in_then_brake": ["cut_in_then_brake"],
}
SHOW = ["scenario_id", "skill_id", "initiator", "responder", "extra", f"{rounded('score')} AS score", "risk_metric", f"{rounded('risk_value')} AS risk_value"]


def found(spark, sf_dir: str, skills: list[str], limit: int | None) -> DataFrame:
    hits = detect(scene.states(spark, sf_dir), scene.roads(spark, sf_dir), [RULES[s] for s in skills], limit, scene.actors(spark, sf_dir))
    return hits.selectExpr(*SHOW)


_SQL = build()
one = lambda skill, limit: finish(_SQL[skill], skill, " ".join(RULES[skill].required_tracks), limit)
for number, skill in enumerate(RULES, 1):
    add(f"R{number:02d}_{skill}", lambda spark, sf, s=skill: found(spark, sf, [s], 1), one(skill, True))
for name, skills in STRATEGIES.items():
    add(name, lambda spark, sf, s=skills: found(spark, sf, s, None), " UNION ALL ".join(f"SELECT * FROM ({one(s, False)}) {s}" for s in skills))
