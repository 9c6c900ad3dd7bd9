"""The interaction rules: actor types, roles, gates, risk targets, thresholds, parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    skill_id: str
    status: str
    feasibility: str
    mode: str
    strategy: str
    initiator_types: tuple[str, ...]
    responder_types: tuple[str, ...]
    roles: tuple[str, ...]
    required_tracks: tuple[str, ...]
    required_map: tuple[str, ...]
    history: int
    metric: str
    low: float
    high: float
    higher: bool
    thresholds: dict[str, float] = field(hash=False, default_factory=dict)
    parameters: dict[str, object] = field(hash=False, default_factory=dict)

    def __getitem__(self, name: str) -> float:
        return self.thresholds[name]


# All names, thresholds, ranges and roles below define the meaning of the rules and keep these exact values.
# A parameter is a range of two numbers or a choice of names.
CATALOG = (
    Rule(
        skill_id="lead_hard_brake", status="candidate", feasibility="A", mode="observed_trigger", strategy="longitudinal_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("leader", "follower"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "lane_successor"), history=30,
        metric="time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_deceleration_mps2": 2.0, "minimum_closing_speed_mps": 1.0, "maximum_pair_gap_m": 55.0},
        parameters={"brake_onset_s": (0.5, 2.5), "peak_deceleration_mps2": (2.0, 6.0), "braking_duration_s": (0.8, 3.0)},
    ),
    Rule(
        skill_id="lead_sudden_stop", status="formal", feasibility="A", mode="observed_trigger", strategy="longitudinal_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("stopping_leader", "follower"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "lane_successor"), history=30,
        metric="stopping_distance_margin", low=0.5, high=8.0, higher=False,
        thresholds={"stopped_speed_mps": 0.5, "minimum_prior_speed_mps": 2.0, "minimum_stopped_duration_s": 1.0, "maximum_pair_gap_m": 55.0, "minimum_follower_speed_mps": 1.0, "minimum_closing_speed_mps": 0.5, "minimum_pair_gap_m": 2.0},
        parameters={"stop_onset_s": (0.5, 3.0), "stopping_duration_s": (1.0, 3.5), "stopped_hold_s": (1.0, 5.0)},
    ),
    Rule(
        skill_id="slow_lead_blockage", status="formal", feasibility="A", mode="observed_trigger", strategy="longitudinal_pair",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle",), roles=("slow_leader", "follower"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="minimum_longitudinal_gap", low=3.0, high=15.0, higher=False,
        thresholds={"maximum_leader_speed_mps": 2.0, "minimum_low_speed_duration_s": 2.0, "maximum_pair_gap_m": 45.0, "minimum_follower_speed_mps": 1.0, "minimum_closing_speed_mps": 0.5, "minimum_pair_gap_m": 2.0},
        parameters={"leader_speed_scale": (0.0, 0.5), "blockage_duration_s": (2.0, 6.0), "initial_gap_m": (8.0, 45.0)},
    ),
    Rule(
        skill_id="short_headway_following", status="formal", feasibility="A", mode="observed_trigger", strategy="longitudinal_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("leader", "close_follower"),
        required_tracks=("vehicle",), required_map=("lane_centerline",), history=30,
        metric="time_headway", low=0.4, high=1.2, higher=False,
        thresholds={"minimum_follower_speed_mps": 2.0, "maximum_time_headway_s": 1.2, "minimum_duration_s": 1.0},
        parameters={"target_headway_s": (0.4, 1.2), "duration_s": (1.0, 5.0), "follower_speed_scale": (0.9, 1.2)},
    ),
    Rule(
        skill_id="rear_vehicle_rapid_approach", status="candidate", feasibility="A", mode="observed_trigger", strategy="longitudinal_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("rapid_rear_vehicle", "target_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline",), history=30,
        metric="rear_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_relative_speed_mps": 1.0, "maximum_initial_gap_m": 40.0, "maximum_time_to_collision_s": 4.0},
        parameters={"rear_speed_scale": (1.05, 1.35), "initial_gap_m": (8.0, 40.0), "approach_onset_s": (0.5, 3.0)},
    ),
    Rule(
        skill_id="chain_braking", status="formal", feasibility="B", mode="compatible_seed", strategy="longitudinal_triple",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle", "bus"), roles=("front_vehicle", "middle_vehicle", "rear_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "lane_successor"), history=30,
        metric="minimum_longitudinal_gap", low=3.0, high=15.0, higher=False,
        thresholds={"minimum_queue_gap_m": 2.0, "maximum_queue_gap_m": 45.0, "minimum_moving_speed_mps": 1.0, "minimum_vehicle_center_distance_m": 2.0},
        parameters={"front_brake_onset_s": (0.5, 2.0), "propagation_delay_s": (0.2, 1.5), "peak_deceleration_mps2": (2.0, 6.0)},
    ),
    Rule(
        skill_id="adjacent_vehicle_cut_in", status="candidate", feasibility="A", mode="observed_trigger", strategy="lane_change_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("cut_in_vehicle", "responding_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="post_cut_in_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_lateral_displacement_m": 2.0, "minimum_target_gap_m": 4.0, "maximum_target_gap_m": 18.0},
        parameters={"cut_in_start_s": (0.5, 3.0), "cut_in_duration_s": (1.0, 3.0), "target_gap_m": (4.0, 18.0)},
    ),
    Rule(
        skill_id="cut_out_reveals_slow_vehicle", status="formal", feasibility="B", mode="compatible_seed", strategy="three_vehicle_reveal",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("cut_out_vehicle", "target_vehicle", "slow_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="newly_exposed_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_slow_vehicle_speed_mps": 2.0, "maximum_queue_gap_m": 55.0, "minimum_queue_gap_m": 2.0},
        parameters={"cut_out_start_s": (0.5, 2.5), "slow_vehicle_speed_scale": (0.0, 0.4), "response_delay_s": (0.2, 1.2)},
    ),
    Rule(
        skill_id="narrow_gap_lane_change", status="candidate", feasibility="A", mode="observed_trigger", strategy="lane_change_gap",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("lane_changer", "target_front_vehicle", "target_rear_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="minimum_front_rear_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_lateral_displacement_m": 2.0, "maximum_front_gap_m": 15.0, "maximum_rear_gap_m": 15.0},
        parameters={"lane_change_start_s": (0.5, 3.0), "front_gap_m": (4.0, 15.0), "rear_gap_m": (4.0, 15.0)},
    ),
    Rule(
        skill_id="simultaneous_lane_change_conflict", status="formal", feasibility="B", mode="compatible_seed", strategy="simultaneous_lane_change",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("left_lane_changer", "right_lane_changer"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="lateral_time_to_collision", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_longitudinal_gap_m": 12.0, "minimum_shared_target_length_m": 15.0, "minimum_vehicle_center_distance_m": 2.0},
        parameters={"first_start_s": (0.5, 3.0), "second_start_offset_s": (-0.5, 0.5), "target_longitudinal_gap_m": (0.0, 12.0)},
    ),
    Rule(
        skill_id="forced_lane_change_around_blockage", status="formal", feasibility="B", mode="compatible_seed", strategy="blockage_avoidance",
        initiator_types=("vehicle", "static", "construction"), responder_types=("vehicle",), roles=("blocking_actor", "avoiding_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane", "drivable_area"), history=30,
        metric="minimum_combined_clearance", low=1.0, high=6.0, higher=False,
        thresholds={"maximum_blocker_speed_mps": 0.5, "maximum_object_path_distance_m": 8.0, "minimum_blockage_distance_m": 2.0, "maximum_blockage_distance_m": 35.0, "minimum_moving_speed_mps": 1.0, "minimum_vehicle_center_distance_m": 2.0},
        parameters={"blockage_offset_m": (5.0, 35.0), "avoidance_start_s": (0.5, 3.0), "accepted_gap_s": (1.0, 4.0)},
    ),
    Rule(
        skill_id="late_lane_change_before_diverge", status="formal", feasibility="B", mode="compatible_seed", strategy="diverge_crossing",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle", "bus"), roles=("late_lane_changer", "adjacent_lane_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane", "diverging_lane"), history=30,
        metric="minimum_crossing_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_distance_to_diverge_m": 60.0, "maximum_target_gap_m": 20.0, "minimum_adjacent_lane_length_m": 20.0, "minimum_current_separation_m": 2.0},
        parameters={"lane_change_start_distance_m": (5.0, 35.0), "lane_change_duration_s": (1.5, 4.0), "target_gap_m": (4.0, 18.0)},
    ),
    Rule(
        skill_id="ramp_merge_small_gap", status="formal", feasibility="A", mode="observed_trigger", strategy="merge_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("merging_vehicle", "mainline_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_successor", "converging_lane"), history=30,
        metric="conflict_point_time_gap", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_convergence_distance_m": 60.0, "maximum_arrival_time_gap_s": 3.0},
        parameters={"merge_time_s": (1.0, 5.0), "accepted_gap_s": (1.0, 4.0), "merge_speed_scale": (0.8, 1.2)},
    ),
    Rule(
        skill_id="lane_drop_merge_competition", status="formal", feasibility="B", mode="compatible_seed", strategy="merge_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("closing_lane_vehicle", "continuing_lane_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_successor", "converging_lane"), history=30,
        metric="convergence_time_gap", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_convergence_distance_m": 60.0, "maximum_competing_vehicle_gap_m": 55.0},
        parameters={"convergence_distance_m": (15.0, 60.0), "priority_role": ("closing_lane_vehicle", "continuing_lane_vehicle"), "accepted_gap_s": (1.0, 4.0)},
    ),
    Rule(
        skill_id="merge_without_yield", status="formal", feasibility="B", mode="compatible_seed", strategy="merge_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("non_yielding_vehicle", "priority_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_successor", "converging_lane"), history=30,
        metric="conflict_point_time_gap", low=0.5, high=2.5, higher=False,
        thresholds={"maximum_convergence_distance_m": 60.0, "maximum_arrival_time_gap_s": 4.0},
        parameters={"merge_onset_s": (0.5, 3.5), "accepted_gap_s": (0.5, 2.5), "priority_role": ("initiator", "responder")},
    ),
    Rule(
        skill_id="diverge_lane_crossing_conflict", status="formal", feasibility="B", mode="compatible_seed", strategy="diverge_crossing",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("crossing_vehicle", "through_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_successor", "diverging_lane", "adjacent_lane"), history=30,
        metric="minimum_crossing_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_distance_to_diverge_m": 60.0, "maximum_target_gap_m": 18.0, "minimum_lateral_displacement_m": 0.25},
        parameters={"distance_to_diverge_m": (10.0, 60.0), "crossing_start_s": (0.5, 3.0), "target_gap_m": (4.0, 18.0)},
    ),
    Rule(
        skill_id="bike_lane_vehicle_merge_conflict", status="formal", feasibility="A", mode="observed_trigger", strategy="merge_pair",
        initiator_types=("cyclist",), responder_types=("vehicle",), roles=("cyclist", "motor_vehicle"),
        required_tracks=("vehicle", "cyclist"), required_map=("bike_lane", "lane_successor"), history=20,
        metric="post_encroachment_time", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_arrival_time_gap_s": 3.0, "maximum_conflict_distance_m": 6.0},
        parameters={"cyclist_speed_mps": (2.0, 7.0), "vehicle_speed_scale": (0.7, 1.1), "arrival_time_gap_s": (0.5, 3.0)},
    ),
    Rule(
        skill_id="zipper_merge_multi_vehicle", status="formal", feasibility="B", mode="compatible_seed", strategy="merge_triple",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle", "bus"), roles=("merging_vehicle", "leading_main_flow_vehicle", "trailing_main_flow_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "converging_lane"), history=30,
        metric="convergence_time_gap", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_convergence_distance_m": 60.0, "maximum_competing_vehicle_gap_m": 35.0, "maximum_arrival_time_gap_s": 5.0, "minimum_current_separation_m": 2.0},
        parameters={"merge_order_offset_s": (-1.5, 1.5), "leading_gap_s": (0.8, 3.0), "trailing_gap_s": (0.8, 3.0)},
    ),
    Rule(
        skill_id="unprotected_left_turn_conflict", status="formal", feasibility="A", mode="observed_trigger", strategy="conflict_point_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("left_turn_vehicle", "opposing_through_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "lane_centerline"), history=30,
        metric="post_encroachment_time", low=0.5, high=3.0, higher=False,
        thresholds={"minimum_turn_heading_change_deg": 25.0, "minimum_opposing_heading_difference_deg": 120.0, "maximum_arrival_time_gap_s": 3.0, "maximum_conflict_distance_m": 6.0},
        parameters={"turn_start_s": (0.5, 3.0), "turn_speed_mps": (2.0, 8.0), "accepted_gap_s": (1.0, 4.0)},
    ),
    Rule(
        skill_id="right_turn_vehicle_conflict", status="formal", feasibility="A", mode="observed_trigger", strategy="conflict_point_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("right_turn_vehicle", "conflicting_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "lane_centerline"), history=30,
        metric="conflict_point_time_gap", low=0.5, high=3.0, higher=False,
        thresholds={"minimum_turn_heading_change_deg": 25.0, "maximum_arrival_time_gap_s": 3.0, "maximum_conflict_distance_m": 6.0},
        parameters={"turn_start_s": (0.5, 3.0), "turn_speed_mps": (2.0, 8.0), "arrival_time_gap_s": (0.5, 3.0)},
    ),
    Rule(
        skill_id="crossing_path_conflict", status="formal", feasibility="A", mode="observed_trigger", strategy="conflict_point_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("first_vehicle", "second_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "lane_centerline"), history=30,
        metric="post_encroachment_time", low=0.5, high=3.0, higher=False,
        thresholds={"minimum_crossing_angle_deg": 25.0, "maximum_arrival_time_gap_s": 3.0, "maximum_conflict_distance_m": 6.0},
        parameters={"first_speed_scale": (0.8, 1.2), "second_speed_scale": (0.8, 1.2), "priority_role": ("first_vehicle", "second_vehicle")},
    ),
    Rule(
        skill_id="intersection_creep_conflict", status="formal", feasibility="B", mode="compatible_seed", strategy="conflict_point_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("creeping_vehicle", "crossing_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "drivable_area"), history=30,
        metric="conflict_area_intrusion_margin", low=0.2, high=3.0, higher=False,
        thresholds={"maximum_entry_distance_m": 8.0, "maximum_creep_speed_mps": 2.0, "maximum_crossing_arrival_s": 5.0, "minimum_crossing_angle_deg": 30.0, "maximum_crossing_angle_deg": 150.0, "minimum_crossing_vehicle_speed_mps": 1.0, "minimum_current_separation_m": 2.0},
        parameters={"creep_speed_mps": (0.3, 2.0), "intrusion_distance_m": (0.5, 5.0), "hold_duration_s": (0.5, 3.0)},
    ),
    Rule(
        skill_id="intersection_blocking_vehicle", status="formal", feasibility="B", mode="compatible_seed", strategy="intersection_occupancy",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("blocking_vehicle", "crossing_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "drivable_area"), history=30,
        metric="conflict_area_occupancy_overlap", low=0.5, high=3.0, higher=True,
        thresholds={"maximum_blocker_speed_mps": 0.5, "maximum_crossing_arrival_s": 5.0, "minimum_conflict_area_length_m": 3.0, "minimum_crossing_angle_deg": 30.0, "maximum_crossing_angle_deg": 150.0, "minimum_crossing_vehicle_speed_mps": 1.0, "minimum_current_separation_m": 2.0},
        parameters={"hold_position_offset_m": (-3.0, 3.0), "hold_duration_s": (1.0, 5.0), "crossing_arrival_s": (1.0, 5.0)},
    ),
    Rule(
        skill_id="mutual_yield_deadlock", status="formal", feasibility="B", mode="compatible_seed", strategy="conflict_point_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("first_yielding_vehicle", "second_yielding_vehicle"),
        required_tracks=("vehicle",), required_map=("intersection_lane", "lane_centerline"), history=30,
        metric="conflict_point_time_gap", low=0.5, high=3.0, higher=False,
        thresholds={"maximum_entry_distance_m": 8.0, "maximum_creep_speed_mps": 2.0, "minimum_crossing_angle_deg": 30.0, "maximum_crossing_angle_deg": 150.0, "minimum_current_separation_m": 2.0},
        parameters={},
    ),
    Rule(
        skill_id="crosswalk_pedestrian_crossing", status="formal", feasibility="A", mode="observed_trigger", strategy="vru_vehicle_conflict",
        initiator_types=("pedestrian",), responder_types=("vehicle",), roles=("pedestrian", "yielding_vehicle"),
        required_tracks=("pedestrian", "vehicle"), required_map=("pedestrian_crossing", "drivable_area"), history=20,
        metric="post_encroachment_time", low=0.5, high=4.0, higher=False,
        thresholds={"maximum_crosswalk_distance_m": 8.0, "maximum_arrival_time_gap_s": 4.0, "maximum_conflict_distance_m": 6.0},
        parameters={"crossing_start_s": (0.5, 3.0), "pedestrian_speed_mps": (0.8, 2.2), "arrival_time_gap_s": (0.5, 4.0)},
    ),
    Rule(
        skill_id="jaywalking_pedestrian_crossing", status="formal", feasibility="A", mode="observed_trigger", strategy="vru_vehicle_conflict",
        initiator_types=("pedestrian",), responder_types=("vehicle",), roles=("pedestrian", "responding_vehicle"),
        required_tracks=("pedestrian", "vehicle"), required_map=("pedestrian_crossing", "drivable_area"), history=20,
        metric="post_encroachment_time", low=0.5, high=4.0, higher=False,
        thresholds={"minimum_crosswalk_clearance_m": 10.0, "maximum_arrival_time_gap_s": 4.0, "maximum_conflict_distance_m": 6.0, "minimum_crossing_angle_deg": 30.0, "maximum_crossing_angle_deg": 150.0},
        parameters={"crossing_start_s": (0.5, 3.0), "crossing_angle_deg": (60.0, 120.0), "pedestrian_speed_mps": (0.8, 2.2)},
    ),
    Rule(
        skill_id="roadside_pedestrian_emergence", status="formal", feasibility="B", mode="compatible_seed", strategy="vru_vehicle_conflict",
        initiator_types=("pedestrian",), responder_types=("vehicle",), roles=("emerging_pedestrian", "responding_vehicle"),
        required_tracks=("pedestrian", "vehicle"), required_map=("drivable_area",), history=20,
        metric="first_intrusion_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_boundary_distance_m": 8.0, "maximum_vehicle_arrival_s": 4.0, "maximum_conflict_distance_m": 6.0},
        parameters={"emergence_start_s": (1.0, 4.0), "pedestrian_speed_mps": (0.8, 2.2), "initial_boundary_distance_m": (0.5, 8.0)},
    ),
    Rule(
        skill_id="cyclist_crossing", status="formal", feasibility="A", mode="observed_trigger", strategy="vru_vehicle_conflict",
        initiator_types=("cyclist",), responder_types=("vehicle",), roles=("crossing_cyclist", "responding_vehicle"),
        required_tracks=("cyclist", "vehicle"), required_map=("lane_centerline", "drivable_area"), history=20,
        metric="post_encroachment_time", low=0.5, high=4.0, higher=False,
        thresholds={"minimum_crossing_angle_deg": 45.0, "maximum_crossing_angle_deg": 135.0, "maximum_arrival_time_gap_s": 4.0, "maximum_conflict_distance_m": 6.0},
        parameters={"crossing_start_s": (0.5, 3.0), "crossing_angle_deg": (45.0, 135.0), "cyclist_speed_mps": (2.0, 7.0)},
    ),
    Rule(
        skill_id="turning_vehicle_crosswalk_conflict", status="formal", feasibility="A", mode="observed_trigger", strategy="vru_vehicle_conflict",
        initiator_types=("pedestrian",), responder_types=("vehicle",), roles=("pedestrian", "turning_vehicle"),
        required_tracks=("vehicle", "pedestrian"), required_map=("intersection_lane", "pedestrian_crossing"), history=20,
        metric="post_encroachment_time", low=0.5, high=4.0, higher=False,
        thresholds={"minimum_turn_heading_change_deg": 25.0, "maximum_crosswalk_distance_m": 8.0, "maximum_arrival_time_gap_s": 4.0, "maximum_conflict_distance_m": 6.0},
        parameters={"turn_speed_mps": (1.5, 7.0), "pedestrian_speed_mps": (0.8, 2.2), "arrival_time_gap_s": (0.5, 4.0)},
    ),
    Rule(
        skill_id="group_pedestrian_crossing", status="formal", feasibility="A", mode="observed_trigger", strategy="vru_vehicle_conflict",
        initiator_types=("pedestrian",), responder_types=("vehicle", "bus"), roles=("first_crossing_pedestrian", "responding_vehicle", "second_crossing_pedestrian"),
        required_tracks=("pedestrian", "vehicle"), required_map=("drivable_area",), history=20,
        metric="post_encroachment_time", low=0.5, high=4.0, higher=False,
        thresholds={"maximum_group_member_distance_m": 5.0, "maximum_group_heading_difference_deg": 45.0, "maximum_arrival_time_gap_s": 4.0, "maximum_conflict_distance_m": 6.0},
        parameters={"group_spacing_m": (0.5, 4.0), "crossing_speed_mps": (0.5, 2.5), "second_entry_delay_s": (0.0, 2.0)},
    ),
    Rule(
        skill_id="cyclist_vehicle_merge", status="formal", feasibility="A", mode="observed_trigger", strategy="lane_change_gap",
        initiator_types=("cyclist",), responder_types=("vehicle", "bus"), roles=("merging_cyclist", "front_motor_vehicle", "rear_motor_vehicle"),
        required_tracks=("cyclist", "vehicle"), required_map=("lane_centerline", "bike_lane", "adjacent_lane"), history=20,
        metric="minimum_front_rear_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_lateral_displacement_m": 0.5, "maximum_front_gap_m": 30.0, "maximum_rear_gap_m": 30.0, "maximum_merge_heading_difference_deg": 45.0},
        parameters={"merge_start_s": (0.5, 3.0), "cyclist_speed_mps": (2.0, 7.0), "accepted_gap_s": (0.8, 3.0)},
    ),
    Rule(
        skill_id="wrong_way_vehicle", status="candidate", feasibility="A", mode="observed_trigger", strategy="wrong_way_pair",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("wrong_way_vehicle", "normal_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "lane_direction"), history=30,
        metric="head_on_time_to_collision", low=1.0, high=5.0, higher=False,
        thresholds={"minimum_opposite_heading_difference_deg": 120.0, "minimum_moving_speed_mps": 2.0, "minimum_opposite_heading_duration_s": 1.0, "maximum_oncoming_distance_m": 60.0},
        parameters={"wrong_way_speed_mps": (2.0, 12.0), "lateral_offset_m": (-1.0, 1.0), "initial_distance_m": (15.0, 60.0)},
    ),
    Rule(
        skill_id="stopped_vehicle_reentry", status="formal", feasibility="B", mode="compatible_seed", strategy="stopped_reentry",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("reentering_vehicle", "front_main_flow_vehicle", "rear_main_flow_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "drivable_area"), history=30,
        metric="minimum_front_rear_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"stopped_speed_mps": 0.5, "minimum_stopped_duration_s": 1.0, "minimum_moving_speed_mps": 1.0, "minimum_vehicle_center_distance_m": 2.0, "maximum_lateral_reentry_distance_m": 5.0, "maximum_front_gap_m": 55.0, "maximum_rear_gap_m": 55.0},
        parameters={"restart_time_s": (0.5, 3.5), "acceleration_mps2": (0.5, 3.0), "accepted_gap_s": (1.0, 4.0)},
    ),
    Rule(
        skill_id="construction_object_lane_blockage", status="formal", feasibility="B", mode="compatible_seed", strategy="static_blockage",
        initiator_types=("construction",), responder_types=("vehicle",), roles=("construction_object", "responding_vehicle"),
        required_tracks=("construction", "vehicle"), required_map=("lane_centerline", "drivable_area"), history=20,
        metric="minimum_object_clearance", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_object_speed_mps": 0.5, "maximum_object_path_distance_m": 8.0, "maximum_vehicle_arrival_s": 6.0},
        parameters={"object_buffer_m": (1.0, 4.0), "response_start_s": (0.5, 3.0), "speed_scale": (0.2, 0.8)},
    ),
    Rule(
        skill_id="static_object_avoidance", status="formal", feasibility="B", mode="compatible_seed", strategy="static_blockage",
        initiator_types=("static",), responder_types=("vehicle",), roles=("static_object", "avoiding_vehicle"),
        required_tracks=("static", "vehicle"), required_map=("lane_centerline", "drivable_area", "adjacent_lane"), history=20,
        metric="minimum_object_clearance", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_object_speed_mps": 0.5, "maximum_object_path_distance_m": 8.0, "maximum_vehicle_arrival_s": 6.0},
        parameters={"object_buffer_m": (1.0, 4.0), "avoidance_offset_m": (0.5, 2.5), "response_start_s": (0.5, 3.0)},
    ),
    Rule(
        skill_id="cut_in_then_brake", status="formal", feasibility="B", mode="compatible_seed", strategy="cut_in_then_brake",
        initiator_types=("vehicle",), responder_types=("vehicle",), roles=("cut_in_braking_vehicle", "responding_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "adjacent_lane"), history=30,
        metric="minimum_stage_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_target_gap_m": 4.0, "maximum_target_gap_m": 18.0, "minimum_post_cut_in_braking_distance_m": 10.0},
        parameters={"cut_in_start_s": (0.5, 2.5), "brake_delay_after_cut_in_s": (0.2, 1.5), "peak_deceleration_mps2": (2.0, 6.0)},
    ),
    Rule(
        skill_id="abrupt_u_turn_conflict", status="formal", feasibility="B", mode="compatible_seed", strategy="conflict_point_pair",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle", "bus"), roles=("u_turning_vehicle", "conflicting_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "intersection_lane", "drivable_area", "lane_direction"), history=30,
        metric="head_on_time_to_collision", low=1.0, high=4.0, higher=False,
        thresholds={"maximum_entry_distance_m": 12.0, "minimum_moving_speed_mps": 0.5, "maximum_oncoming_distance_m": 45.0, "minimum_opposing_heading_difference_deg": 120.0, "minimum_current_separation_m": 2.0},
        parameters={"turn_start_s": (0.5, 2.5), "turn_radius_m": (5.0, 15.0), "angular_speed_deg_s": (20.0, 70.0)},
    ),
    Rule(
        skill_id="multi_vehicle_gap_squeeze", status="formal", feasibility="B", mode="compatible_seed", strategy="longitudinal_triple",
        initiator_types=("vehicle", "bus"), responder_types=("vehicle", "bus"), roles=("squeezed_vehicle", "front_pressure_vehicle", "rear_pressure_vehicle"),
        required_tracks=("vehicle",), required_map=("lane_centerline", "lane_successor"), history=30,
        metric="minimum_combined_clearance", low=1.0, high=6.0, higher=False,
        thresholds={"maximum_front_gap_m": 25.0, "maximum_rear_gap_m": 25.0, "minimum_combined_closing_speed_mps": 0.5, "minimum_current_separation_m": 2.0},
        parameters={"front_speed_scale": (0.3, 0.9), "rear_speed_scale": (1.05, 1.5), "squeeze_start_s": (0.5, 2.5)},
    ),
    Rule(
        skill_id="motorcyclist_filtering_conflict", status="formal", feasibility="B", mode="compatible_seed", strategy="lane_change_gap",
        initiator_types=("motorcyclist",), responder_types=("vehicle", "bus"), roles=("filtering_motorcyclist", "first_vehicle", "second_vehicle"),
        required_tracks=("motorcyclist", "vehicle"), required_map=("lane_centerline", "drivable_area"), history=20,
        metric="minimum_combined_clearance", low=1.0, high=4.0, higher=False,
        thresholds={"minimum_moving_speed_mps": 1.0, "maximum_filtering_vehicle_gap_m": 10.0, "maximum_motorcyclist_vehicle_distance_m": 7.0, "minimum_current_separation_m": 1.0},
        parameters={"filtering_speed_mps": (2.0, 10.0), "lateral_offset_m": (-1.5, 1.5), "entry_delay_s": (0.2, 2.0)},
    ),
)

RULES = {rule.skill_id: rule for rule in CATALOG}


def thresholds_table(spark: SparkSession) -> DataFrame:
    rows = [(r.skill_id, n, v, "semantic") for r in RULES.values() for n, v in r.thresholds.items()]
    return spark.createDataFrame(rows, "skill_id string, name string, value double, source string")


def parameters_table(spark: SparkSession) -> DataFrame:
    """(skill, name, low, high, choices, first slot): a range takes one slot, a choice one per option."""
    rows = []
    for r in RULES.values():
        slot = 0
        for n, v in r.parameters.items():
            choice = isinstance(v[0], str)
            rows.append((r.skill_id, n, *((None, None, list(v)) if choice else (v[0], v[1], None)), slot))
            slot += len(v) if choice else 1
    return spark.createDataFrame(rows, "skill_id string, name string, low double, high double, choices array<string>, slot int")
