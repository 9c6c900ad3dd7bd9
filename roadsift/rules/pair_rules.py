"""Two-actor rules as declarations over one shared pair row (a = initiator, b = responder).

A rule is: a structural condition, one measured value per threshold of the rule (the
comparison follows from the threshold's name: ``minimum_`` is a lower bound, everything
else an upper bound), a score, and the seed risk metric with its value.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import pairs as pr
from roadsift.rules.catalog import RULES, Rule

HORIZON = "6.0"


@dataclass
class PairRule:
    needs: set[str]
    where: str
    measured: dict[str, str]
    score: str
    value: str
    metric: str | None = None          # SQL text; None = the rule's target metric
    swap: str = "false"                # whether b is the initiator
    target_lane: str = "CAST(NULL AS STRING)"
    extra: dict[str, str] = field(default_factory=dict)
    early: str = "true"                # part of the condition on the pair row alone: path conflicts are made for no other pairs


def bound_list(rule: Rule, measured: dict[str, str]) -> list[str]:
    return [f"{measured[n]} {'>=' if n.startswith('minimum_') else '<='} {v}" for n, v in rule.thresholds.items()]


def bounds(rule: Rule, measured: dict[str, str]) -> str:
    return " AND ".join(bound_list(rule, measured))


def all_of(parts: list[str], say: Callable[[str], Column] = F.expr) -> Column:
    """The conditions, each parsed for itself, joined by AND in their order."""
    return reduce(lambda x, y: x & y, [say(p) for p in parts])


def any_of(parts: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.expr(p) for p in parts]) if parts else F.lit(True)


def risk(rule: Rule, value: str) -> str:
    return fm.risk_score(value, rule.low, rule.high, rule.higher)


def in_horizon(v: str) -> str:
    return f"coalesce({v} BETWEEN 0 AND {HORIZON}, false)"


def mean(*parts: str) -> str:
    return "(" + " + ".join(f"({p})" for p in parts) + f") / {len(parts)}"


small, large, deg = fm.score_small, fm.score_large, lambda e: f"degrees({e})"


def _longitudinal(rule: Rule) -> PairRule:
    lead, follow = ("b", "a") if rule.skill_id == "rear_vehicle_rapid_approach" else ("a", "b")
    gap, closing, ttc = pr.gap(lead, follow), f"({follow}_speed - {lead}_speed)", pr.pair_ttc(follow, lead)
    where = f"{pr.same_or_successor(lead, follow)} AND {gap} > 0"
    if rule.skill_id == "lead_hard_brake":
        m = {"minimum_deceleration_mps2": "(0 - a_min_accel)", "minimum_closing_speed_mps": closing, "maximum_pair_gap_m": gap}
        return PairRule({"lanes"}, f"{where} AND {ttc} IS NOT NULL", m, mean(large("(0 - a_min_accel)", "2.0"), risk(rule, ttc)), ttc)
    if rule.skill_id == "lead_sudden_stop":
        m = {"stopped_speed_mps": "a_min_speed", "minimum_prior_speed_mps": "a_stop_prior", "minimum_stopped_duration_s": "a_stop_s",
             "maximum_pair_gap_m": gap, "minimum_follower_speed_mps": "b_speed", "minimum_closing_speed_mps": closing, "minimum_pair_gap_m": gap}
        margin = f"({gap} + a_stop_travel - b_speed * a_stop_time_s)"
        cond = mean(large("a_stop_s", "1.0"), small("a_min_speed", "0.500001"))
        return PairRule({"lanes", "stop"}, f"{where} AND {margin} >= 0", m, mean(cond, risk(rule, margin)), margin)
    if rule.skill_id == "slow_lead_blockage":
        m = {"maximum_leader_speed_mps": "a_speed", "minimum_low_speed_duration_s": "a_low_s", "maximum_pair_gap_m": gap,
             "minimum_follower_speed_mps": "b_speed", "minimum_closing_speed_mps": closing, "minimum_pair_gap_m": gap}
        cond = mean(small("a_speed", "2.0"), large("a_low_s", "2.0"))
        return PairRule({"lanes", "low"}, where, m, mean(cond, risk(rule, gap)), gap)
    if rule.skill_id == "short_headway_following":
        way = fm.headway(gap, "b_speed")
        m = {"minimum_follower_speed_mps": "b_speed", "maximum_time_headway_s": way, "minimum_duration_s": "headway_run"}
        return PairRule({"lanes", "headway"}, where, m, risk(rule, way), way)
    m = {"minimum_relative_speed_mps": closing, "maximum_initial_gap_m": gap, "maximum_time_to_collision_s": ttc}
    return PairRule({"lanes"}, where, m, mean(large(closing, "1.0"), risk(rule, ttc)), ttc)


def _cut_in(rule: Rule) -> PairRule:
    final = fm.forward("a_end_x - b_end_x", "a_end_y - b_end_y", "b_end_heading")
    m = {"minimum_lateral_displacement_m": "abs(a_lateral)", "minimum_target_gap_m": final, "maximum_target_gap_m": final}
    where = f"{pr.adjacent('a', 'b')} AND b_lane IS NOT NULL AND end_on_lane_dist <= 5.0 AND {in_horizon('min_ttc')}"
    return PairRule({"lanes", "min_ttc", "end_on_lane"}, where, m, mean(large("abs(a_lateral)", "2.0"), risk(rule, "min_ttc")), "min_ttc")


def _ttc_or(rule: Rule, bound: str, fallback: str) -> tuple[str, str, str]:
    """Observed TTC when inside the horizon, else the minimum distance as a proxy: metric, value, score."""
    seen = in_horizon("min_ttc")
    return (f"CASE WHEN {seen} THEN '{rule.metric}' ELSE '{fallback}' END", f"CASE WHEN {seen} THEN min_ttc ELSE min_dist END",
            f"CASE WHEN {seen} THEN {risk(rule, 'min_ttc')} ELSE {small('min_dist', bound)} END")


def _diverge(rule: Rule) -> PairRule:
    end = "greatest(CAST(0 AS DOUBLE), a_lane_length - a_lane_arc)"
    gap = f"abs({pr.fwd('b', 'a')})"
    base = f"a_diverges AND b_lane IS NOT NULL AND {pr.adjacent('a', 'b')} AND {end} > 0"
    if rule.skill_id == "late_lane_change_before_diverge":
        m = {"maximum_distance_to_diverge_m": end, "maximum_target_gap_m": gap, "minimum_adjacent_lane_length_m": "b_lane_length",
             "minimum_current_separation_m": "dist"}
        return PairRule({"lanes"}, base, m, mean(small(end, "60.0"), small(gap, "20.0")), end, "'distance_to_diverge'")
    m = {"maximum_distance_to_diverge_m": end, "maximum_target_gap_m": gap, "minimum_lateral_displacement_m": "abs(a_lateral)"}
    metric, value, part = _ttc_or(rule, "18.0", "minimum_trajectory_distance")
    where = f"{base} AND a_lane <> b_lane AND a_lateral * {pr.lat('b', 'a')} > 0 AND ({value}) IS NOT NULL"
    return PairRule({"lanes", "min_ttc", "min_dist"}, where, m, f"0.5 + 0.25 * ({small(end, '60.0')}) + 0.25 * ({part})", value, metric)


def _cut_in_brake(rule: Rule) -> PairRule:
    ahead, room = pr.fwd("a", "b"), "greatest(CAST(0 AS DOUBLE), b_lane_length - at_lane_arc)"
    m = {"minimum_target_gap_m": ahead, "maximum_target_gap_m": ahead, "minimum_post_cut_in_braking_distance_m": room}
    metric, value, part = _ttc_or(rule, "18.0", "minimum_trajectory_distance")
    where = f"{pr.adjacent('a', 'b')} AND b_lane IS NOT NULL AND at_lane_dist <= 5.0 AND ({value}) IS NOT NULL"
    return PairRule({"lanes", "min_ttc", "min_dist", "on_lane"}, where, m,
                    f"0.5 + 0.25 * ({large(room, '10.0')}) + 0.25 * ({part})", value, metric)


def arrival(side: str, x: str, y: str) -> str:
    """Seconds to a point at the current speed (NULL when standing)."""
    return f"(CASE WHEN {side}_speed > 1e-6 THEN {fm.norm(f'{x} - {side}_x', f'{y} - {side}_y')} / {side}_speed END)"


def _merge(rule: Rule) -> PairRule:
    if rule.skill_id == "bike_lane_vehicle_merge_conflict":
        slow = f"abs({arrival('a', 'any_x', 'any_y')} - {arrival('b', 'any_x', 'any_y')})"
        late = f"greatest({arrival('a', 'any_x', 'any_y')}, {arrival('b', 'any_x', 'any_y')})"
        value = f"(CASE WHEN time_gap IS NOT NULL THEN time_gap WHEN {late} <= {HORIZON} THEN {slow} END)"
        m = {"maximum_arrival_time_gap_s": value, "maximum_conflict_distance_m": "min_dist"}
        return PairRule({"lanes", "conflict", "min_dist", "any_convergence"}, "true", m, mean(risk(rule, value), small("min_dist", "70.0")), value)
    two = "two_" if rule.skill_id == "lane_drop_merge_competition" else "one_"
    x, y, rel = f"{two}x", f"{two}y", f"{two}relation"
    ta, tb = arrival("a", x, y), arrival("b", x, y)
    gap = f"abs({ta} - {tb})"
    reach = f"greatest({fm.norm(f'{x} - a_x', f'{y} - a_y')}, {fm.norm(f'{x} - b_x', f'{y} - b_y')})"
    swap, decided = merge_swap(two, rule.skill_id == "merge_without_yield")
    where = f"a < b AND {x} IS NOT NULL AND {decided} AND {ta} <= {HORIZON} AND {tb} <= {HORIZON}"
    m = {"maximum_convergence_distance_m": reach, "maximum_arrival_time_gap_s": gap, "maximum_competing_vehicle_gap_m": "dist"}
    if rule.skill_id == "ramp_merge_small_gap":
        where += " AND min_dist <= 6.0"
    return PairRule({"lanes", "min_dist", "convergence"}, where, {n: m[n] for n in rule.thresholds},
                    mean(risk(rule, gap), small("min_dist", "70.0")), gap, swap=swap, target_lane=f"{two}target", extra={"cx": x, "cy": y})


def merge_swap(two: str, allow_tie: bool) -> tuple[str, str]:
    """Who merges: the lane that feeds the other, else the larger heading change into the target."""
    ca, cb = (fm.heading_gap(f"{s}_lane_end_heading", f"{two}heading") for s in "ab")
    tie = f"abs({ca} - {cb}) <= radians(0.5)"
    both = f"{two}relation = 'two_sources'"
    swap = (f"(CASE WHEN {two}relation = 'first_feeds' THEN false WHEN {two}relation = 'second_feeds' THEN true "
            f"WHEN {tie} THEN struct(b_lane, b) < struct(a_lane, a) ELSE {cb} > {ca} END)")
    decided = f"(NOT {both} OR ({ca} IS NOT NULL AND {cb} IS NOT NULL{'' if allow_tie else f' AND NOT ({tie})'}))"
    return swap, decided


def cross_flow(minimum_angle: float, maximum_angle: float, second_speed: float, separation: float) -> str:
    return (f"a_lane <> b_lane AND NOT {pr.same_or_successor('a', 'b')} AND NOT {pr.adjacent('a', 'b')} AND b_speed >= {second_speed} "
            f"AND dist >= {separation} AND {deg(pr.angle('a', 'b'))} BETWEEN {minimum_angle} AND {maximum_angle}")


def _conflict_point(rule: Rule) -> PairRule:
    turn = deg(pr.angle("a", "b"))
    if rule.skill_id == "mutual_yield_deadlock":
        entry = "greatest(a_cross_lane_dist, b_cross_lane_dist)"
        both = "(CASE WHEN a_cross_lane_dist IS NOT NULL AND b_cross_lane_dist IS NOT NULL THEN " + entry + " END)"
        fast = "greatest(a_speed, b_speed)"
        m = {"maximum_entry_distance_m": both, "maximum_creep_speed_mps": fast, "minimum_crossing_angle_deg": turn,
             "maximum_crossing_angle_deg": turn, "minimum_current_separation_m": "dist"}
        where = f"a < b AND {cross_flow(rule['minimum_crossing_angle_deg'], rule['maximum_crossing_angle_deg'], 0.0, rule['minimum_current_separation_m'])}"
        return PairRule({"lanes", "entry"}, where, m, mean(small(fast, str(rule["maximum_creep_speed_mps"])), small(both, str(rule["maximum_entry_distance_m"]))),
                        both, "'maximum_distance_to_intersection_entry'")
    if rule.skill_id == "abrupt_u_turn_conflict":
        ttc = pr.pair_ttc("a", "b")
        m = {"maximum_entry_distance_m": "a_cross_lane_dist", "minimum_moving_speed_mps": "a_speed", "maximum_oncoming_distance_m": "dist",
             "minimum_opposing_heading_difference_deg": turn, "minimum_current_separation_m": "dist"}
        seen = in_horizon(ttc)
        return PairRule({"lanes", "entry"}, "true", m, mean(small("a_cross_lane_dist", "12.0"), large(turn, "120.0")),
                        f"CASE WHEN {seen} THEN {ttc} ELSE dist END", f"CASE WHEN {seen} THEN '{rule.metric}' ELSE 'oncoming_vehicle_distance' END")
    wait = "greatest(CAST(0 AS DOUBLE), tb - b_ref_time)"
    if rule.skill_id == "intersection_creep_conflict":
        m = {"maximum_entry_distance_m": "a_cross_lane_dist", "maximum_creep_speed_mps": "a_speed", "maximum_crossing_arrival_s": wait,
             "minimum_crossing_angle_deg": turn, "maximum_crossing_angle_deg": turn, "minimum_crossing_vehicle_speed_mps": "b_speed",
             "minimum_current_separation_m": "dist"}
        where = f"time_gap IS NOT NULL AND conflict_to_cross <= 6.0 AND {cross_flow(30.0, 150.0, 1.0, 2.0)}"
        score = f"0.5 + 0.25 * ({small('a_cross_lane_dist', '8.0')}) + 0.25 * ({small(wait, '5.0')})"
        return PairRule({"lanes", "entry", "conflict", "conflict_cross"}, where, m, score, "greatest(a_cross_lane_dist, 1e-6)",
                        extra={"cx": "cx", "cy": "cy"}, early=cross_flow(30.0, 150.0, 1.0, 2.0))
    m = {"maximum_arrival_time_gap_s": "time_gap", "maximum_conflict_distance_m": "min_dist"}
    where = "conflict_to_cross <= 6.0"
    if rule.skill_id == "unprotected_left_turn_conflict":
        m |= {"minimum_turn_heading_change_deg": deg("a_turn"), "minimum_opposing_heading_difference_deg": turn}
    elif rule.skill_id == "right_turn_vehicle_conflict":
        m |= {"minimum_turn_heading_change_deg": deg("(0 - a_turn)")}
    else:
        m |= {"minimum_crossing_angle_deg": turn}
        where += " AND a < b"
    early = "a < b" if where.endswith("a < b") else "true"
    return PairRule({"lanes", "conflict", "conflict_cross", "min_dist"}, where, m, mean(risk(rule, "time_gap"), small("min_dist", "6.0")), "time_gap",
                    extra={"cx": "cx", "cy": "cy"}, early=early)


def _occupancy(rule: Rule) -> PairRule:
    turn = deg(pr.angle("a", "b"))
    wait = "greatest(CAST(0 AS DOUBLE), tb - b_ref_time)"
    m = {"maximum_blocker_speed_mps": "a_speed", "maximum_crossing_arrival_s": wait, "minimum_conflict_area_length_m": "a_lane_length",
         "minimum_crossing_angle_deg": turn, "maximum_crossing_angle_deg": turn, "minimum_crossing_vehicle_speed_mps": "b_speed",
         "minimum_current_separation_m": "dist"}
    overlap = f"greatest(CAST(0 AS DOUBLE), least(a_lane_length / greatest(a_speed, 0.1), 5.0) - {wait})"
    early = f"a_in_cross AND a_lane_dist <= 6.0 AND {cross_flow(30.0, 150.0, 1.0, 2.0)}"
    where = f"{early} AND conflict_to_lane <= 6.0 AND {overlap} > 0"
    return PairRule({"lanes", "conflict", "conflict_lane"}, where, m, mean(small("a_speed", "0.5"), risk(rule, overlap)), overlap,
                    "'potential_conflict_area_occupancy_overlap_proxy'", extra={"cx": "cx", "cy": "cy"}, early=early)


def _vru(rule: Rule) -> PairRule:
    turn = deg(pr.angle("a", "b"))
    if rule.skill_id == "roadside_pedestrian_emergence":
        late = "(CASE WHEN b_speed > 1e-6 THEN dist / b_speed END)"
        m = {"maximum_boundary_distance_m": "a_boundary_dist", "maximum_vehicle_arrival_s": late, "maximum_conflict_distance_m": "path_dist"}
        score = f"0.5 + 0.25 * ({small('a_boundary_dist', '8.0')}) + 0.25 * ({small(late, '4.0')})"
        return PairRule({"places", "path"}, f"{pr.fwd('a', 'b')} > 0", m, score, late, "'vehicle_arrival_time_to_boundary_proxy'")
    m = {"maximum_arrival_time_gap_s": "time_gap", "maximum_conflict_distance_m": "min_dist"}
    needs, where = {"places", "conflict", "min_dist"}, "true"
    if rule.skill_id == "crosswalk_pedestrian_crossing":
        m |= {"maximum_crosswalk_distance_m": "a_cross_dist"}
    elif rule.skill_id == "turning_vehicle_crosswalk_conflict":
        m |= {"maximum_crosswalk_distance_m": "a_cross_dist", "minimum_turn_heading_change_deg": deg("abs(b_turn)")}
    else:
        m |= {"minimum_crossing_angle_deg": turn, "maximum_crossing_angle_deg": turn}
        needs = {"conflict", "min_dist"}
    if rule.skill_id == "jaywalking_pedestrian_crossing":
        needs = {"conflict", "min_dist", "conflict_place"}
        m |= {"minimum_crosswalk_clearance_m": "conflict_crosswalk"}
        where = "conflict_in_area"
    return PairRule(needs, where, m, mean(small("min_dist", "6.0"), risk(rule, "time_gap")), "time_gap", extra={"cx": "cx", "cy": "cy"})


def _wrong_way(rule: Rule) -> PairRule:
    ttc = pr.pair_ttc("a", "b")
    m = {"minimum_opposite_heading_difference_deg": deg("a_any_error"), "minimum_moving_speed_mps": "a_speed",
         "minimum_opposite_heading_duration_s": "opposite_run", "maximum_oncoming_distance_m": "dist"}
    path = "(a_any_lane = b_lane OR array_contains(b_pred, a_any_lane) OR array_contains(a_any_succ, b_lane))"
    where = f"{path} AND NOT coalesce(a_in_cross, false) AND b_lane_error <= radians(60) AND {ttc} IS NOT NULL"
    return PairRule({"lanes", "opposite"}, where, m, mean(large("a_any_error", "radians(120)"), risk(rule, ttc)), ttc)


def _static(rule: Rule) -> PairRule:
    late = "(CASE WHEN b_speed > 1e-6 THEN dist / b_speed END)"
    m = {"maximum_object_speed_mps": "a_speed", "maximum_object_path_distance_m": "path_dist", "maximum_vehicle_arrival_s": late}
    return PairRule({"path"}, f"{pr.fwd('a', 'b')} > 0", m, mean(small("path_dist", "8.0"), risk(rule, "path_dist")), "path_dist")


def _blockage(rule: Rule) -> PairRule:
    ahead = pr.fwd("a", "b")
    m = {"maximum_blocker_speed_mps": "a_speed", "maximum_object_path_distance_m": "path_dist", "minimum_blockage_distance_m": ahead,
         "maximum_blockage_distance_m": ahead, "minimum_moving_speed_mps": "b_speed", "minimum_vehicle_center_distance_m": "dist"}
    value = "least(path_dist, coalesce(traffic_dist, path_dist))"
    where = (f"(b_left_id IS NOT NULL OR b_right_id IS NOT NULL) AND (a_object_type NOT IN ('vehicle', 'bus') OR {pr.same_or_successor('a', 'b')})")
    return PairRule({"lanes", "path", "traffic"}, where, m, mean(small("path_dist", "8.0"), risk(rule, value)), value)


def _simultaneous(rule: Rule) -> PairRule:
    gap = f"abs({pr.fwd('a', 'b')})"
    gap_swapped = f"abs({pr.fwd('b', 'a')})"
    swap = "(both_right_left = 'b')"
    along = f"(CASE WHEN {swap} THEN {gap_swapped} ELSE {gap} END)"
    m = {"maximum_longitudinal_gap_m": along, "minimum_shared_target_length_m": "both_length", "minimum_vehicle_center_distance_m": "dist"}
    metric, value, part = _ttc_or(rule, "70.0", "minimum_trajectory_distance")
    where = f"a < b AND both_right_left IS NOT NULL AND both_a_lateral * both_b_lateral < 0 AND NOT {pr.same_or_successor('a', 'b')} AND min_dist IS NOT NULL"
    return PairRule({"lanes", "min_ttc", "min_dist", "both"}, where, m, f"0.5 + 0.25 * ({small(along, '12.0')}) + 0.25 * ({part})", value, metric,
                    swap=swap, target_lane="both_lane")


BUILDERS: dict[str, Callable[[Rule], PairRule]] = {
    "longitudinal_pair": _longitudinal, "lane_change_pair": _cut_in, "diverge_crossing": _diverge, "cut_in_then_brake": _cut_in_brake,
    "merge_pair": _merge, "conflict_point_pair": _conflict_point, "intersection_occupancy": _occupancy, "vru_vehicle_conflict": _vru,
    "wrong_way_pair": _wrong_way, "static_blockage": _static, "blockage_avoidance": _blockage, "simultaneous_lane_change": _simultaneous,
}
NOT_PAIRWISE = {"group_pedestrian_crossing"}


def pair_rules(rules: list[Rule]) -> dict[str, PairRule]:
    return {r.skill_id: BUILDERS[r.strategy](RULES[r.skill_id]) for r in rules
            if r.strategy in BUILDERS and r.skill_id not in NOT_PAIRWISE}
