"""Target risk and trigger conditions where every candidate has a rule of its own.

Rules are rows: calculator, role pairs, target range, conditions and bounds come from the rule's row, none from literals
in a query. Role slots are columns: a, b and c are the first, second and third role of the candidate's rule, wherever the
overlay target stands among them.

* Risk: the rule's role pairs turn each frame into one row a pair; one expression picks the calculator of the row, and one
  aggregation over the candidate gives least value, pair, frame and status for all calculators together. Only crossing
  paths need a join of their own (on grid cells).
* Conditions: one aggregation evaluates every condition with the bounds of the row's rule; a candidate passes when each
  condition that its seed lacks is realised (division of the seed's missing conditions by the realised ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.funnel import conditions as cn, frames as fr, risk as rk
from roadsift.operators import pairs as pr, tracks as tr
from roadsift.rules.catalog import RULES

AB, CA, ABBC, BACC, ABAC = ((0, 1),), ((2, 1),), ((0, 1), (1, 2)), ((1, 0), (0, 2)), ((0, 1), (0, 2))
# Calculator and role pairs (as slots) of each rule that has a target risk.
RISKS = {
    "lead_sudden_stop": ("stopping_margin", AB), "slow_lead_blockage": ("gap", AB), "short_headway_following": ("headway", AB), "chain_braking": ("gap", ABBC),
    "cut_out_reveals_slow_vehicle": ("event_ttc", CA), "simultaneous_lane_change_conflict": ("lateral_ttc", AB), "forced_lane_change_around_blockage": ("clearance", AB),
    "late_lane_change_before_diverge": ("point_ttc", AB), "ramp_merge_small_gap": ("path_gap", AB), "lane_drop_merge_competition": ("path_gap", AB),
    "merge_without_yield": ("path_gap", AB), "diverge_lane_crossing_conflict": ("point_ttc", AB), "bike_lane_vehicle_merge_conflict": ("path_gap", AB),
    "zipper_merge_multi_vehicle": ("path_gap", ABAC), "unprotected_left_turn_conflict": ("path_gap", AB), "right_turn_vehicle_conflict": ("path_gap", AB),
    "crossing_path_conflict": ("path_gap", AB), "intersection_creep_conflict": ("area_margin", AB), "intersection_blocking_vehicle": ("area_overlap", AB),
    "mutual_yield_deadlock": ("path_gap", AB), "crosswalk_pedestrian_crossing": ("path_gap", AB), "jaywalking_pedestrian_crossing": ("path_gap", AB),
    "roadside_pedestrian_emergence": ("area_entry_ttc", AB), "cyclist_crossing": ("path_gap", AB), "turning_vehicle_crosswalk_conflict": ("path_gap", AB),
    "group_pedestrian_crossing": ("path_gap", ((0, 1), (2, 1))), "cyclist_vehicle_merge": ("front_rear_ttc", BACC), "stopped_vehicle_reentry": ("front_rear_ttc", BACC),
    "construction_object_lane_blockage": ("clearance", AB), "static_object_avoidance": ("clearance", AB), "cut_in_then_brake": ("event_ttc", AB),
    "abrupt_u_turn_conflict": ("radial_ttc", AB), "multi_vehicle_gap_squeeze": ("clearance", ABAC), "motorcyclist_filtering_conflict": ("clearance", ABAC),
}
# Rules whose overlay target is the second role; all others overlay the first.
SECOND_ROLE_TARGET = ("short_headway_following", "forced_lane_change_around_blockage", "construction_object_lane_blockage", "static_object_avoidance")
FORMAL = tuple(RISKS)


def rules_table(spark: SparkSession) -> DataFrame:
    """skill_id, mode, metric, calculator, low, high, target_slot, roles, pairs, bounds (thresholds, ``name.low`` and ``name.high`` of parameters, risk_high)."""
    rows = []
    for skill, (calculator, pairs) in RISKS.items():
        r = RULES[skill]
        ranges = {f"{n}.{end}": float(v[i]) for n, v in r.parameters.items() if not isinstance(v[0], str) for i, end in enumerate(("low", "high"))}
        labels = [(p, q, f"{r.roles[p]}->{r.roles[q]}") for p, q in pairs]
        rows.append((skill, r.mode, r.metric, calculator, r.low, r.high, int(skill in SECOND_ROLE_TARGET), list(r.roles), labels, {**{k: float(v) for k, v in r.thresholds.items()}, **ranges, "risk_high": r.high}))
    return spark.createDataFrame(rows, "skill_id string, mode string, metric string, calculator string, low double, high double, target_slot int, roles array<string>, pairs array<struct<p:int,q:int,label:string>>, bounds map<string,double>")


def bound(name: str, default: float) -> str:
    return f"coalesce(bounds['{name}'], {default}D)"


def by_slot(wide: DataFrame, assigned: DataFrame, anchor: int) -> DataFrame:
    """Wide rows (target in a, others in b and c) with the columns of the candidate's rule, roles moved to their slots, steps and anchor states added.

    ``assigned``: candidate_id, skill_id and the rule's columns. Headings that are missing follow the velocity."""
    full = wide.join(assigned, "candidate_id")
    move = {f"{r}_{c}": F.expr(f"IF(target_slot = 1, {o}_{c}, {r}_{c})") for r, o in (("a", "b"), ("b", "a")) for c in fr.STATE}
    full = full.withColumns(move)
    axis = {f"{r}_heading": F.expr(f"coalesce({r}_heading, CASE WHEN {fm.norm(f'{r}_vx', f'{r}_vy')} > {fm.EPS} THEN atan2({r}_vy, {r}_vx) END)") for r in fr.ROLES}
    return fr.anchored(fr.with_steps(full.withColumns(axis)), anchor).withColumn("fut", F.expr(f"timestep > {anchor}"))


# --- conflict point -------------------------------------------------------------------------------------
def lane_crossings(pairs: DataFrame, roads: DataFrame) -> DataFrame:
    """scenario_id, lane_a, lane_b, cx, cy: where the two lines meet (ties by their least distance along). pairs: scenario_id, lane_a, lane_b."""
    pairs = pairs.where("lane_a <> lane_b").distinct().withColumn("key", F.concat_ws("|", "scenario_id", "lane_a", "lane_b"))
    lines = roads.where("polyline_type = 'lane_centerline' AND size(points) > 1").selectExpr("scenario_id", "polyline_id", "inline(transform(sequence(0, size(points) - 2), i -> struct(i AS t, points[i].x AS x1, points[i].y AS y1, points[i + 1].x AS x2, points[i + 1].y AS y2, CAST(i AS DOUBLE) AS s1, CAST(i + 1 AS DOUBLE) AS s2)))")
    side = lambda lane, name: pairs.select("key", "scenario_id", F.col(lane).alias("polyline_id")).join(lines, ["scenario_id", "polyline_id"]).select(F.col("key").alias("scenario_id"), F.lit(name).alias("track_id"), "t", "x1", "y1", "x2", "y2", "s1", "s2")
    return pairs.join(_nearest_crossing(side("lane_a", "a"), side("lane_b", "b")).withColumnRenamed("id", "key"), "key").select("scenario_id", "lane_a", "lane_b", "cx", "cy")


def _nearest_crossing(one: DataFrame, other: DataFrame) -> DataFrame:
    cut = pr.crossing()
    met = pr.close_segments(one, other).withColumns({"u": F.expr(cut["u"]), "v": F.expr(cut["v"])}).where("u IS NOT NULL AND v IS NOT NULL")
    met = met.selectExpr("scenario_id AS id", "a_t", "b_t", "a_s1 + u * (a_s2 - a_s1) AS ta", "b_s1 + v * (b_s2 - b_s1) AS tb", "a_x1 + u * (a_x2 - a_x1) AS cx", "a_y1 + u * (a_y2 - a_y1) AS cy")
    best = met.groupBy("id").agg(F.expr("min(struct(abs(ta - tb) AS gap, greatest(ta, tb) AS late, a_t, b_t, cx, cy))").alias("m"))
    return best.select("id", "m.gap", "m.cx", "m.cy")


def path_crossings(rows: DataFrame, p: str = "a", q: str = "b") -> DataFrame:
    """candidate_id, gap, cx, cy: where the two roles' paths cross with the least time between them."""
    return _nearest_crossing(rk.path_segments(rows, p), rk.path_segments(rows, q)).withColumnRenamed("id", "candidate_id")


def closest_approach(rows: DataFrame, p: str = "a", q: str = "b") -> DataFrame:
    """candidate_id, distance, mx, my: least synchronised distance, both moving evenly between frames, and the middle at that time."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    cols = [f"{r}_{c}" for r in (p, q) for c in "xy"]
    d = rows.selectExpr("candidate_id", "timestep", *cols, f"lead(timestep) {w} AS nt", *[f"lead({c}) {w} AS n_{c}" for c in cols])
    rel = {c: f"({p}_{c} - {q}_{c})" for c in "xy"}
    step = {c: f"((n_{p}_{c} - n_{q}_{c}) - {rel[c]})" for c in "xy"}
    len2 = f"({step['x']} * {step['x']} + {step['y']} * {step['y']})"
    moves = f"coalesce(nt = timestep + 1 AND n_{p}_x IS NOT NULL AND n_{q}_x IS NOT NULL AND {len2} > {fm.EPS}, false)"
    d = d.where(f"{p}_x IS NOT NULL AND {q}_x IS NOT NULL").withColumn("f", F.expr(f"CASE WHEN {moves} THEN {fm.clamp01(f'(0 - ({rel['x']} * {step['x']} + {rel['y']} * {step['y']})) / {len2}')} ELSE 0D END"))
    at = lambda r, c: f"({r}_{c} + f * coalesce(n_{r}_{c} - {r}_{c}, 0D))"
    d = d.selectExpr("candidate_id", "timestep", f"{fm.norm(f'{at(p, 'x')} - {at(q, 'x')}', f'{at(p, 'y')} - {at(q, 'y')}')} AS distance", f"({at(p, 'x')} + {at(q, 'x')}) / 2 AS mx", f"({at(p, 'y')} + {at(q, 'y')}) / 2 AS my")
    return d.groupBy("candidate_id").agg(F.expr("min(struct(distance, timestep, mx, my))").alias("m")).select("candidate_id", "m.distance", "m.mx", "m.my")


def conflict_points(rows: DataFrame, recorded: DataFrame, seeds: DataFrame, roads: DataFrame, crossed: DataFrame | None = None) -> DataFrame:
    """candidate_id, px, py, point_source: the first that exists of the seed's point, the crossing of the seed's two lanes, of the generated
    paths, of the recorded paths, and the middle of the closest approach within reach; ``unavailable`` without any.

    rows, recorded: role rows from the anchor on, generated and recorded. seeds: candidate_id, scenario_id, seed_x, seed_y, lane_a, lane_b.
    crossed: the recorded paths' crossings, where they are known."""
    lanes = lane_crossings(seeds.select("scenario_id", "lane_a", "lane_b"), roads)
    lane = seeds.join(lanes, ["scenario_id", "lane_a", "lane_b"]).selectExpr("candidate_id", "cx AS lane_x", "cy AS lane_y")
    drawn = path_crossings(rows).selectExpr("candidate_id", "cx AS made_x", "cy AS made_y")
    past = (path_crossings(recorded) if crossed is None else crossed).selectExpr("candidate_id", "cx AS source_x", "cy AS source_y")
    near = closest_approach(rows).where(f"distance <= {cn.REACH}").selectExpr("candidate_id", "mx AS near_x", "my AS near_y")
    every = seeds.select("candidate_id", "seed_x", "seed_y")
    for found in (lane, drawn, past, near):
        every = every.join(found.hint("merge"), "candidate_id", "left")
    order = ("seed", "lane", "made", "source", "near")
    names = ("frozen_seed_conflict_point", "frozen_seed_lane_map_intersection", "generated_path_intersection", "source_path_intersection", "generated_closest_approach_proxy")
    return every.selectExpr("candidate_id", *[f"coalesce({', '.join(f'{k}_{c}' for k in order)}) AS p{c}" for c in "xy"],
                            "CASE " + " ".join(f"WHEN {k}_x IS NOT NULL THEN '{n}'" for k, n in zip(order, names)) + " ELSE 'unavailable' END AS point_source")


# --- events ---------------------------------------------------------------------------------------------
#: Deceleration from which a brakes, from the bounds of the row's rule; rows on their way through a shuffle carry it alone.
BRAKES_AT = bound("peak_deceleration_mps2.low", 2.0)


def with_events(rows: DataFrame) -> DataFrame:
    """Adds exposure_frame (lateral departure of a from b), cut_frame, stage_frame (a brakes after its cut-in), inside (is a in the conflict area?) and last_inside."""
    if "brakes_at" not in rows.columns:
        rows = rows.withColumn("brakes_at", F.expr(BRAKES_AT))
    w = Window.partitionBy("candidate_id")
    first = lambda cond: F.min(F.expr(f"CASE WHEN fut AND {cond} THEN timestep END")).over(w)
    rows = rows.withColumns({"exposure_frame": first(f"abs({cn.rel_lat}) >= {cn.LATERAL}"), "cut_frame": first(cn.cut_in), "inside": F.expr(rk.inside_square("a"))})
    rows = rows.withColumn("stage_frame", first(f"timestep >= cut_frame AND a_accel <= -brakes_at"))
    return rows.withColumn("last_inside", F.lag("inside").over(w.orderBy("timestep")))


# --- risk by rule ---------------------------------------------------------------------------------------
def pair_rows(rows: DataFrame, anchor: int) -> DataFrame:
    """One row for each frame and role pair of the candidate's rule: the pair's states as p and q."""
    state = lambda side, c: f"CASE pair.{side} WHEN 0 THEN a_{c} WHEN 1 THEN b_{c} ELSE c_{c} END AS {side}_{c}"
    flat = rows.withColumn("pair", F.explode("pairs"))
    event = "CASE skill_id WHEN 'cut_out_reveals_slow_vehicle' THEN exposure_frame WHEN 'cut_in_then_brake' THEN stage_frame END AS event"
    return flat.selectExpr("candidate_id", "skill_id", "calculator", "pair.label AS label", "timestep", "time_s", "end_s", "fut", "px", "py", "inside", "last_inside", event,
                           *[state(s, c) for s in "pq" for c in fr.STATE])


#: Steps towards the values of one frame and pair; each layer only names columns of the ones before.
LAYERS = (
    {"rx": "q_x - p_x", "ry": "q_y - p_y", "rvx": "q_vx - p_vx", "rvy": "q_vy - p_vy", "hx": "cos(q_heading)", "hy": "sin(q_heading)", "mx": "cos(p_heading) + cos(q_heading)", "my": "sin(p_heading) + sin(q_heading)",
     "left_s": f"end_s - time_s + {fm.EPS}", "nrx": "CASE WHEN nt = timestep + 1 THEN n_q_x - n_p_x END", "nry": "CASE WHEN nt = timestep + 1 THEN n_q_y - n_p_y END"},
    {"gap": "0 - (rx * hx + ry * hy)", "lead_v": "p_vx * hx + p_vy * hy", "own_v": "q_vx * hx + q_vy * hy", "d2": "rx * rx + ry * ry", "v2": "rvx * rvx + rvy * rvy", "lin": "2 * (rx * rvx + ry * rvy)", "mn": "sqrt(mx * mx + my * my)",
     "sx": "coalesce(nrx - rx, 0D)", "sy": "coalesce(nry - ry, 0D)", "full_": "rx IS NOT NULL AND rvx IS NOT NULL"},
    {"disc": "lin * lin - 4 * v2 * d2", "closing": "own_v - lead_v", "ux": f"CASE WHEN mn <= {fm.EPS} THEN cos(p_heading) ELSE mx / mn END", "uy": f"CASE WHEN mn <= {fm.EPS} THEN sin(p_heading) ELSE my / mn END", "dist": "sqrt(d2)", "s2": "sx * sx + sy * sy"},
    {"root": "sqrt(greatest(disc, 0D))", "along": f"CASE WHEN gap <= 0 THEN 0D WHEN closing > {fm.EPS} THEN gap / closing END", "sep": "ry * ux - rx * uy", "sep_v": "rvy * ux - rvx * uy", "radial": f"CASE WHEN dist > {fm.EPS} THEN 0 - (rvx * rx + rvy * ry) / dist END",
     "part": f"CASE WHEN s2 > {fm.EPS} THEN greatest(0D, least(1D, (0 - (rx * sx + ry * sy)) / s2)) ELSE 0D END"},
    {"early": f"CASE WHEN v2 > {fm.EPS} THEN (0 - lin - root) / (2 * v2) END", "late": f"CASE WHEN v2 > {fm.EPS} THEN (0 - lin + root) / (2 * v2) END", "lateral": f"CASE WHEN abs(sep) <= {fm.EPS} THEN 0D WHEN abs(sep_v) > {fm.EPS} AND 0 - sep / sep_v >= 0 THEN 0 - sep / sep_v END",
     "head_on": f"CASE WHEN dist <= {fm.EPS} THEN 0D WHEN radial > {fm.EPS} THEN dist / radial END"},
    {"hit": f"CASE WHEN NOT full_ THEN NULL WHEN d2 <= 0 THEN 0D WHEN v2 <= {fm.EPS} OR disc < -{fm.EPS} THEN NULL WHEN early >= -{fm.EPS} THEN greatest(0D, early) WHEN late >= -{fm.EPS} THEN greatest(0D, late) END"},
)
#: Value of a frame and pair by calculator, and whether it is a sample of it; times beyond the rest of the window don't count.
VALUES = {
    "gap": "gap", "headway": f"CASE WHEN gap <= 0 THEN 0D WHEN own_v > {fm.EPS} THEN gap / own_v END",
    "stopping_margin": f"gap - greatest(0D, (greatest(0D, own_v) * greatest(0D, own_v) - greatest(0D, lead_v) * greatest(0D, lead_v)) / {2 * rk.DECELERATION})",
    "front_rear_ttc": "CASE WHEN along <= left_s THEN along END", "event_ttc": "CASE WHEN timestep >= event AND along <= left_s THEN along END", "point_ttc": "CASE WHEN hit <= left_s THEN hit END",
    "radial_ttc": "CASE WHEN head_on <= left_s THEN head_on END", "lateral_ttc": "CASE WHEN lateral <= left_s THEN lateral END", "clearance": fm.norm("rx + part * sx", "ry + part * sy"), "area_margin": rk.square_distance("p"),
}
SAMPLES = {"headway": "gap IS NOT NULL", "front_rear_ttc": "full_ AND hx IS NOT NULL", "event_ttc": "full_ AND hx IS NOT NULL AND timestep >= event", "point_ttc": "full_", "radial_ttc": "full_", "lateral_ttc": "full_ AND mx IS NOT NULL",
           "area_overlap": "rx IS NOT NULL AND nt IS NOT NULL"}


def risk_by_rule(rows: DataFrame, anchor: int) -> DataFrame:
    """candidate_id, skill_id, status, reason, value, pair, frame: each candidate's target metric by the calculator of its rule.

    rows: role rows (``by_slot``) with px, py and events."""
    flat = pair_rows(rows, anchor)
    w = "OVER (PARTITION BY candidate_id ORDER BY label, timestep)"
    same = lambda c: f"CASE WHEN lead(label) {w} = label THEN lead({c}) {w} END"
    case = lambda d, none: "CASE calculator " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + f" ELSE {none} END"
    seen = flat.selectExpr("*", f"{same('timestep')} AS nt", f"{same('time_s')} AS next_s", *[f"{same(f'{s}_{c}')} AS n_{s}_{c}" for s in "pq" for c in "xy"]).where("fut")
    for layer in LAYERS:
        seen = seen.withColumns({n: F.expr(e) for n, e in layer.items()})
    both = f"{rk.inside_square('p')} AND {rk.inside_square('q')}"
    seen = seen.withColumns({"value": F.expr(case(VALUES, "CAST(NULL AS DOUBLE)")), "sample": F.expr(f"coalesce({case(SAMPLES, 'false')}, false)"), "enters": F.expr("calculator = 'area_entry_ttc' AND inside AND NOT last_inside"),
                             "held": F.expr(f"CASE WHEN {both} THEN next_s - time_s ELSE 0D END")})
    entry = "struct(timestep AS frame, CASE WHEN hit <= left_s THEN hit END AS value, full_ AS seen)"
    got = seen.groupBy("candidate_id", "skill_id", "calculator").agg(
        F.expr("min(struct(value, label, timestep)) FILTER (WHERE value IS NOT NULL)").alias("m"), F.expr("bool_or(sample)").alias("sampled"), F.expr("count(px) > 0").alias("has_point"),
        F.expr("count(event) > 0").alias("has_event"), F.expr("sum(held) FILTER (WHERE sample)").alias("held"), F.expr("min(label)").alias("label"), F.expr(f"min_by({entry}, timestep) FILTER (WHERE enters)").alias("entry"))
    paths = _paths(flat.where("calculator = 'path_gap'"))
    both = got.join(paths.hint("merge"), "candidate_id", "left")
    ttc = "calculator IN ('headway', 'front_rear_ttc', 'event_ttc', 'point_ttc', 'radial_ttc', 'lateral_ttc')"
    value = "CASE calculator WHEN 'path_gap' THEN path.value WHEN 'area_overlap' THEN IF(has_point AND sampled, held, NULL) WHEN 'area_entry_ttc' THEN IF(entry.seen, entry.value, NULL) ELSE m.value END"
    reason = f"""CASE WHEN value IS NOT NULL THEN NULL WHEN calculator LIKE 'area%' AND NOT has_point OR calculator = 'event_ttc' AND NOT has_event THEN 'required_context_missing'
      WHEN calculator = 'path_gap' THEN CASE WHEN path.ambiguous THEN 'non_unique_path_conflict' WHEN path.drawn THEN 'no_unique_path_conflict' ELSE 'insufficient_valid_samples' END
      WHEN calculator = 'area_entry_ttc' THEN CASE WHEN entry IS NULL THEN 'event_not_observed' WHEN entry.seen THEN 'no_predicted_collision' ELSE 'insufficient_valid_samples' END
      WHEN {ttc} AND sampled THEN 'no_predicted_collision' ELSE 'insufficient_valid_samples' END"""
    both = both.withColumn("value", F.expr(value)).withColumn("reason", F.expr(reason))
    status = "CASE WHEN value IS NOT NULL THEN 'computed' WHEN reason IN ('no_predicted_collision', 'no_unique_path_conflict', 'event_not_observed') THEN 'no_event' ELSE 'unavailable' END"
    return both.selectExpr("candidate_id", "skill_id", f"{status} AS status", "reason", "value", "CASE WHEN value IS NULL THEN NULL WHEN calculator = 'path_gap' THEN path.label WHEN calculator = 'area_overlap' THEN label WHEN calculator LIKE 'area%' THEN NULL ELSE m.label END AS pair",
                           "CASE calculator WHEN 'path_gap' THEN NULL WHEN 'area_entry_ttc' THEN entry.frame ELSE m.timestep END AS frame")


def _paths(flat: DataFrame) -> DataFrame:
    """candidate_id, path: least arrival gap over the pairs' crossings, whether pairs without one run along each other, whether both drew a path."""
    keyed = flat.withColumn("candidate", F.col("candidate_id")).withColumn("candidate_id", F.concat_ws("|", "candidate_id", "label"))
    names = keyed.groupBy("candidate_id").agg(F.first("candidate").alias("candidate"), F.first("label").alias("label"), F.expr("count(p_x) > 1 AND count(q_x) > 1").alias("drawn"))
    found = rk.path_gap(keyed.select("candidate_id", "timestep", "time_s", "p_x", "p_y", "q_x", "q_y"), [("p", "q")]).select("candidate_id", "value", F.expr("status = 'unavailable'").alias("ambiguous"))
    g = names.join(found, "candidate_id").groupBy(F.col("candidate").alias("candidate_id")).agg(F.expr("min(struct(value, label)) FILTER (WHERE value IS NOT NULL)").alias("m"), F.expr("bool_or(ambiguous)").alias("ambiguous"), F.expr("bool_or(drawn)").alias("drawn"))
    return g.select("candidate_id", F.expr("struct(m.value AS value, m.label AS label, ambiguous, drawn)").alias("path"))


def target_check(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the rule's metric and the rejection: no value, or one out of the rule's range."""
    return evaluated.join(F.broadcast(rules.select("skill_id", "metric", "low", "high")), "skill_id").withColumn(
        "rejection", F.expr("CASE WHEN value IS NULL THEN 'risk_metric_unavailable' WHEN value NOT BETWEEN low AND high THEN 'risk_out_of_target_range' END")).drop("low", "high")


# --- conditions by rule ---------------------------------------------------------------------------------
ONE, SOME = "a", "b"


def structural(*aliases: str, fields: tuple[str, ...] = ()) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    return ("structural", aliases, fields)


# Conditions of each rule that needs generation; what the seed may show (names, fields), else how the overlay is evaluated.
CONDITIONS = {
    "chain_braking": {"three_vehicle_queue": structural("three_vehicle_queue"), "leader_decelerating": "leader_decelerating", "delayed_braking_response": "delayed_braking_response"},
    "cut_out_reveals_slow_vehicle": {"three_vehicle_queue": structural("three_vehicle_queue"), "lead_vehicle_cuts_out": "cuts_out", "newly_exposed_slow_vehicle": "newly_exposed"},
    "simultaneous_lane_change_conflict": {"shared_target_lane": "shared_target_lane", "overlapping_lane_change_window": "overlapping_windows", "close_longitudinal_position": "close_longitudinal"},
    "forced_lane_change_around_blockage": {"blockage_ahead": "blockage_ahead", "adjacent_lane_available": "adjacent_lane_realised", "approach_to_safety_buffer": "approach_to_buffer"},
    "late_lane_change_before_diverge": {"diverging_topology": structural("diverging_topology", fields=("initiator_lane_diverges", "distance_to_diverge_m")), "late_lateral_crossing": "late_lateral_crossing", "conflicting_vehicle_present": "conflicting_vehicle"},
    "lane_drop_merge_competition": {"lane_successors_converge": structural("lane_successors_converge", fields=("lanes_converge", "convergence_target_lane_id")), "competing_arrival": "competing_arrival", "insufficient_gap": "competing_arrival"},
    "merge_without_yield": {"converging_lanes": structural("converging_lanes", fields=("lanes_converge", "convergence_target_lane_id")), "explicit_priority_role": structural("priority_roles_assignable", fields=("role_assignment_basis", "counterfactual_priority_required")), "yielding_actor_continues": "yielding_continues"},
    "diverge_lane_crossing_conflict": {"diverging_topology": structural("diverging_topology", fields=("initiator_lane_diverges", "distance_to_diverge_m")), "late_lateral_crossing": "late_lateral_crossing", "conflicting_vehicle_present": "conflicting_vehicle"},
    "zipper_merge_multi_vehicle": {"converging_lanes": structural("converging_lanes", fields=("convergence_target_lane_id", "conflict_point_xy")), "competing_vehicles_present": structural("competing_vehicles_present", fields=("leading_arrival_time_s", "trailing_arrival_time_s")), "delayed_entry": "delayed_merge"},
    "intersection_creep_conflict": {"near_intersection_entry": structural("near_intersection_entry", fields=("intersection_entry_distance_m", "conflict_point_xy")), "sustained_creep_speed": "sustained_creep", "crossing_vehicle_present": structural("crossing_vehicle_present", "crossing_flow_present", fields=("crossing_vehicle_arrival_s",))},
    "intersection_blocking_vehicle": {"inside_conflict_area": "inside_area", "sustained_low_speed_or_stop": "sustained_blocking", "crossing_flow_approaches": "flow_approaches"},
    "mutual_yield_deadlock": {"shared_conflict_point": structural("crossing_flow_present", fields=("conflict_point_xy", "crossing_angle_deg")), "sustained_low_speed_or_stop": "sustained_yield", "delayed_entry": "delayed_conflict_entry"},
    "roadside_pedestrian_emergence": {"pedestrian_near_drivable_boundary": structural("pedestrian_near_drivable_boundary", fields=("drivable_boundary_distance_m",)), "delayed_entry": "delayed_pedestrian", "vehicle_approaching": "approaches_conflict"},
    "stopped_vehicle_reentry": {"previously_stopped": "previously_stopped", "begins_moving": "begins_moving", "enters_main_flow": "enters_main_flow"},
    "construction_object_lane_blockage": {"construction_actor_near_path": structural("construction_actor_near_path", fields=("minimum_object_path_clearance_m",)), "vehicle_approaching": "vehicle_approaching", "safety_buffer_violation_predicted": "buffer_intrusion"},
    "static_object_avoidance": {"static_actor_near_path": structural("static_actor_near_path", fields=("minimum_object_path_clearance_m",)), "predicted_buffer_intrusion": "buffer_intrusion", "response_space_available": structural("response_space_available")},
    "cut_in_then_brake": {"adjacent_vehicle_cuts_in": "cuts_in", "short_post_cut_in_delay": "short_delay", "initiator_brakes": "initiator_brakes"},
    "abrupt_u_turn_conflict": {"turning_vehicle": "turning", "oncoming_vehicle_present": structural("oncoming_vehicle_present", fields=("actor_heading_difference_deg",)), "vehicle_path_conflict": "path_conflict"},
    "multi_vehicle_gap_squeeze": {"front_gap_small": "front_gap", "rear_gap_small": "rear_gap", "multi_direction_gap_closing": "gap_closing"},
    "motorcyclist_filtering_conflict": {"motorcyclist_between_vehicles": "between_vehicles", "positive_relative_speed": "relative_speed", "safety_buffer_violation_predicted": "both_buffers"},
}


def conditions_table(spark: SparkSession) -> DataFrame:
    """skill_id, condition, evaluator, aliases, fields."""
    rows = [(s, c, e if isinstance(e, str) else "structural", list(e[1]) if isinstance(e, tuple) else [], list(e[2]) if isinstance(e, tuple) else []) for s, cs in CONDITIONS.items() for c, e in cs.items()]
    return spark.createDataFrame(rows, "skill_id string, condition string, evaluator string, aliases array<string>, fields array<string>")


def _evaluators() -> dict[str, tuple[dict[str, str], str]]:
    """Aggregates over a candidate's role rows and the verdict over them; bounds are those of the row's rule."""
    b, first, low, high, reach, far = bound, cn.first, cn.low, cn.high, cn.REACH, cn.PROGRESS
    arrive = lambda r: f"min_by(time_s, {cn.to_point(r)}) FILTER (WHERE fut AND {cn.to_point(r)} IS NOT NULL)"
    start = lambda e: f"max({e}) FILTER (WHERE NOT fut)"
    expose = lambda e: f"max({e}) FILTER (WHERE timestep = exposure_frame)"
    brake = lambda r, least: first(f"{r}_accel <= -({least})")
    peak = b("peak_deceleration_mps2.low", 2.0)
    wait = f"least({b('first_wait_duration_s.low', 1.0)}, {b('second_wait_duration_s.low', 1.0)})"
    gap = f"coalesce(bounds['maximum_target_gap_m'], bounds['maximum_competing_vehicle_gap_m'], 20D)"
    upper = "bounds['risk_high']"
    side = fm.left("a_x - b_x", "a_y - b_y", "b_heading")
    between = f"{cn.dist('b', 'c')} > 1e-9 AND {cn.between} BETWEEN 0 AND 1 AND {cn.beside} <= {b('maximum_motorcyclist_vehicle_distance_m', 7.0)}"
    return {
        "leader_decelerating": ({"v": low("a_accel")}, f"v <= -{peak}"),
        "delayed_braking_response": ({"fa": brake("a", peak), "fb": brake("b", f"least(1D, {peak} / 2)"), "fc": brake("c", f"least(1D, {peak} / 2)")},
                                     f"fa < fb AND fb < fc AND (fb - fa) * 0.1 >= {b('propagation_delay_s.low', 0.2)} - 1e-9 AND (fc - fb) * 0.1 >= {b('propagation_delay_s.low', 0.2)} - 1e-9"),
        "cuts_out": ({"f": "max(exposure_frame)"}, "f IS NOT NULL"),
        "newly_exposed": ({"g": expose(rk.gap("c", "b")), "l": expose(f"abs({side})"), "s": expose(fm.norm("c_vx", "c_vy"))}, f"g > 0 AND l >= {cn.LATERAL} AND s <= {b('maximum_slow_vehicle_speed_mps', 2.0)}"),
        "overlapping_windows": ({"fa": first(f"abs({cn.own('a')}) >= {cn.LATERAL}"), "fb": first(f"abs({cn.own('b')}) >= {cn.LATERAL}")}, "fa IS NOT NULL AND fb IS NOT NULL"),
        "close_longitudinal": ({"v": low(f"abs({fm.forward('b_x - a_x', 'b_y - a_y', 'oa_heading')})")}, f"v <= {b('maximum_longitudinal_gap_m', 12.0)}"),
        "blockage_ahead": ({"g": start(fm.forward("a_x - b_x", "a_y - b_y", "b_heading")), "s": start(fm.norm("a_vx", "a_vy"))}, f"array_contains(matched, 'blockage_ahead') AND g > 0 AND g <= {b('maximum_blockage_distance_m', 35.0)} AND s <= {b('maximum_blocker_speed_mps', 0.5)}"),
        "approach_to_buffer": ({"o": start(cn.dist("a", "b")), "v": low(cn.dist("a", "b"))}, f"o - v >= {far} AND v <= {upper}"),
        "late_lateral_crossing": ({"v": high(f"abs({cn.own('a')})")}, f"v >= {b('minimum_lateral_displacement_m', cn.LATERAL)}"),
        "conflicting_vehicle": ({}, f"near_ab <= {gap}"),
        "competing_arrival": ({"ta": arrive("a"), "tb": arrive("b"), "da": low(cn.to_point("a")), "db": low(cn.to_point("b"))}, f"da <= {reach} AND db <= {reach} AND abs(ta - tb) <= {upper}"),
        "yielding_continues": ({"o": start(cn.to_point("a")), "v": low(cn.to_point("a")), "s": "median(CASE WHEN fut THEN a_speed END)"}, f"o - v >= {far} AND s >= 0.5"),
        "delayed_merge": ({"ta": arrive("a"), "tb": arrive("b"), "tc": arrive("c"), "da": low(cn.to_point("a")), "t0": "min(time_s)"}, f"da <= {reach} AND ta - t0 >= 0.5 - 1e-9 AND least(abs(ta - tb), abs(ta - tc)) <= {b('maximum_arrival_time_gap_s', 5.0)}"),
        "sustained_creep": ({}, "creep_s >= 0.5 - 1e-9"),
        "inside_area": ({"n": "count(*) FILTER (WHERE fut AND inside)"}, "n > 0"),
        "sustained_blocking": ({}, f"block_s >= {b('hold_duration_s.low', 1.0)} - 1e-9"),
        "flow_approaches": ({"o": start(cn.to_point("b")), "v": low(cn.to_point("b"))}, f"o - v >= {far}"),
        "sustained_yield": ({}, f"yield_a_s >= {wait} - 1e-9 AND yield_b_s >= {wait} - 1e-9"),
        "delayed_conflict_entry": ({"ea": f"min(time_s) FILTER (WHERE fut AND {cn.to_point('a')} <= {cn.HALF})", "eb": f"min(time_s) FILTER (WHERE fut AND {cn.to_point('b')} <= {cn.HALF})", "t0": "min(time_s)", "n": "count(px)"},
                                   f"n > 0 AND (ea IS NULL OR ea - t0 >= {wait} - 1e-9) AND (eb IS NULL OR eb - t0 >= {wait} - 1e-9)"),
        "delayed_pedestrian": ({"e": "min(time_s) FILTER (WHERE fut AND inside AND NOT last_inside)", "t0": "min(time_s)"}, f"e - t0 >= {b('emergence_start_s.low', 1.0)} - 1e-9"),
        "approaches_conflict": ({"o": start(cn.to_point("b")), "v": low(cn.to_point("b"))}, f"o - v >= {far} AND v <= {b('maximum_conflict_distance_m', reach)}"),
        "previously_stopped": ({}, f"past_speed <= {b('stopped_speed_mps', 0.5)}"),
        "begins_moving": ({"v": high("a_speed")}, f"v >= {b('minimum_moving_speed_mps', 1.0)}"),
        "enters_main_flow": ({"f": first(f"{cn.main_len} > 1e-9 AND {cn.main_pos} BETWEEN 0 AND {cn.main_len} AND {cn.main_side} <= {b('maximum_lateral_reentry_distance_m', 5.0)}")}, "f IS NOT NULL"),
        "vehicle_approaching": ({"o": start(cn.dist("a", "b")), "v": low(cn.dist("a", "b"))}, f"o - v >= {far}"),
        "buffer_intrusion": ({}, f"near_ab <= {upper}"),
        "cuts_in": ({"f": "max(cut_frame)"}, "f IS NOT NULL"),
        "initiator_brakes": ({"f": "max(stage_frame)"}, "f IS NOT NULL"),
        "short_delay": ({"c": "max(cut_frame)", "f": "max(stage_frame)"}, f"(f - c) * 0.1 BETWEEN {b('brake_delay_after_cut_in_s.low', 0.2)} - 1e-9 AND {b('brake_delay_after_cut_in_s.high', 1.5)} + 1e-9"),
        "turning": ({"v": high(f"degrees({fm.heading_gap('a_heading', 'oa_heading')})")}, f"v >= {b('minimum_opposing_heading_difference_deg', 120.0)}"),
        "path_conflict": ({}, f"path_met OR near_ab <= {reach}"),
        "front_gap": ({"v": f"min({cn.squeeze('b')}) FILTER (WHERE fut AND {cn.squeeze('b')} > 0)"}, f"v <= {b('maximum_front_gap_m', 25.0)}"),
        "rear_gap": ({"v": f"min(0 - {cn.squeeze('c')}) FILTER (WHERE fut AND {cn.squeeze('c')} < 0)"}, f"v <= {b('maximum_rear_gap_m', 25.0)}"),
        "gap_closing": ({"u": start(cn.squeeze("b")), "r": start(f"0 - {cn.squeeze('c')}"), "v": low(cn.squeeze("b")), "w": low(f"0 - {cn.squeeze('c')}"), "h": "max(time_s) - min(time_s)"},
                        f"v < u AND w < r AND (u - v + r - w) / h >= {b('minimum_combined_closing_speed_mps', 0.5)} - 1e-9"),
        "between_vehicles": ({"f": first(between)}, "f IS NOT NULL"),
        "relative_speed": ({"m": "avg(CASE WHEN fut THEN a_speed END)", "p": "avg(CASE WHEN fut THEN b_speed END)", "q": "avg(CASE WHEN fut THEN c_speed END)"}, "m - (p + q) / 2 > 0"),
        "both_buffers": ({}, f"least(near_ab, near_ac) <= {upper}"),
        "shared_target_lane": ({}, "lane_shared"),
        "adjacent_lane_realised": ({}, "lane_realised"),
    }


EVALUATORS = _evaluators()


def _longest(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Longest stretch of future frames (last minus first time) in which the flag holds."""
    runs = tr.longest_run(rows.where("fut"), ["candidate_id"], flag)
    return runs.select("candidate_id", F.expr("span * 0.1D").alias(name))


def verdicts(rows: DataFrame, seeds: DataFrame, lane_facts: DataFrame, past_speed: DataFrame) -> DataFrame:
    """candidate_id, skill_id, missing, matched, fields, realised (map of evaluators to verdicts): all evaluators with the bounds of the candidate's rule.

    lane_facts: candidate_id, lane_shared, lane_realised; past_speed: candidate_id, past_speed."""
    aggs = [F.expr(e).alias(f"v{i}_{k}") for i, (parts, _) in enumerate(EVALUATORS.values()) for k, e in parts.items()]
    g = rows.groupBy("candidate_id", "skill_id").agg(F.first("bounds").alias("bounds"), *aggs)
    only = lambda *names: rows.where(F.col("skill_id").isin([s for s, cs in CONDITIONS.items() if set(names) & {e for e in cs.values() if isinstance(e, str)}]))
    near = lambda q: closest_approach(rows, "a", q).select("candidate_id", F.col("distance").alias(f"near_a{q}"))
    creep = f"a_speed BETWEEN {bound('creep_speed_mps.low', 0.3)} AND {bound('maximum_creep_speed_mps', 2.0)}"
    still = f"a_speed <= {bound('maximum_blocker_speed_mps', 0.5)} AND inside"
    slow = lambda r: f"{r}_speed <= {bound('maximum_creep_speed_mps', 3.0)}"
    facts = [near("b"), near("c"), _longest(only("sustained_creep"), creep, "creep_s"), _longest(only("sustained_blocking"), still, "block_s"),
             _longest(only("sustained_yield"), slow("a"), "yield_a_s"), _longest(only("sustained_yield"), slow("b"), "yield_b_s"),
             path_crossings(only("path_conflict")).select("candidate_id", F.lit(True).alias("path_met")), lane_facts, past_speed, seeds.select("candidate_id", "matched", "fields", "missing")]
    for f in facts:  # merged, all by candidate: as broadcasts the facts would lie in the driver together
        g = g.join(f.hint("merge"), "candidate_id", "left")
    realised = ", ".join(f"'{n}', coalesce({cn._prefixed(verdict, parts, f'v{i}_') if parts else verdict}, false)" for i, (n, (parts, verdict)) in enumerate(EVALUATORS.items()))
    return g.selectExpr("candidate_id", "skill_id", "missing", "matched", "fields", f"map({realised}) AS realised")


def trigger_check(found: DataFrame, conditions: DataFrame) -> DataFrame:
    """candidate_id, skill_id, failed (missing conditions that aren't realised, in order), reason: division of the missing conditions by the realised ones."""
    per = F.broadcast(conditions.groupBy("skill_id").agg(F.map_from_entries(F.collect_list(F.struct("condition", F.struct("evaluator", "aliases", "fields")))).alias("known")))
    d = found.join(per, "skill_id").withColumn("missing", F.coalesce("missing", F.expr("CAST(array() AS array<string>)")))
    holds = "CASE WHEN k IS NULL THEN false WHEN k.evaluator = 'structural' THEN arrays_overlap(matched, k.aliases) OR arrays_overlap(fields, k.fields) ELSE realised[k.evaluator] END"
    d = d.withColumn("failed", F.expr(f"array_sort(filter(missing, c -> NOT coalesce(transform(array(known[c]), k -> {holds})[0], false)))"))
    return d.selectExpr("candidate_id", "skill_id", "array_join(failed, ',') AS failed", "CASE WHEN size(missing) = 0 OR size(array_distinct(missing)) < size(missing) OR size(failed) > 0 THEN 'skill_trigger_not_realized' END AS reason")
