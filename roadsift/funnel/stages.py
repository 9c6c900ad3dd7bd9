"""Filter stages: each takes candidates and returns one row per candidate with a reason (NULL = passed)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.funnel import frames as fr, risk as rk
from roadsift.operators import lanes as ln
from roadsift.operators.frames import future_kinematics

# Length and width in m of the class boxes.
FOOTPRINTS = {"vehicle": (4.8, 2.0), "bus": (12.0, 2.6), "pedestrian": (0.8, 0.8), "cyclist": (2.0, 0.8), "motorcyclist": (2.2, 0.9), "static": (1.0, 1.0),
              "construction": (1.0, 1.0), "background": (4.8, 2.0), "riderless_bicycle": (2.0, 0.8), "unknown": (4.8, 2.0)}
# Seam speed, speed, acceleration, deceleration, jerk, curvature, heading rate, minimum heading speed.
LIMITS = {"vehicle": (55.0, 55.0, 8.0, 12.0, 60.0, 0.25, 1.5, 0.5), "bus": (40.0, 40.0, 5.0, 8.0, 40.0, 0.20, 1.0, 0.5),
          "motorcyclist": (55.0, 55.0, 10.0, 14.0, 80.0, 0.50, 2.5, 0.5), "cyclist": (20.0, 20.0, 6.0, 8.0, 50.0, 0.80, 3.0, 0.3),
          "pedestrian": (8.0, 8.0, 5.0, 5.0, 40.0, 2.00, 4.0, 0.2)}
LIMIT_NAMES = ("seam_speed", "speed", "acceleration", "deceleration", "jerk", "curvature", "heading_rate")
# Actor types bound to roads, least share inside, least lane share, lane distance, heading error.
ROAD_TYPES, INSIDE, ASSIGNED, LANE_M, ANGLE_DEG = ("vehicle", "bus", "motorcyclist", "cyclist"), 0.95, 0.80, 6.0, 90.0
DIRECTION_EXEMPT = ("abrupt_u_turn_conflict", "wrong_way_vehicle")
# Parameter tolerances by unit.
TOLERANCES = {"seconds": 0.5, "meters": 1.0, "meters_per_second": 0.75, "meters_per_second_squared": 1.0, "degrees": 10.0, "scale": 0.15}
TYPES_SQL = ", ".join(f"'{t}'" for t in ROAD_TYPES)


def _by_type(table: dict, i: int, column: str = "object_type") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN {v[i]}D" for t, v in table.items()) + " END"


def schema_finite(candidates: DataFrame, states: DataFrame, anchor: int, steps: int) -> DataFrame:
    g = candidates.groupBy("candidate_id", "scenario_id", "a").agg(F.count_distinct("timestep").alias("n"), F.expr("count_if(x IS NULL OR y IS NULL OR isnan(x) OR isnan(y))").alias("bad"))
    at = states.where(f"timestep = {anchor}").selectExpr("scenario_id", "track_id AS a", "observed", "x IS NOT NULL AND y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AS finite")
    return g.join(at, ["scenario_id", "a"], "left").selectExpr("candidate_id", (
        f"CASE WHEN n <> {steps} THEN 'invalid_future_shape' WHEN observed IS NULL THEN 'target_track_missing' WHEN NOT observed THEN 'target_anchor_not_observed' "
        "WHEN NOT finite THEN 'non_finite_target_anchor' WHEN bad > 0 THEN 'non_finite_generated_positions' END AS reason"))


def history_changes(source: DataFrame, generated: DataFrame, keys: list[str], target: str, anchor: int) -> DataFrame:
    """Rows that differ although only the target's future may: null-safe full outer comparison."""
    cols = ["x", "y", "vx", "vy", "heading", "observed"]
    g = generated.select(*keys, "timestep", *[F.col(c).alias(f"g_{c}") for c in cols], F.lit(True).alias("in_g"))
    s = source.select(*keys, "timestep", *cols, F.lit(True).alias("in_s"))
    same = " AND ".join(f"({c} <=> g_{c})" for c in cols)
    return s.join(g, [*keys, "timestep"], "full_outer").where(f"NOT (coalesce(in_s, false) AND coalesce(in_g, false) AND {same})").withColumn(
        "allowed", F.expr(f"{target} AND timestep > {anchor}"))


def history_stage(candidates: DataFrame, states: DataFrame, anchor: int) -> DataFrame:
    """Only the target's future may differ from the record; a candidate has one target.

    A candidate stores the frames it sets (of its target ``a``, or of the track in a column track_id); all others are the record's own.
    """
    own = candidates if "track_id" in candidates.columns else candidates.withColumn("track_id", F.col("a"))
    cols = [c for c in ("x", "y", "vx", "vy", "heading", "observed") if c in candidates.columns]
    source = states.select("scenario_id", "track_id", "timestep", *[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("in_s"))
    fixed = own.where(f"NOT (track_id <=> a AND timestep > {anchor})").join(source, ["scenario_id", "track_id", "timestep"], "left")
    same = " AND ".join(["coalesce(in_s, false)", *[f"({c} <=> s_{c})" for c in cols]])
    changed = fixed.where(f"NOT ({same})").select("candidate_id").distinct().withColumn("changed", F.lit(True))
    targets = candidates.groupBy("candidate_id").agg(F.expr("min(struct(scenario_id, a)) <=> max(struct(scenario_id, a))").alias("one"))
    return targets.join(changed, "candidate_id", "left").selectExpr("candidate_id", "IF(changed OR NOT one, 'history_changed', NULL) AS reason")


def kinematics(overlay_source: DataFrame, kinds: DataFrame) -> DataFrame:
    """Maxima of the candidate's motion against the limits of its class (relative tolerance 1e-9)."""
    joined = overlay_source.join(kinds, "candidate_id")
    k = future_kinematics(joined.withColumn("min_v", F.expr(f"coalesce({_by_type(LIMITS, 7)}, 0.5D)")), "candidate_id", "min_v")
    w = Window.partitionBy("candidate_id")
    first = F.min("timestep").over(w)
    k = k.withColumn("first_t", first)
    top = k.groupBy("candidate_id").agg(
        F.expr("max(speed) FILTER (WHERE timestep = first_t)").alias("seam_speed"), F.max("speed").alias("speed"), F.expr("max(greatest(tangential, CAST(0 AS DOUBLE)))").alias("acceleration"),
        F.max("deceleration").alias("deceleration"), F.max("jerk").alias("jerk"), F.max("curvature").alias("curvature"), F.max("heading_rate").alias("heading_rate"))
    t = kinds.join(top, "candidate_id", "left")
    over = " ".join(f"WHEN {n} > ({_by_type(LIMITS, i)}) * (1 + 1e-9) + 1e-9 THEN '{n}_limit_exceeded'" for i, n in enumerate(LIMIT_NAMES))
    return t.selectExpr("candidate_id", f"CASE WHEN object_type NOT IN ({', '.join(repr(k) for k in LIMITS)}) THEN 'unsupported_actor_type' {over} END AS reason", *LIMIT_NAMES)


def drivable(points: DataFrame, polylines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Share of the future inside any drivable area (boundary counts)."""
    area = polylines.where("polyline_type = 'drivable_area'")
    inside = ln.points_in_areas(points, area, ["candidate_id", "timestep"], include_boundary=True, minimum_vertices=3).groupBy("candidate_id").agg(F.count("*").alias("n_in"))
    n = points.groupBy("candidate_id").agg(F.count("*").alias("n"))
    share = kinds.join(n, "candidate_id").join(inside, "candidate_id", "left").withColumn("fraction", F.expr("coalesce(n_in, 0) / n"))
    return share.selectExpr("candidate_id", f"CASE WHEN object_type IN ({TYPES_SQL}) AND fraction < {INSIDE} THEN 'outside_drivable_area' END AS reason", "fraction")


def lane_compliance(points: DataFrame, polylines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Lane share, lane type, transitions and direction of the future points (scenario_id, candidate_id, timestep, px, py, heading).

    Skills that turn round or drive the wrong way are exempt from the direction; ``kinds`` may have their skill_id.
    """
    kinds = kinds if "skill_id" in kinds.columns else kinds.withColumn("skill_id", F.lit(None).cast("string"))
    segs = ln.segments(polylines.where("polyline_type = 'lane_centerline'")).where("NOT broken")
    best = ln.nearest_per_line(points.select("scenario_id", "candidate_id", "timestep", "px", "py"), segs, ["candidate_id", "timestep"], LANE_M).groupBy("scenario_id", "candidate_id", "timestep").agg(
        F.min(F.struct("distance", "polyline_id", "lane_heading")).alias("m")).selectExpr("scenario_id", "candidate_id", "timestep", "m.polyline_id AS lane", "m.lane_heading AS lane_heading")
    lane_type = polylines.where("polyline_type = 'lane_centerline'").selectExpr("scenario_id", "polyline_id AS lane", "lower(trim(direction)) AS lane_type")
    j = points.join(best, ["scenario_id", "candidate_id", "timestep"], "left").join(lane_type, ["scenario_id", "lane"], "left").join(kinds, "candidate_id")
    car = "object_type IN ('vehicle', 'bus')"
    g = j.groupBy("candidate_id", "object_type", "skill_id").agg(
        F.expr("avg(IF(lane IS NULL, 0D, 1D))").alias("assigned"), F.expr(f"avg(IF({car}, IF(lane_type = 'bike', 0D, 1D), NULL)) FILTER (WHERE lane IS NOT NULL)").alias("typed"),
        F.expr(f"avg(IF(degrees({fm.heading_gap('heading', 'lane_heading')}) <= {ANGLE_DEG}, 1D, 0D)) FILTER (WHERE lane IS NOT NULL AND heading IS NOT NULL AND lane_heading IS NOT NULL)").alias("aligned"))
    bad = ln.forbidden_transitions(ln.transitions(best, ["scenario_id", "candidate_id"]), polylines).groupBy("candidate_id").agg(F.count("*").alias("breaks"))
    road = f"object_type IN ({TYPES_SQL})"
    exempt = f"coalesce(skill_id IN ({', '.join(repr(s) for s in DIRECTION_EXEMPT)}), false)"
    turn = f"WHEN {road} AND NOT {exempt} AND coalesce(aligned, 0D) < {ASSIGNED} THEN 'lane_direction_violation'"
    return g.join(bad, "candidate_id", "left").selectExpr("candidate_id", f"CASE WHEN {road} AND assigned < {ASSIGNED} THEN 'lane_assignment_insufficient' WHEN {road} AND typed < {ASSIGNED} THEN 'lane_type_incompatible' "
                                                          f"WHEN breaks > 0 THEN 'lane_connectivity_violation' {turn} END AS reason", "assigned")


def map_stage(points: DataFrame, polylines: DataFrame, kinds: DataFrame) -> DataFrame:
    a = drivable(points, polylines, kinds).selectExpr("candidate_id", "reason AS r1")
    b = lane_compliance(points, polylines, kinds).selectExpr("candidate_id", "reason AS r2")
    return a.join(b, "candidate_id", "left").selectExpr("candidate_id", "coalesce(r1, r2) AS reason")


def boxes_overlap(p: str = "p", q: str = "q") -> str:
    """Separating-axis test of two oriented boxes; touching counts as overlap."""
    dx, dy = f"({q}_x - {p}_x)", f"({q}_y - {p}_y)"
    tests = []
    for r in (p, q):
        for ax, ay in ((f"cos({r}_heading)", f"sin({r}_heading)"), (f"(0 - sin({r}_heading))", f"cos({r}_heading)")):
            reach = " + ".join(f"{s}_{d} / 2 * abs({ex} * {ax} + {ey} * {ay})" for s in (p, q) for d, ex, ey in
                               (("len", f"cos({s}_heading)", f"sin({s}_heading)"), ("wid", f"(0 - sin({s}_heading))", f"cos({s}_heading)")))
            tests.append(f"abs({dx} * {ax} + {dy} * {ay}) <= {reach}")
    return "(" + " AND ".join(tests) + ")"


def contacts(overlay: DataFrame, tasks: DataFrame, states: DataFrame, anchor: int) -> DataFrame:
    """First box contact with each other track; far pairs drop out through a grid on the frame positions."""
    from roadsift.operators.grid import CELL, box_cells, point_cell
    size = 20.0
    p = overlay.where(f"timestep > {anchor}").join(tasks.select("candidate_id", "scenario_id", "a", "object_type"), "candidate_id").selectExpr(
        "candidate_id", "scenario_id", "a", "timestep", "x AS p_x", "y AS p_y", "heading AS p_heading", f"{_by_type(FOOTPRINTS, 0)} AS p_len", f"{_by_type(FOOTPRINTS, 1)} AS p_wid")
    q = states.where(f"timestep > {anchor} AND x IS NOT NULL AND heading IS NOT NULL").selectExpr(
        "scenario_id", "track_id AS other", "timestep", "x AS q_x", "y AS q_y", "heading AS q_heading", f"{_by_type(FOOTPRINTS, 0)} AS q_len", f"{_by_type(FOOTPRINTS, 1)} AS q_wid")
    near = box_cells(p, "p_x", "p_y", "p_x", "p_y", size, 13.0).join(point_cell(q, "q_x", "q_y", size), [*CELL, "timestep"]).where(f"other <> a AND {boxes_overlap()}")
    return near.groupBy("candidate_id", "other").agg(F.min("timestep").alias("frame"))


def collision(overlay: DataFrame, tasks: DataFrame, states: DataFrame, anchor: int) -> DataFrame:
    known = ", ".join(repr(t) for t in FOOTPRINTS)
    odd = states.where(f"timestep > {anchor} AND object_type NOT IN ({known})").select("scenario_id").distinct().withColumn("odd", F.lit(True))
    hit = contacts(overlay, tasks, states, anchor).groupBy("candidate_id").agg(F.count("*").alias("n"))
    return tasks.join(hit, "candidate_id", "left").join(odd, "scenario_id", "left").selectExpr(
        "candidate_id", f"CASE WHEN object_type NOT IN ({known}) OR coalesce(odd, false) THEN 'collision_proxy_unavailable' WHEN n > 0 THEN 'collision_proxy_overlap' END AS reason")


def target_risk(evaluated: DataFrame, low: float, high: float) -> DataFrame:
    return evaluated.selectExpr("candidate_id", "CASE WHEN status <> 'computed' OR value IS NULL THEN 'risk_metric_unavailable' "
                                f"WHEN value NOT BETWEEN {low} AND {high} THEN 'risk_out_of_target_range' END AS reason")


def realised_parameters(kin: DataFrame, original: DataFrame) -> DataFrame:
    """Realised values per candidate: mean speed, ratio to the original mean speed, peaks and inverse peak curvature."""
    g = kin.groupBy("candidate_id").agg(F.avg("speed").alias("mean_speed"), F.max("deceleration").alias("peak_decel"), F.expr("max(greatest(tangential, CAST(0 AS DOUBLE)))").alias("peak_accel"),
                                        F.max("curvature").alias("peak_curvature"), F.max("heading_rate").alias("peak_rate"))
    j = g.join(original, "candidate_id", "left")
    return j.selectExpr("candidate_id", "inline(filter(array(struct('speed_mps' AS parameter, mean_speed AS realised), "
                        "struct('speed_scale' AS parameter, IF(original_speed > 1e-6, mean_speed / original_speed, NULL) AS realised), struct('peak_deceleration_mps2' AS parameter, peak_decel AS realised), "
                        "struct('acceleration_mps2' AS parameter, peak_accel AS realised), struct('turn_radius_m' AS parameter, IF(peak_curvature > 1e-9, 1 / peak_curvature, NULL) AS realised), "
                        "struct('angular_speed_deg_s' AS parameter, degrees(peak_rate) AS realised)), s -> s.realised IS NOT NULL))")


def tolerance(parameter: str = "parameter") -> str:
    unit = (f"CASE WHEN {parameter} LIKE '%_mps2' THEN 'meters_per_second_squared' WHEN {parameter} LIKE '%_mps' THEN 'meters_per_second' WHEN {parameter} LIKE '%_deg' OR {parameter} LIKE '%_deg_s' "
            f"THEN 'degrees' WHEN {parameter} LIKE '%_scale' THEN 'scale' WHEN {parameter} LIKE '%_s' THEN 'seconds' WHEN {parameter} LIKE '%_m' THEN 'meters' END")
    return f"CASE {unit} " + " ".join(f"WHEN '{u}' THEN {v}D" for u, v in TOLERANCES.items()) + " END"


def parameter_stage(realised: DataFrame, requested: DataFrame, kinds: DataFrame) -> DataFrame:
    """Requested values against realised ones; a parameter without a realised value is only audited."""
    j = requested.join(realised, ["candidate_id", "parameter"]).withColumn("bad", F.expr(f"abs(realised - requested) > {tolerance()}"))
    g = j.groupBy("candidate_id").agg(F.expr("bool_or(bad)").alias("bad"))
    return kinds.join(g, "candidate_id", "left").selectExpr("candidate_id", "CASE WHEN bad THEN 'parameter_out_of_tolerance' END AS reason")


def run_funnel(ids: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Stages in order on the survivors only; the result is the union of all rejects and the accepted rest."""
    from roadsift.session import materialize
    alive, out = ids.select("candidate_id"), []
    for name, stage in stages:
        result = materialize(stage(alive).select("candidate_id", "reason"), f"stage-{name}")
        out.append(result.where("reason IS NOT NULL").selectExpr("candidate_id", f"'{name}' AS first_failed_stage", "reason"))
        alive = result.where("reason IS NULL").select("candidate_id")
    done = alive.selectExpr("candidate_id", "CAST(NULL AS STRING) AS first_failed_stage", "CAST(NULL AS STRING) AS reason")
    for part in out:
        done = done.unionByName(part)
    return done
