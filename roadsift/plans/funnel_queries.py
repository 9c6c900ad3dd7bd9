"""M, V and K operators over candidate futures."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.funnel import conditions as cn, frames as fr, risk as rk
from roadsift.oracles import funnel_sql as fs
from roadsift.plans import scene
from roadsift.plans.geometry_queries import BEST_SQL, best_matches
from roadsift.plans.registry import query
from roadsift.session import materialize

R = fm.rounded
ANCHOR, LAST = ad.ANCHOR, ad.LAST
BASE = fs.base()
END = 4.8
PAIRS3 = [("a", "b"), ("a", "c")]


def of(df, ids):
    """The rows of the given candidates, or all."""
    return df if ids is None else df.join(ids.select("candidate_id"), "candidate_id", "left_semi")


def tasks(cand):
    return cand.select("candidate_id", "scenario_id", "a", "b", "c").distinct()


def wide(spark, sf):
    cand = scene.candidates(spark, sf)
    return scene.once(spark, sf, "wide", lambda: rk.with_end(fr.wide_frames(tasks(cand), cand, scene.states(spark, sf), ANCHOR), END))


def rows(spark, sf):
    """Wide rows with steps, anchor state and conflict point."""
    def build():
        full = fr.anchored(fr.with_steps(wide(spark, sf)), ANCHOR)
        return cn.prepare(cn.conflict_context(full, ANCHOR), ANCHOR)
    return scene.once(spark, sf, "rows", build)


def motion(frames):
    """Steps and anchor state of wide frames for what reads no conflict point; not written, so that a query shuffles only the columns it reads."""
    full = fr.anchored(fr.with_steps(frames), ANCHOR)
    return cn.prepare(full.withColumns({"px": F.lit(None).cast("double"), "py": F.lit(None).cast("double")}), ANCHOR)


SHOW = ["candidate_id", f"{R('value', 5)} AS value", "pair", "status"]


def metric(name: str, pairs, formula, had: str = "true", start_sql: str = "true", start: str = "true"):
    """Least value over future frames and role pairs."""
    def run(spark, sf):
        w = wide(spark, sf)
        return rk.least(w, ANCHOR, pairs, formula, had).selectExpr(*SHOW)
    items = " UNION ALL ".join(f"SELECT candidate_id, timestep, ({had}) AS had, {formula(*p)} AS value, '{p[0]}->{p[1]}' AS pair FROM wd WHERE timestep > 34" for p in pairs)
    query(name, f"""{BASE}, it AS ({items}) SELECT candidate_id, {R('min(value)', 5)} AS value, min_by(pair, (value, pair)) FILTER (WHERE value IS NOT NULL) AS pair,
      CASE WHEN min(value) IS NOT NULL THEN 'computed' WHEN bool_or(had) THEN 'no_event' ELSE 'unavailable' END AS status FROM it GROUP BY 1""")(run)


SEEN = "b_x IS NOT NULL AND b_vx IS NOT NULL"
metric("M01_minimum_longitudinal_gap", [("a", "b"), ("b", "c")], rk.gap, "false")
metric("M02_time_headway", [("a", "b")], rk.headway, "b_x IS NOT NULL")
metric("M03_stopping_distance_margin", [("a", "b")], rk.stopping_margin, "false")
metric("M04_front_rear_ttc", [("b", "a"), ("a", "c")], rk.longitudinal_ttc, SEEN)
metric("M06_point_mass_ttc", [("a", "b")], rk.point_ttc, SEEN)
metric("M07_radial_head_on_ttc", [("a", "b")], rk.radial_ttc, SEEN)
metric("M08_lateral_ttc", [("a", "b")], rk.lateral_ttc, SEEN)


@query("M05_ttc_after_event", f"""{BASE}, ev AS (SELECT candidate_id, min(timestep) AS f FROM w4 WHERE fut AND abs({cn.rel_lat}) >= 1.0 GROUP BY 1), it AS (SELECT candidate_id, {rk.longitudinal_ttc('c', 'b')} AS value FROM wd JOIN ev USING (candidate_id) WHERE timestep >= f)
  SELECT candidate_id, {R('min(value)', 5)} AS value FROM it GROUP BY 1""")
def m05(spark, sf):
    event = F.min(F.expr(f"CASE WHEN fut AND abs({cn.rel_lat}) >= {cn.LATERAL} THEN timestep END")).over(fr.Window.partitionBy("candidate_id"))
    full = cn.prepare(fr.anchored(wide(spark, sf), ANCHOR).withColumns({"px": F.lit(None).cast("double"), "py": F.lit(None).cast("double")}), ANCHOR)
    w = full.withColumn("event", event).where("event IS NOT NULL")
    return rk.least(w, ANCHOR, [("c", "b")], rk.longitudinal_ttc, start="timestep >= event").selectExpr("candidate_id", f"{R('value', 5)} AS value")


GAPS = "gp AS (SELECT candidate_id, value, 'a->b' AS pair FROM gab UNION ALL SELECT candidate_id, value, 'a->c' FROM gac)"


@query("M09_path_arrival_gap", f"{BASE}, {GAPS} SELECT candidate_id, {R('min(value)')} AS value, min_by(pair, (value, pair)) AS pair FROM gp GROUP BY 1")
def m09(spark, sf):
    return rk.path_gap(wide(spark, sf), PAIRS3).where("status = 'computed'").selectExpr("candidate_id", f"{R('value')} AS value", "pair")


def _clear(pair: str) -> str:
    p, q = pair
    return f"""SELECT candidate_id, min(CASE WHEN nx IS NOT NULL THEN {fm.interval_distance('rx', 'ry', 'nx', 'ny')} ELSE {fm.norm('rx', 'ry')} END) AS value, '{p}->{q}' AS pair FROM (
      SELECT candidate_id, timestep, rx, ry, lead(rx) OVER w AS nx, lead(ry) OVER w AS ny FROM (SELECT candidate_id, timestep, {p}_x - {q}_x AS rx, {p}_y - {q}_y AS ry FROM wd WHERE timestep > {{t}}) WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)) WHERE rx IS NOT NULL GROUP BY 1"""


CLEAR3 = f"ck AS ({_clear('ab').format(t=34)} UNION ALL {_clear('ac').format(t=34)})"


@query("M10_minimum_clearance", f"{BASE}, {CLEAR3} SELECT candidate_id, {R('min(value)')} AS value, min_by(pair, (value, pair)) AS pair FROM ck GROUP BY 1")
def m10(spark, sf):
    return rk.clearance(wide(spark, sf), ANCHOR, PAIRS3).selectExpr("candidate_id", f"{R('value')} AS value", "pair")


@query("M11_intrusion_margin", f"{BASE} SELECT candidate_id, {R('min(' + rk.square_distance('a') + ')')} AS value FROM w4 WHERE fut GROUP BY 1")
def m11(spark, sf):
    return rk.intrusion_margin(rows(spark, sf), ANCHOR).selectExpr("candidate_id", f"{R('value')} AS value")


@query("M12_occupancy_overlap", f"""{BASE} SELECT candidate_id, {R('coalesce(sum(0.1::DOUBLE) FILTER (WHERE both_in), 0)')} AS value FROM (SELECT candidate_id, {rk.inside_square('a')} AND {rk.inside_square('b')} AS both_in, lead(time_s) OVER (PARTITION BY candidate_id ORDER BY timestep) AS nt FROM w4 WHERE fut)
  WHERE nt IS NOT NULL AND both_in IS NOT NULL GROUP BY 1""")
def m12(spark, sf):
    return rk.occupancy_overlap(rows(spark, sf), ANCHOR).selectExpr("candidate_id", f"{R('value')} AS value")


@query("M13_first_intrusion_ttc", f"{BASE} SELECT candidate_id, min(timestep) AS frame, {R('min_by(' + rk.point_ttc('b', 'a') + ', timestep)', 5)} AS value FROM w4 WHERE fut AND {rk.inside_square('a')} AND NOT last_inside GROUP BY 1")
def m13(spark, sf):
    return rk.first_intrusion(rows(spark, sf), ANCHOR).where("frame IS NOT NULL").selectExpr("candidate_id", "frame", f"{R('value', 5)} AS value")


@query("M14_conflict_context", f"{BASE} SELECT candidate_id, {R('max(px)')} AS px, {R('max(py)')} AS py, min(timestep) FILTER (WHERE fut AND abs({cn.rel_lat}) >= 1.0) AS exposure_frame, min(timestep) FILTER (WHERE fut AND {cn.cut_in}) AS cut_in_frame FROM w4 GROUP BY 1")
def m14(spark, sf):
    return rows(spark, sf).groupBy("candidate_id").agg(F.expr(R("max(px)")).alias("px"), F.expr(R("max(py)")).alias("py"),
                                                       F.expr(cn.first(f"abs({cn.rel_lat}) >= {cn.LATERAL}")).alias("exposure_frame"), F.expr(cn.first(cn.cut_in)).alias("cut_in_frame"))


# --- conditions -----------------------------------------------------------------------------------------
def verdict_sql(names: list[str]) -> str:
    aggs, outs = [], []
    for i, n in enumerate(names):
        parts, verdict = cn.CONDITIONS[n]
        aggs += [f"{e.replace('MEDIAN(', 'median(')} AS c{i}_{k}" for k, e in parts.items()]
        outs.append(f"coalesce({cn._prefixed(verdict, parts, f'c{i}_')}, false) AS {n}")
    return f"{BASE} SELECT candidate_id, {', '.join(outs)} FROM (SELECT candidate_id, {', '.join(aggs)} FROM w4 GROUP BY 1)"


def conditions(name: str, *names: str):
    query(name, verdict_sql(list(names)))(lambda spark, sf: cn.evaluate(rows(spark, sf), list(names)))


conditions("V02_leader_decelerating", "leader_decelerating")
conditions("V03_delayed_braking", "delayed_braking_response")
conditions("V04_cut_out", "lead_vehicle_cuts_out", "newly_exposed_slow_vehicle")
conditions("V06_overlapping_windows", "overlapping_lane_change_window")
conditions("V07_close_longitudinal", "close_longitudinal_position")
conditions("V08_blockage_ahead", "blockage_ahead")
conditions("V10_approach_buffer", "approach_to_safety_buffer")
conditions("V11_late_lateral", "late_lateral_crossing")
conditions("V13_competing_arrival", "competing_arrival")
conditions("V14_yielding_continues", "yielding_actor_continues")
conditions("V15_delayed_merge", "delayed_merge_entry")
conditions("V19_delayed_pedestrian", "delayed_pedestrian_entry", "vehicle_approaches_conflict")
conditions("V24_gap_squeeze", "front_gap_small", "rear_gap_small", "multi_direction_gap_closing")

MIN2 = f"ck AS ({_clear('ab').format(t=33)}), c2 AS ({_clear('ac').format(t=33)})"


@query("V12_conflicting_vehicle", f"{BASE}, {MIN2} SELECT candidate_id, value <= 18.0 AS conflicting_vehicle_present FROM ck")
def v12(spark, sf):
    return rk.clearance(wide(spark, sf), ANCHOR - 1, [("a", "b")]).selectExpr("candidate_id", "value <= 18.0 AS conflicting_vehicle_present")


def both(left, right):
    return left.join(right, "candidate_id", "left")


@query("V21_approach_and_intrusion", f"{BASE}, {MIN2}, v AS ({verdict_sql(['vehicle_approaching'])[len(BASE):]}) SELECT candidate_id, vehicle_approaching, coalesce(value <= 4.0, false) AS buffer_intrusion FROM v LEFT JOIN ck USING (candidate_id)")
def v21(spark, sf):
    near = rk.clearance(wide(spark, sf), ANCHOR - 1, [("a", "b")]).selectExpr("candidate_id", "value")
    return both(cn.evaluate(rows(spark, sf), ["vehicle_approaching"]), near).selectExpr("candidate_id", "vehicle_approaching", "coalesce(value <= 4.0, false) AS buffer_intrusion")


@query("V25_motorcyclist_filtering", f"{BASE}, {MIN2}, v AS ({verdict_sql(['motorcyclist_between_vehicles', 'positive_relative_speed'])[len(BASE):]}) SELECT v.*, coalesce(least(ck.value, c2.value) <= 4.0, false) AS buffer_intrusion FROM v LEFT JOIN ck USING (candidate_id) LEFT JOIN c2 USING (candidate_id)")
def v25(spark, sf):
    near = rk.clearance(wide(spark, sf), ANCHOR - 1, PAIRS3).selectExpr("candidate_id", "value")
    v = cn.evaluate(rows(spark, sf), ["motorcyclist_between_vehicles", "positive_relative_speed"])
    return both(v, near).selectExpr("candidate_id", "motorcyclist_between_vehicles", "positive_relative_speed", "coalesce(value <= 4.0, false) AS buffer_intrusion")


@query("V23_u_turn", f"{BASE}, {MIN2}, v AS ({verdict_sql(['turning_vehicle'])[len(BASE):]}) SELECT v.candidate_id, turning_vehicle, gab.value IS NOT NULL OR coalesce(ck.value <= 6.0, false) AS vehicle_path_conflict FROM v LEFT JOIN gab USING (candidate_id) LEFT JOIN ck USING (candidate_id)")
def v23(spark, sf):
    w = wide(spark, sf)
    near = rk.clearance(w, ANCHOR - 1, [("a", "b")]).selectExpr("candidate_id", "value AS near")
    meet = rk.path_gap(w, [("a", "b")]).selectExpr("candidate_id", "value AS meet")
    v = cn.evaluate(motion(w), ["turning_vehicle"])
    return both(both(v, near), meet).selectExpr("candidate_id", "turning_vehicle", "meet IS NOT NULL OR coalesce(near <= 6.0, false) AS vehicle_path_conflict")


def run_sql(flag: str, name: str) -> str:
    return f"""{name}0 AS (SELECT candidate_id, timestep, timestep - row_number() OVER (PARTITION BY candidate_id ORDER BY timestep) AS g FROM w4 WHERE fut AND {flag}),
      {name} AS (SELECT candidate_id, max(s) * 0.1::DOUBLE AS longest_s FROM (SELECT candidate_id, g, max(timestep) - min(timestep) AS s FROM {name}0 GROUP BY 1, 2) GROUP BY 1)"""


ALL = "(SELECT DISTINCT candidate_id FROM wd)"
CREEP = "a_speed BETWEEN 0.3 AND 2.0"


@query("V16_sustained_creep", f"{BASE}, {run_sql(CREEP, 'r1')} SELECT candidate_id, {R('coalesce(longest_s, 0)')} AS longest_s, coalesce(longest_s >= 0.5 - 1e-9, false) AS passed FROM {ALL} i LEFT JOIN r1 USING (candidate_id)")
def v16(spark, sf):
    return cn.sustained(rows(spark, sf), CREEP, 0.5).selectExpr("candidate_id", f"{R('longest_s')} AS longest_s", "passed")


BLOCK = f"a_speed <= 2.0 AND {rk.inside_square('a')}"


@query("V17_intersection_blocking", f"""{BASE}, {run_sql(BLOCK, 'r1')}, v AS ({verdict_sql(['inside_conflict_area', 'crossing_flow_approaches'])[len(BASE):]})
  SELECT v.*, coalesce(longest_s >= 1.0 - 1e-9, false) AS sustained_blocking FROM v LEFT JOIN r1 USING (candidate_id)""")
def v17(spark, sf):
    d = rows(spark, sf)
    stay = cn.sustained(d, BLOCK, 1.0).selectExpr("candidate_id", "passed AS sustained_blocking")
    return both(cn.evaluate(d, ["inside_conflict_area", "crossing_flow_approaches"]), stay)


@query("V18_mutual_yield", f"""{BASE}, {run_sql('a_speed BETWEEN 0 AND 2.0', 'r1')}, {run_sql('b_speed BETWEEN 0 AND 2.0', 'r2')}, v AS ({verdict_sql(['delayed_conflict_entry'])[len(BASE):]})
  SELECT v.*, coalesce(r1.longest_s >= 1.0 - 1e-9 AND r2.longest_s >= 1.0 - 1e-9, false) AS sustained_low_speed FROM v LEFT JOIN r1 USING (candidate_id) LEFT JOIN r2 USING (candidate_id)""")
def v18(spark, sf):
    d = rows(spark, sf)
    a = cn.sustained(d, "a_speed BETWEEN 0 AND 2.0", 1.0).selectExpr("candidate_id", "passed AS pa")
    b = cn.sustained(d, "b_speed BETWEEN 0 AND 2.0", 1.0).selectExpr("candidate_id", "passed AS pb")
    return both(both(cn.evaluate(d, ["delayed_conflict_entry"]), a), b).selectExpr("candidate_id", "delayed_conflict_entry", "pa AND pb AS sustained_low_speed")


@query("V20_stopped_reentry", f"""{BASE}, hs AS (SELECT scenario_id, track_id, max(sv) AS m FROM rt WHERE timestep BETWEEN 24 AND 34 GROUP BY 1, 2), v AS ({verdict_sql(['begins_moving', 'enters_main_flow'])[len(BASE):]})
  SELECT v.*, coalesce(m <= 0.5, false) AS previously_stopped FROM v JOIN tk USING (candidate_id) LEFT JOIN hs ON hs.scenario_id = tk.scenario_id AND hs.track_id = tk.a""")
def v20(spark, sf):
    from roadsift.operators import tracks as tr
    past = tr.speeds(scene.states(spark, sf).where(f"timestep <= {ANCHOR}")).where(f"timestep >= {ANCHOR - 10}").groupBy("scenario_id", F.col("track_id").alias("a")).agg(F.max("speed").alias("m"))
    v = cn.evaluate(rows(spark, sf), ["begins_moving", "enters_main_flow"]).join(tasks(scene.candidates(spark, sf)), "candidate_id").join(past, ["scenario_id", "a"], "left")
    return v.selectExpr("candidate_id", "begins_moving", "enters_main_flow", "coalesce(m <= 0.5, false) AS previously_stopped")


@query("V22_cut_in_then_brake", f"""{BASE}, ct AS (SELECT candidate_id, min(timestep) FILTER (WHERE fut AND {cn.cut_in}) AS cut FROM w4 GROUP BY 1), bk AS (SELECT candidate_id, max(cut) AS cut, min(timestep) FILTER (WHERE fut AND timestep >= cut AND a_accel <= -2.0) AS brake FROM w4 JOIN ct USING (candidate_id) GROUP BY 1)
  SELECT candidate_id, cut IS NOT NULL AS adjacent_vehicle_cuts_in, brake IS NOT NULL AS initiator_brakes, coalesce((brake - cut) * 0.1 BETWEEN 0.2 - 1e-9 AND 1.5 + 1e-9, false) AS short_delay FROM bk""")
def v22(spark, sf):
    e = cn.brake_after_cut_in(rows(spark, sf))
    return e.selectExpr("candidate_id", "cut IS NOT NULL AS adjacent_vehicle_cuts_in", f"{cn.EVENTS['initiator_brakes']} AS initiator_brakes", f"coalesce({cn.EVENTS['short_post_cut_in_delay']}, false) AS short_delay")


@query("P21_overlay", f"{BASE} SELECT candidate_id, timestep, {R('x')} AS x, {R('y')} AS y, {R('vx', 3)} AS vx, {R('vy', 3)} AS vy FROM ov WHERE timestep >= 34")
def p21(spark, sf):
    o = fr.overlay(scene.candidates(spark, sf), scene.states(spark, sf), ANCHOR).where(f"timestep >= {ANCHOR}")
    return o.selectExpr("candidate_id", "timestep", f"{R('x')} AS x", f"{R('y')} AS y", f"{R('vx', 3)} AS vx", f"{R('vy', 3)} AS vy")


@query("F03_conflict_square", f"{BASE} SELECT candidate_id, timestep, {rk.inside_square('a')} AS inside, {R(rk.square_distance('a'))} AS distance FROM w4 WHERE px IS NOT NULL")
def f03(spark, sf):
    return rows(spark, sf).where("px IS NOT NULL").selectExpr("candidate_id", "timestep", f"{rk.inside_square('a')} AS inside", f"{R(rk.square_distance('a'))} AS distance")


# --- filter stages --------------------------------------------------------------------------------------
from roadsift.funnel import stages as sg  # noqa: E402
from roadsift.operators import diversity as dv, frames as frm, lanes as ln, tracks as trk  # noqa: E402
from roadsift.oracles import rules_sql as rsq, scene_sql as scq  # noqa: E402


def typed(spark, sf, ids=None):
    return of(scene.once(spark, sf, "tasks", lambda: scene.candidates(spark, sf).select("candidate_id", "scenario_id", "a", "b", "c", "object_type", "candidate_index").distinct()), ids)


def kinds(spark, sf, ids=None):
    return typed(spark, sf, ids).select("candidate_id", "object_type")


def laid(spark, sf, ids=None):
    return of(scene.once(spark, sf, "overlay", lambda: fr.overlay(scene.candidates(spark, sf), scene.states(spark, sf), ANCHOR)), ids)


def points(spark, sf, ids=None):
    o = laid(spark, sf, ids).where(f"timestep > {ANCHOR}").join(typed(spark, sf).select("candidate_id", "scenario_id"), "candidate_id")
    return o.selectExpr("scenario_id", "candidate_id", "timestep", "x AS px", "y AS py", "heading")


def kin_source(spark, sf, ids=None):
    return laid(spark, sf, ids).selectExpr("candidate_id", "timestep", "time_s", "is_future", "x", "y", "vx", "vy", "IF(is_future, CAST(NULL AS DOUBLE), heading) AS heading")


SCHEMA = "n <> 14 THEN 'invalid_future_shape'"


@query("K01_schema_finite", f"{BASE} SELECT candidate_id, CASE WHEN count(DISTINCT timestep) <> 14 THEN 'invalid_future_shape' END AS reason FROM cd GROUP BY 1")
def k01(spark, sf):
    return sg.schema_finite(scene.candidates(spark, sf), scene.states(spark, sf), ANCHOR, LAST - ANCHOR)


@query("Q06_candidate_gate", f"{BASE} SELECT reason, count(*) AS candidates FROM (SELECT candidate_id, CASE WHEN count(DISTINCT timestep) <> 14 THEN 'invalid_future_shape' ELSE 'passed' END AS reason FROM cd GROUP BY 1) GROUP BY 1")
def q06(spark, sf):
    return k01(spark, sf).groupBy(F.expr("coalesce(reason, 'passed')").alias("reason")).agg(F.count("*").alias("candidates"))


def changed(spark, sf):
    s = scene.states(spark, sf)
    g = s.withColumn("x", F.expr("IF(object_type = 'vehicle' AND (timestep > 34 OR timestep = 0), x + 1, x)")).withColumn("heading", F.expr("IF(object_type = 'bus' AND timestep = 5, NULL, heading)"))
    return sg.history_changes(s, g, ["scenario_id", "track_id"], "track_id LIKE '%0'", ANCHOR)


CHANGED = f"""{BASE}, ch AS (SELECT scenario_id, track_id, timestep, track_id LIKE '%0' AND timestep > 34 AS allowed FROM st WHERE (object_type = 'vehicle' AND (timestep > 34 OR timestep = 0)) OR (object_type = 'bus' AND timestep = 5))"""


@query("D06_history_invariants", f"{CHANGED} SELECT scenario_id, track_id, timestep, allowed FROM ch")
def d06(spark, sf):
    return changed(spark, sf).select("scenario_id", "track_id", "timestep", "allowed")


@query("K02_history_stage", f"{CHANGED} SELECT scenario_id, count(*) FILTER (WHERE NOT allowed) AS violations, CASE WHEN count(*) FILTER (WHERE NOT allowed) > 0 THEN 'history_changed' END AS reason FROM ch GROUP BY 1")
def k02(spark, sf):
    g = changed(spark, sf).groupBy("scenario_id").agg(F.expr("count_if(NOT allowed)").alias("violations"))
    return g.withColumn("reason", F.expr("IF(violations > 0, 'history_changed', NULL)"))


KSQL = f"""kq AS (SELECT candidate_id, timestep, ux AS vx, uy AS vy, sqrt(ux * ux + uy * uy) AS speed, time_s - lag(time_s) OVER w AS dt, ux - lag(ux) OVER w AS dux, uy - lag(uy) OVER w AS duy FROM o1 WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  ks AS (SELECT *, dux / dt AS ax, duy / dt AS ay, (speed - lag(speed) OVER w) / dt AS tang FROM kq WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  kj AS (SELECT *, sqrt((ax - lag(ax) OVER w) * (ax - lag(ax) OVER w) + (ay - lag(ay) OVER w) * (ay - lag(ay) OVER w)) / dt AS jerk FROM ks WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  km AS (SELECT candidate_id, max(speed) AS speed, max(greatest(tang, 0)) AS accel, max(greatest(0 - tang, 0)) AS decel, max(jerk) AS jerk, avg(speed) AS mean_speed FROM kj WHERE timestep > 34 GROUP BY 1)"""


#: Heading rate and curvature: at least 0.5 m/s, cyclists 0.3, pedestrians 0.2. The futures of cyclists and pedestrians are slowed to a twentieth around the anchor, so that the classes differ.
SLOW = "object_type IN ('cyclist', 'pedestrian')"
KTURN = f"""t0 AS (SELECT o0.candidate_id, o0.timestep, time_s, object_type, ax0 + CASE WHEN {SLOW} THEN 0.05::DOUBLE ELSE 1 END * (o0.x - ax0) AS x, ay0 + CASE WHEN {SLOW} THEN 0.05::DOUBLE ELSE 1 END * (o0.y - ay0) AS y,
      CASE WHEN {SLOW} THEN 0.05::DOUBLE ELSE 1 END * vx AS vx, CASE WHEN {SLOW} THEN 0.05::DOUBLE ELSE 1 END * vy AS vy, heading, CASE object_type WHEN 'cyclist' THEN 0.3::DOUBLE WHEN 'pedestrian' THEN 0.2 ELSE 0.5 END AS least
      FROM o0 JOIN tk USING (candidate_id) JOIN (SELECT candidate_id, max(x) AS ax0, max(y) AS ay0 FROM o0 WHERE timestep = 34 GROUP BY 1) an USING (candidate_id)),
  t1 AS (SELECT *, time_s - lag(time_s) OVER w AS dt, CASE WHEN timestep > 34 THEN (x - lag(x) OVER w) / (time_s - lag(time_s) OVER w) ELSE vx END AS ux, CASE WHEN timestep > 34 THEN (y - lag(y) OVER w) / (time_s - lag(time_s) OVER w) ELSE vy END AS uy FROM t0 WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  t2 AS (SELECT *, sqrt(ux * ux + uy * uy) AS speed, (ux - lag(ux) OVER w) / dt AS ax, (uy - lag(uy) OVER w) / dt AS ay FROM t1 WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  t3 AS (SELECT *, lag(speed) OVER w AS before, (speed - lag(speed) OVER w) / dt AS tang, sqrt((ax - lag(ax) OVER w) * (ax - lag(ax) OVER w) + (ay - lag(ay) OVER w) * (ay - lag(ay) OVER w)) / dt AS jerk,
      CASE WHEN timestep <= 34 THEN heading WHEN speed >= least THEN atan2(uy, ux) END AS course FROM t2 WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
  t4 AS (SELECT *, last_value(course IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_course FROM t3),
  t5 AS (SELECT *, CASE WHEN speed >= least AND before >= least AND last_course IS NOT NULL THEN abs(course - last_course - 2 * pi() * floor((course - last_course + pi()) / (2 * pi()))) / dt ELSE 0 END AS rate FROM t4 WHERE timestep > 34),
  t6 AS (SELECT candidate_id, max(speed) FILTER (timestep = 35) AS seam_speed, max(speed) AS speed, max(greatest(tang, 0)) AS acceleration, max(greatest(0 - tang, 0)) AS deceleration, max(jerk) AS jerk,
      max(CASE WHEN rate > 0 THEN rate / ((before + speed) / 2) ELSE 0 END) AS curvature, max(rate) AS heading_rate FROM t5 GROUP BY 1),
  t7 AS (SELECT * FROM (VALUES ('vehicle', 55.0, 55.0, 8.0, 12.0, 60.0, 0.25, 1.5), ('bus', 40.0, 40.0, 5.0, 8.0, 40.0, 0.2, 1.0), ('motorcyclist', 55.0, 55.0, 10.0, 14.0, 80.0, 0.5, 2.5), ('cyclist', 20.0, 20.0, 6.0, 8.0, 50.0, 0.8, 3.0),
      ('pedestrian', 8.0, 8.0, 5.0, 5.0, 40.0, 2.0, 4.0)) AS l(object_type, l1, l2, l3, l4, l5, l6, l7))"""
KSHOWN = {"seam_speed": 3, "speed": 3, "acceleration": 1, "deceleration": 1, "jerk": 0, "curvature": 2, "heading_rate": 2}


@query("K03_kinematics_stage", f"""{BASE}, {KTURN} SELECT candidate_id, {', '.join(f'{R("t6." + n, d)} AS {n}' for n, d in KSHOWN.items())}, CASE WHEN l1 IS NULL THEN 'unsupported_actor_type' {' '.join(f"WHEN t6.{n} > l{i + 1} * (1 + 1e-9) + 1e-9 THEN '{n}_limit_exceeded'" for i, n in enumerate(KSHOWN))} END AS reason
  FROM tk JOIN t6 USING (candidate_id) LEFT JOIN t7 USING (object_type)""")
def k03(spark, sf):
    source = kin_source(spark, sf)
    anchor = source.where("timestep = 34").selectExpr("candidate_id", "x AS ax0", "y AS ay0").join(kinds(spark, sf), "candidate_id")
    slow = source.join(anchor, "candidate_id").withColumn("part", F.expr(f"IF({SLOW}, 0.05D, 1D)")).withColumns(
        {"x": F.expr("ax0 + part * (x - ax0)"), "y": F.expr("ay0 + part * (y - ay0)"), "vx": F.expr("part * vx"), "vy": F.expr("part * vy")})
    k = sg.kinematics(slow.drop("ax0", "ay0", "part", "object_type"), kinds(spark, sf))
    return k.selectExpr("candidate_id", *[f"{R(n, d)} AS {n}" for n, d in KSHOWN.items()], "reason")


LIM = ", ".join(f"('{t}', {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE)" for t, v in sg.LIMITS.items())


@query("T03_kinematic_ranking", f"""{BASE}, {KSQL}, lim AS (SELECT * FROM (VALUES {LIM}) AS l(object_type, ls, la, ld, lj)), sck AS (SELECT candidate_id, a, candidate_index, greatest(accel - la, 0) / la + greatest(decel - ld, 0) / ld AS score FROM tk JOIN km USING (candidate_id) JOIN lim USING (object_type))
  SELECT candidate_id, {R('score', 4)} AS score FROM sck QUALIFY row_number() OVER (PARTITION BY a ORDER BY score > 0, round(score, 4), candidate_index) <= 2""")
def t03(spark, sf):
    k = sg.kinematics(kin_source(spark, sf), kinds(spark, sf)).join(typed(spark, sf), "candidate_id").where(F.col("object_type").isin(list(sg.LIMITS)))
    part = lambda n, i: f"greatest({n} - ({sg._by_type(sg.LIMITS, i)}), 0D) / ({sg._by_type(sg.LIMITS, i)})"
    k = k.withColumn("score", F.expr(f"{part('acceleration', 2)} + {part('deceleration', 3)}"))
    w = fr.Window.partitionBy("a").orderBy(F.expr("score > 0"), F.expr("round(score, 4)"), "candidate_index")
    return k.withColumn("n", F.row_number().over(w)).where("n <= 2").selectExpr("candidate_id", f"{R('score', 4)} AS score")


EXCESS = " + ".join(f"greatest(t6.{n} - l{i + 1}, 0) / l{i + 1}" for i, n in enumerate(sg.LIMIT_NAMES))
#: The futures as they are, without the slowing of K03.
KPLAIN = KTURN.replace("0.05::DOUBLE", "1.0::DOUBLE")


@query("T03b_ranking_by_all_limits", f"""{BASE}, {KPLAIN}, sck AS (SELECT candidate_id, a, candidate_index, {EXCESS} AS score FROM tk JOIN t6 USING (candidate_id) JOIN t7 USING (object_type))
  SELECT candidate_id, {R('score', 4)} AS score FROM sck QUALIFY row_number() OVER (PARTITION BY a ORDER BY score > 0, round(score, 4), candidate_index) <= 2""")
def t03b(spark, sf):
    k = sg.kinematics(kin_source(spark, sf), kinds(spark, sf)).join(typed(spark, sf), "candidate_id").where(F.col("object_type").isin(list(sg.LIMITS)))
    part = lambda n, i: f"greatest({n} - ({sg._by_type(sg.LIMITS, i)}), 0D) / ({sg._by_type(sg.LIMITS, i)})"
    k = k.withColumn("score", F.expr(" + ".join(part(n, i) for i, n in enumerate(sg.LIMIT_NAMES))))
    w = fr.Window.partitionBy("a").orderBy(F.expr("score > 0"), F.expr("round(score, 4)"), "candidate_index")
    return k.withColumn("n", F.row_number().over(w)).where("n <= 2").selectExpr("candidate_id", f"{R('score', 4)} AS score")


@query("T04_chunked_top_k", f"{BASE}, {KSQL} SELECT candidate_id, {R('mean_speed', 4)} AS mean_speed FROM tk JOIN km USING (candidate_id) QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY round(mean_speed, 4) DESC, candidate_id) <= 5")
def t04(spark, sf):
    k = frm.future_kinematics(kin_source(spark, sf), "candidate_id").groupBy("candidate_id").agg(F.avg("speed").alias("mean_speed")).join(typed(spark, sf), "candidate_id")
    # row_number <= k is limited inside every task before the shuffle, so chunks merge by construction
    w = fr.Window.partitionBy("scenario_id").orderBy(F.expr("round(mean_speed, 4)").desc(), "candidate_id")
    return k.withColumn("n", F.row_number().over(w)).where("n <= 5").selectExpr("candidate_id", f"{R('mean_speed', 4)} AS mean_speed")


DRV = f"""dp AS (SELECT candidate_id, scenario_id, object_type, timestep, a_x AS px, a_y AS py, a_heading AS h FROM wd WHERE timestep > 34), {scq.inside('dp', 'candidate_id, timestep', 'drivable_area', 'di')},
  df AS (SELECT candidate_id, object_type, count(di.timestep) / count(*) AS fraction FROM dp LEFT JOIN di USING (candidate_id, timestep) GROUP BY 1, 2)"""
ROAD = "object_type IN ('vehicle', 'bus', 'motorcyclist', 'cyclist')"
DREASON = f"CASE WHEN {ROAD} AND fraction < 0.95 THEN 'outside_drivable_area' END"


@query("K04_drivable_area", f"{BASE}, {DRV} SELECT candidate_id, {R('fraction')} AS fraction, {DREASON} AS reason FROM df")
def k04(spark, sf):
    return sg.drivable(points(spark, sf), scene.roads(spark, sf), kinds(spark, sf)).selectExpr("candidate_id", f"{R('fraction')} AS fraction", "reason")


LNE = f"""l0 AS (SELECT candidate_id, timestep, s.pid, min_by(s.hd, (d, seq)) AS hd, min(d) AS d FROM (SELECT dp.candidate_id, dp.timestep, g.pid, g.hd, g.seq, {fm.norm('px - (x1 + f * (x2 - x1))', 'py - (y1 + f * (y2 - y1))')} AS d
      FROM (SELECT dp.*, sg.pid, sg.hd, sg.seq, sg.x1, sg.y1, sg.x2, sg.y2, {fm.seg_fraction('px', 'py', 'sg.x1', 'sg.y1', 'sg.x2', 'sg.y2')} AS f FROM dp, seg sg WHERE sg.ptype = 'lane_centerline') dp, LATERAL (SELECT dp.pid, dp.hd, dp.seq) g(pid, hd, seq)) s GROUP BY 1, 2, 3),
  l1 AS (SELECT * FROM l0 WHERE d <= 6 QUALIFY row_number() OVER (PARTITION BY candidate_id, timestep ORDER BY d, pid) = 1),
  l2 AS (SELECT dp.candidate_id, dp.object_type, dp.timestep, l1.pid AS lane, direction, degrees({fm.heading_gap('dp.h', 'l1.hd')}) <= 90 AS ok FROM dp LEFT JOIN l1 USING (candidate_id, timestep) LEFT JOIN lane0 ON lane0.pid = l1.pid),
  l3 AS (SELECT candidate_id, prev AS src, lane AS dst FROM (SELECT candidate_id, lane, lag(lane) OVER (PARTITION BY candidate_id ORDER BY timestep) AS prev FROM l2 WHERE lane IS NOT NULL) WHERE prev <> lane),
  l4 AS (SELECT candidate_id, count(*) AS breaks FROM l3 JOIN lane0 p ON p.pid = src JOIN lane0 q ON q.pid = dst WHERE NOT (coalesce(dst IN (p.left_id, p.right_id), false) OR coalesce(src IN (q.left_id, q.right_id), false)
      OR list_contains(p.succ, dst) OR list_contains(q.pred, src) OR list_contains(q.succ, src) OR list_contains(p.pred, dst)) GROUP BY 1),
  l5 AS (SELECT candidate_id, object_type, count(lane) / count(*) AS assigned, avg(CASE WHEN object_type IN ('vehicle', 'bus') AND lane IS NOT NULL THEN (CASE WHEN direction = 'bike' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) END) AS typed,
      avg(CASE WHEN lane IS NOT NULL THEN (CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END) AS aligned FROM l2 GROUP BY 1, 2),
  lr AS (SELECT candidate_id, assigned, CASE WHEN {ROAD} AND assigned < 0.8 THEN 'lane_assignment_insufficient' WHEN {ROAD} AND typed < 0.8 THEN 'lane_type_incompatible' WHEN breaks > 0 THEN 'lane_connectivity_violation'
      WHEN {ROAD} AND candidate_id NOT IN (SELECT candidate_id FROM tk WHERE CAST(a AS BIGINT) % 7 = 0) AND coalesce(aligned, 0) < 0.8 THEN 'lane_direction_violation' END AS reason FROM l5 LEFT JOIN l4 USING (candidate_id))"""


#: Every seventh candidate belongs to a skill that is exempt from the direction.
SKILLED = "CASE WHEN CAST(a AS BIGINT) % 7 = 0 THEN 'wrong_way_vehicle' ELSE 'lead_hard_brake' END"


def skilled(spark, sf, ids=None):
    return typed(spark, sf, ids).selectExpr("candidate_id", "object_type", f"{SKILLED} AS skill_id")


@query("K05_lane_compliance", f"{BASE}, {DRV}, {LNE} SELECT candidate_id, {R('assigned')} AS assigned, reason FROM lr")
def k05(spark, sf):
    return sg.lane_compliance(points(spark, sf), scene.roads(spark, sf), skilled(spark, sf)).selectExpr("candidate_id", f"{R('assigned')} AS assigned", "reason")


MAPR = f"{DRV}, {LNE}, mp AS (SELECT candidate_id, coalesce({DREASON}, lr.reason) AS reason FROM df LEFT JOIN lr USING (candidate_id))"


@query("K06_map_stage", f"{BASE}, {MAPR} SELECT * FROM mp")
def k06(spark, sf):
    return sg.map_stage(points(spark, sf), scene.roads(spark, sf), skilled(spark, sf))


FOOT = ", ".join(f"('{t}', {l}::DOUBLE, {w}::DOUBLE)" for t, (l, w) in sg.FOOTPRINTS.items())
BOX = f"""fp AS (SELECT * FROM (VALUES {FOOT}) AS f(kind, len, wid)), bx AS (SELECT wd.candidate_id, s.track_id AS other, wd.timestep, a_x AS p_x, a_y AS p_y, a_heading AS p_heading, f.len AS p_len, f.wid AS p_wid, s.x AS q_x, s.y AS q_y, s.heading AS q_heading, g.len AS q_len, g.wid AS q_wid
    FROM wd JOIN st s ON s.scenario_id = wd.scenario_id AND s.timestep = wd.timestep AND s.track_id <> wd.a JOIN fp f ON f.kind = wd.object_type JOIN fp g ON g.kind = s.object_type WHERE wd.timestep > 34),
  ct AS (SELECT candidate_id, other, min(timestep) AS frame FROM bx WHERE {sg.boxes_overlap()} GROUP BY 1, 2)"""


@query("J25_box_contacts", f"{BASE}, {BOX} SELECT * FROM ct")
def j25(spark, sf):
    return sg.contacts(laid(spark, sf), typed(spark, sf), scene.states(spark, sf), ANCHOR).select("candidate_id", "other", "frame")


@query("K07_collision_stage", f"{BASE}, {BOX} SELECT candidate_id, CASE WHEN candidate_id IN (SELECT candidate_id FROM ct) THEN 'collision_proxy_overlap' END AS reason FROM tk")
def k07(spark, sf):
    return sg.collision(laid(spark, sf), typed(spark, sf), scene.states(spark, sf), ANCHOR)


RISKR = f"{CLEAR3}, rr AS (SELECT candidate_id, CASE WHEN v IS NULL THEN 'risk_metric_unavailable' WHEN v NOT BETWEEN 1.0 AND 20.0 THEN 'risk_out_of_target_range' END AS reason FROM tk LEFT JOIN (SELECT candidate_id, min(value) AS v FROM ck GROUP BY 1) z USING (candidate_id))"


@query("K08_target_risk", f"{BASE}, {RISKR} SELECT * FROM rr")
def k08(spark, sf):
    return sg.target_risk(rk.clearance(wide(spark, sf), ANCHOR, PAIRS3), 1.0, 20.0)


NOV = """nv AS (SELECT candidate_id, sqrt(avg(d * d)) AS rms, max_by(d, timestep) AS endpoint, CASE WHEN count(d) < 14 THEN 'novelty_reference_unavailable' WHEN sqrt(avg(d * d)) < 0.5 AND max_by(d, timestep) < 1.0 THEN 'novelty_insufficient' END AS reason
  FROM (SELECT cd.candidate_id, cd.timestep, sqrt((cd.x - s.x) * (cd.x - s.x) + (cd.y - s.y) * (cd.y - s.y)) AS d FROM cd LEFT JOIN st s ON s.scenario_id = cd.scenario_id AND s.track_id = cd.a AND s.timestep = cd.timestep) GROUP BY 1)"""


def novel(spark, sf, ids=None):
    source = scene.states(spark, sf).selectExpr("scenario_id", "track_id AS a", "timestep", "x", "y")
    return dv.novelty(of(scene.candidates(spark, sf), ids).select("candidate_id", "scenario_id", "a", "timestep", "x", "y"), source, ["scenario_id", "a"], LAST - ANCHOR)


@query("D01_novelty", f"{BASE}, {NOV} SELECT candidate_id, {R('rms', 5)} AS rms, {R('endpoint', 5)} AS endpoint, reason FROM nv")
def d01(spark, sf):
    return novel(spark, sf).selectExpr("candidate_id", f"{R('rms', 5)} AS rms", f"{R('endpoint', 5)} AS endpoint", "reason")


def overlay_scene(spark, sf):
    """Every candidate as its own scenario holding the three role tracks."""
    t, s = typed(spark, sf), scene.states(spark, sf)
    base = ["timestep", "time_s", "observed", "object_type", "x", "y", "vx", "vy", "heading"]
    others = t.selectExpr("candidate_id", "scenario_id", "explode(array(b, c)) AS track_id").join(s, ["scenario_id", "track_id"]).select("candidate_id", "track_id", *base)
    mine = t.selectExpr("candidate_id", "scenario_id", "a AS track_id").join(s.where(f"timestep <= {ANCHOR}"), ["scenario_id", "track_id"]).select("candidate_id", "track_id", *base)
    new = laid(spark, sf).where("is_future").join(t.selectExpr("candidate_id", "a AS track_id", "object_type"), "candidate_id").withColumn("observed", F.lit(False)).select("candidate_id", "track_id", *base)
    roads = scene.roads(spark, sf).join(t.select("candidate_id", "scenario_id"), "scenario_id").drop("scenario_id").withColumnRenamed("candidate_id", "scenario_id")
    return others.unionByName(mine).unionByName(new).withColumnRenamed("candidate_id", "scenario_id"), roads


OVST = f"""SELECT * FROM (WITH st AS ({ad.track_states_sql()}){BASE[BASE.index(', cd AS ('):BASE.index('    wd AS (')].rstrip().rstrip(',')}
  SELECT tk.candidate_id AS scenario_id, s.track_id, s.object_type, s.timestep, s.observed, s.time_s, s.x, s.y, s.vx, s.vy, s.heading FROM tk JOIN st s ON s.scenario_id = tk.scenario_id AND s.track_id IN (tk.b, tk.c)
  UNION ALL SELECT tk.candidate_id, s.track_id, s.object_type, s.timestep, s.observed, s.time_s, s.x, s.y, s.vx, s.vy, s.heading FROM tk JOIN st s ON s.scenario_id = tk.scenario_id AND s.track_id = tk.a AND s.timestep <= 34
  UNION ALL SELECT tk.candidate_id, tk.a, tk.object_type, ov.timestep, false, ov.time_s, ov.x, ov.y, ov.vx, ov.vy, ov.heading FROM tk JOIN ov USING (candidate_id) WHERE ov.timestep > 34)"""
#: Candidates of odd targets belong to a rule that is observed in the seed, those of even targets to one that is only compatible with it.
OBSERVED_RULE, OBSERVED = "short_headway_following", "CAST(a AS BIGINT) % 2 = 1"
TRIG = f"""tg AS (SELECT DISTINCT m.scenario_id AS candidate_id FROM ({rsq.build()[OBSERVED_RULE].replace(ad.track_states_sql(), OVST)}) m JOIN tk ON tk.candidate_id = m.scenario_id WHERE (initiator = tk.a AND responder = tk.b) OR (initiator = tk.b AND responder = tk.a)),
  ct9 AS (SELECT candidate_id, min(timestep) FILTER (WHERE fut AND {cn.cut_in}) AS cut FROM w4 GROUP BY 1), bk9 AS (SELECT candidate_id, max(cut) AS cut, min(timestep) FILTER (WHERE fut AND timestep >= cut AND a_accel <= -2.0) AS brake FROM w4 JOIN ct9 USING (candidate_id) GROUP BY 1),
  c2 AS (SELECT candidate_id, cut IS NOT NULL AND brake IS NOT NULL AND (brake - cut) * 0.1 BETWEEN 0.2 - 1e-9 AND 1.5 + 1e-9 AS passed FROM bk9),
  tr9 AS (SELECT candidate_id, CASE WHEN {OBSERVED} THEN (CASE WHEN tg.candidate_id IS NULL THEN 'skill_trigger_not_realized' ELSE nv.reason END) WHEN NOT coalesce(passed, false) THEN 'skill_trigger_not_realized' END AS reason
    FROM tk LEFT JOIN tg USING (candidate_id) JOIN nv USING (candidate_id) LEFT JOIN c2 USING (candidate_id))"""


def fired(spark, sf, skill, tasks):
    """Candidates on whose overlay the rule fires for their roles a and b.

    Up to the anchor an overlay is the record. A rule that reads nothing later is evaluated on the record's actors and lanes, once for all
    candidates of the same roles: neither tracks nor maps are copied for a candidate.
    """
    from roadsift.rules.catalog import RULES
    from roadsift.rules.detector import detect, gated_actors, reads_history_only
    rule = RULES[skill]
    if reads_history_only(skill):
        roles = ["scenario_id", "a", "b", "c"]
        group = tasks.groupBy(*roles).agg(F.min("candidate_id").alias("scene"))
        seats = group.selectExpr("scene", "scenario_id", "a", "b", "inline(array(struct('a' AS seat, a AS track_id), struct('b' AS seat, b AS track_id), struct('c' AS seat, c AS track_id)))")
        cast = seats.select("scene", "scenario_id", "seat", "track_id").join(scene.actors(spark, sf).drop("future"), ["scenario_id", "track_id"]).drop("scenario_id").withColumnRenamed("scene", "scenario_id")
        offer = group.select("scene", "scenario_id").join(ln.map_features(scene.roads(spark, sf)), "scenario_id", "left").selectExpr("scene AS scenario_id", "features")
        # c counts for the types that a scene offers; matches that it takes part in are not asked for
        cast = gated_actors(None, None, list(RULES.values()), cast, offer).withColumns({m: F.expr(f"IF(seat = 'c', 0L, {m})") for m in ("init_mask", "resp_mask")}).drop("seat")
        hits = detect(scene.states(spark, sf), scene.roads(spark, sf), [rule], None, cast).select(F.col("scenario_id").alias("scene"), "initiator", "responder")
        hits = hits.join(group, "scene").join(tasks.select("candidate_id", *roles), roles)
    else:
        st, roads = overlay_scene(spark, sf)
        only = tasks.select(F.col("candidate_id").alias("scenario_id"))
        hits = detect(st.join(only, "scenario_id", "left_semi"), roads.join(only, "scenario_id", "left_semi"), [rule], None).withColumnRenamed("scenario_id", "candidate_id").join(tasks.select("candidate_id", "a", "b"), "candidate_id")
    return hits.where("(initiator = a AND responder = b) OR (initiator = b AND responder = a)").select("candidate_id").distinct()


def triggered(spark, sf, ids=None, frames=None):
    """Observed rules fire again on the overlay with the requested roles and must be novel; compatible ones realise all their missing conditions."""
    hits = fired(spark, sf, OBSERVED_RULE, typed(spark, sf, ids).where(OBSERVED)).withColumn("hit", F.lit(True))
    n = novel(spark, sf, ids).select("candidate_id", F.col("reason").alias("novelty"))
    conditions = cn.brake_after_cut_in(motion(wide(spark, sf) if frames is None else frames)).selectExpr("candidate_id", f"cut IS NOT NULL AND {cn.EVENTS['initiator_brakes']} AND coalesce({cn.EVENTS['short_post_cut_in_delay']}, false) AS passed")
    joined = typed(spark, sf, ids).select("candidate_id", "a").join(hits, "candidate_id", "left").join(n, "candidate_id").join(conditions, "candidate_id", "left")
    return joined.selectExpr("candidate_id", f"CASE WHEN {OBSERVED} THEN IF(hit IS NULL, 'skill_trigger_not_realized', novelty) WHEN NOT coalesce(passed, false) THEN 'skill_trigger_not_realized' END AS reason")


@query("K09_skill_trigger", f"{BASE}, {NOV}, {TRIG} SELECT * FROM tr9")
def k09(spark, sf):
    return triggered(spark, sf)


def realised(spark, sf, ids=None):
    original = scene.states(spark, sf).where(f"timestep BETWEEN {ANCHOR + 1} AND {LAST}").groupBy("scenario_id", F.col("track_id").alias("a")).agg(F.expr(f"avg({fm.norm('vx', 'vy')})").alias("original_speed"))
    o = typed(spark, sf, ids).join(original, ["scenario_id", "a"], "left").select("candidate_id", "original_speed")
    return sg.realised_parameters(frm.future_kinematics(kin_source(spark, sf, ids), "candidate_id"), o)


ORIG = f"og AS (SELECT tk.candidate_id, avg({fm.norm('vx', 'vy')}) AS o FROM tk JOIN st ON st.scenario_id = tk.scenario_id AND st.track_id = tk.a AND timestep BETWEEN 35 AND 48 GROUP BY 1)"
REAL = f"""{KSQL}, {ORIG}, rl AS (SELECT candidate_id, 'speed_mps' AS parameter, mean_speed AS realised FROM km UNION ALL SELECT candidate_id, 'speed_scale', mean_speed / o FROM km JOIN og USING (candidate_id) WHERE o > 1e-6
  UNION ALL SELECT candidate_id, 'peak_deceleration_mps2', decel FROM km UNION ALL SELECT candidate_id, 'acceleration_mps2', accel FROM km)"""
NAMED = "parameter IN ('speed_mps', 'speed_scale', 'peak_deceleration_mps2', 'acceleration_mps2')"


@query("P36_realised_parameters", f"{BASE}, {REAL} SELECT candidate_id, parameter, {R('realised', 1)} AS realised FROM rl")
def p36(spark, sf):
    return realised(spark, sf).where(NAMED).selectExpr("candidate_id", "parameter", f"{R('realised', 1)} AS realised")


@query("P37_parameter_bins", f"{BASE}, {REAL} SELECT candidate_id, parameter, CAST(round_even(round(realised, 1) / CASE parameter WHEN 'speed_mps' THEN 0.75::DOUBLE WHEN 'speed_scale' THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END, 0) AS BIGINT) AS bin FROM rl")
def p37(spark, sf):
    return realised(spark, sf).where(NAMED).selectExpr("candidate_id", "parameter", f"CAST(bround(round(realised, 1) / {sg.tolerance()}) AS BIGINT) AS bin")


def requested(spark, sf, ids=None):
    return typed(spark, sf, ids).selectExpr("candidate_id", "inline(array(struct('speed_mps' AS parameter, 9D AS requested), struct('speed_scale' AS parameter, 1D AS requested)))")


PARR = f"{REAL}, pp10 AS (SELECT candidate_id, CASE WHEN bool_or(abs(realised - CASE parameter WHEN 'speed_mps' THEN 9 ELSE 1 END) > CASE parameter WHEN 'speed_mps' THEN 0.75 ELSE 0.15 END) THEN 'parameter_out_of_tolerance' END AS reason FROM rl WHERE parameter IN ('speed_mps', 'speed_scale') GROUP BY 1)"


@query("K10_parameter_realisation", f"{BASE}, {PARR} SELECT * FROM pp10")
def k10(spark, sf):
    return sg.parameter_stage(realised(spark, sf), requested(spark, sf), kinds(spark, sf))


def survivors(spark, sf, ids=None, frames=None):
    """Input of the diversity stage: local futures with quality, risk and signature."""
    t = typed(spark, sf, ids)
    origin = scene.states(spark, sf).where(f"timestep = {ANCHOR}").selectExpr("scenario_id", "track_id AS a", "x AS ox", "y AS oy", "heading AS oh")
    lx, ly = frm.local_point("x", "y", "ox", "oy", "oh")
    f = of(scene.candidates(spark, sf), ids).join(origin, ["scenario_id", "a"]).selectExpr("candidate_id", "timestep", f"{lx} AS x", f"{ly} AS y").groupBy("candidate_id").agg(
        F.expr("transform(sort_array(collect_list(struct(timestep, x, y))), s -> struct(s.x AS x, s.y AS y))").alias("future"))
    r = rk.clearance(wide(spark, sf) if frames is None else frames, ANCHOR, PAIRS3).selectExpr("candidate_id", "coalesce(value, 0D) AS risk")
    d = t.join(f, "candidate_id").where("size(future) = 14").join(r, "candidate_id").withColumn("skill_id", F.lit("cut_in_then_brake")).withColumn("quality_score", F.expr("abs(risk - 10.5) / 19"))
    return d.withColumn("signature", F.expr(dv.signature("future", (3, 6, 10, 13), "risk", "''"))).select("candidate_id", "scenario_id", "skill_id", "quality_score", "future", "signature")


@query("K11_diversity_stage")
def k11(spark, sf):
    return dv.greedy(survivors(spark, sf)).selectExpr("candidate_id", "reason")


@query("K12_whole_funnel")
def k12(spark, sf):
    """Every stage reads the rows of its survivors only; frames beside the other roles are made, once, for those that reach the risk stage."""
    cand, held = lambda alive: of(scene.candidates(spark, sf), alive), []

    def frames(alive):
        if not held:
            held.append(materialize(rk.with_end(fr.wide_frames(tasks(cand(alive)), cand(alive), scene.states(spark, sf), ANCHOR), END), "wide-alive"))
        return of(held[0], alive)
    st, roads = scene.states(spark, sf), scene.roads(spark, sf)
    names = [("schema_finite", lambda alive: sg.schema_finite(cand(alive), st, ANCHOR, LAST - ANCHOR)), ("history_invariants", lambda alive: sg.history_stage(cand(alive), st, ANCHOR)),
             ("kinematics", lambda alive: sg.kinematics(kin_source(spark, sf, alive), kinds(spark, sf, alive))), ("map", lambda alive: sg.map_stage(points(spark, sf, alive), roads, skilled(spark, sf, alive))),
             ("collision", lambda alive: sg.collision(laid(spark, sf, alive), typed(spark, sf, alive), st, ANCHOR)), ("target_risk", lambda alive: sg.target_risk(rk.clearance(frames(alive), ANCHOR, PAIRS3), 1.0, 20.0)),
             ("skill_trigger", lambda alive: triggered(spark, sf, alive, frames(alive))), ("parameter_realization", lambda alive: sg.parameter_stage(realised(spark, sf, alive), requested(spark, sf, alive), kinds(spark, sf, alive))),
             ("diversity", lambda alive: dv.greedy(survivors(spark, sf, alive, frames(alive))))]
    return sg.run_funnel(typed(spark, sf), names)


# --- conditions that need the seed or the map -------------------------------------------------------------
@query("V01_structural_condition", f"SELECT scenario_id, skill_id, true AS passed FROM ({rsq.finish(rsq.build()['chain_braking'], 'chain_braking', 'vehicle', True)})")
def v01(spark, sf):
    from roadsift.rules.catalog import RULES
    from roadsift.rules.detector import detect
    hits = detect(scene.states(spark, sf), scene.roads(spark, sf), [RULES["chain_braking"]], 1, scene.actors(spark, sf))
    return hits.selectExpr("scenario_id", "skill_id", "exists(map_values(measured), v -> v IS NOT NULL) AS passed")


@query("V01b_structural_condition_of_all_rules", f"SELECT scenario_id, skill_id, true AS passed FROM ({BEST_SQL})")
def v01b(spark, sf):
    return best_matches(spark, sf).selectExpr("scenario_id", "skill_id", "exists(map_values(measured), v -> v IS NOT NULL) AS passed")


LANE_OF = "lo AS (SELECT tk.candidate_id, al.lane AS pid FROM tk JOIN al ON al.scenario_id = tk.scenario_id AND al.track_id = tk.b WHERE al.lane IS NOT NULL)"


def _role_min(role: str) -> str:
    return f"""SELECT candidate_id, min(d) AS d FROM (SELECT q.candidate_id, {fm.norm('px - (x1 + f * (x2 - x1))', 'py - (y1 + f * (y2 - y1))')} AS d FROM (SELECT wd.candidate_id, {role}_x AS px, {role}_y AS py, s.x1, s.y1, s.x2, s.y2,
      {fm.seg_fraction(f'{role}_x', f'{role}_y', 's.x1', 's.y1', 's.x2', 's.y2')} AS f FROM wd JOIN lo USING (candidate_id) JOIN seg s ON s.pid = lo.pid WHERE timestep > 34 AND {role}_x IS NOT NULL) q) GROUP BY 1"""


@query("V05_shared_target_lane", f"{BASE}, {LANE_OF}, ma AS ({_role_min('a')}), mb AS ({_role_min('b')}) SELECT candidate_id, coalesce(ma.d <= 2.5 AND mb.d <= 2.5, false) AS passed FROM lo LEFT JOIN ma USING (candidate_id) LEFT JOIN mb USING (candidate_id)")
def v05(spark, sf):
    lane = scene.actors(spark, sf).where("lane IS NOT NULL").selectExpr("scenario_id", "track_id AS b", "lane AS polyline_id")
    goal = typed(spark, sf).join(lane, ["scenario_id", "b"]).select("candidate_id", "scenario_id", "polyline_id")
    pts = wide(spark, sf).where(f"timestep > {ANCHOR}").selectExpr("candidate_id", "inline(array(struct('a' AS role, a_x AS px, a_y AS py), struct('b' AS role, b_x AS px, b_y AS py)))").where("px IS NOT NULL")
    segs = ln.segments(scene.roads(spark, sf).where("polyline_type = 'lane_centerline'"))
    d = ln.project(pts.join(goal, "candidate_id").join(segs, ["scenario_id", "polyline_id"])).groupBy("candidate_id").agg(
        F.expr("min(distance) FILTER (WHERE role = 'a')").alias("da"), F.expr("min(distance) FILTER (WHERE role = 'b')").alias("db"))
    return goal.join(d, "candidate_id", "left").selectExpr("candidate_id", "coalesce(da <= 2.5 AND db <= 2.5, false) AS passed")


LSEQ = f"""n0 AS (SELECT candidate_id, timestep, pid, min(d) AS d FROM (SELECT q.candidate_id, q.timestep, q.pid, {fm.norm('a_x - (x1 + f * (x2 - x1))', 'a_y - (y1 + f * (y2 - y1))')} AS d
      FROM (SELECT wd.*, s.pid, s.x1, s.y1, s.x2, s.y2, {fm.seg_fraction('a_x', 'a_y', 's.x1', 's.y1', 's.x2', 's.y2')} AS f FROM wd, seg s WHERE s.ptype = 'lane_centerline') q) GROUP BY 1, 2, 3),
  n1 AS (SELECT candidate_id, timestep, pid AS lane FROM n0 QUALIFY row_number() OVER (PARTITION BY candidate_id, timestep ORDER BY d, pid) = 1),
  n2 AS (SELECT n.candidate_id, min(n.timestep) AS change FROM (SELECT *, lag(lane) OVER (PARTITION BY candidate_id ORDER BY timestep) AS prev FROM n1) n JOIN lane0 p ON p.pid = prev WHERE prev <> lane AND lane IN (p.left_id, p.right_id) GROUP BY 1),
  n3 AS (SELECT candidate_id, min(timestep) FILTER (WHERE fut AND {fm.forward('b_x - a_x', 'b_y - a_y', 'oa_heading')} <= 0) AS pass FROM w4 GROUP BY 1)"""


@query("V09_adjacent_lane_realised", f"{BASE}, {LSEQ} SELECT candidate_id, change AS change_frame, pass AS pass_frame, coalesce(change IS NOT NULL AND (pass IS NULL OR change <= pass), false) AS passed FROM n3 LEFT JOIN n2 USING (candidate_id)")
def v09(spark, sf):
    d = rows(spark, sf)
    pts = d.selectExpr("scenario_id", "candidate_id", "timestep", "a_x AS px", "a_y AS py")
    segs = ln.segments(scene.roads(spark, sf).where("polyline_type = 'lane_centerline'")).where("NOT broken")
    lane = ln.nearest_line(pts, segs, ["candidate_id", "timestep"], 60.0)
    moves = ln.transitions(lane.selectExpr("scenario_id", "candidate_id", "timestep", "m.polyline_id AS lane"), ["scenario_id", "candidate_id"])
    side = ln.lane_edges(scene.roads(spark, sf)).where("rel IN ('left', 'right')").select("scenario_id", "src", "dst")
    change = moves.join(side, ["scenario_id", "src", "dst"]).groupBy("candidate_id").agg(F.min("timestep").alias("change_frame"))
    passed = d.groupBy("candidate_id").agg(F.expr(cn.first(f"{fm.forward('b_x - a_x', 'b_y - a_y', 'oa_heading')} <= 0")).alias("pass_frame"))
    return passed.join(change, "candidate_id", "left").withColumn("passed", F.expr("change_frame IS NOT NULL AND (pass_frame IS NULL OR change_frame <= pass_frame)"))
