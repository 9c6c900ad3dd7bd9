"""Queries of the funnel where every candidate has its own rule: conflict points, target risk, trigger conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.funnel import ruled
from roadsift.operators import lanes as ln, tracks as tr
from roadsift.oracles import ruled_sql as rq
from roadsift.plans import scene
from roadsift.plans.funnel_queries import typed, wide
from roadsift.plans.registry import query

R = fm.rounded
ANCHOR, LAST = ad.ANCHOR, ad.LAST


def assigned(spark, sf):
    """Candidates with the rule they belong to (by id and index, so that all formal rules occur) and its columns."""
    return scene.once(spark, sf, "assigned", lambda: assign(spark, sf))


def assign(spark, sf):
    names = ", ".join(f"'{s}'" for s in ruled.FORMAL)
    t = typed(spark, sf).withColumn("skill_id", F.expr(f"array({names})[CAST((CAST(a AS BIGINT) + 11 * candidate_index) % {len(ruled.FORMAL)} AS INT)]"))
    t = t.join(F.broadcast(ruled.rules_table(spark)), "skill_id")
    return t.selectExpr("*", "IF(target_slot = 1, b, a) AS t0", "IF(target_slot = 1, a, b) AS t1", "c AS t2")


def rule_rows(spark, sf):
    """Rows without the rule's pairs and bounds: those are joined by ``ruled_by`` where they are read, never shuffled, sorted or written."""
    rule = assigned(spark, sf).selectExpr("candidate_id", "skill_id", "calculator", "target_slot", f"{ruled.BRAKES_AT} AS brakes_at")
    return scene.once(spark, sf, "rule_rows", lambda: ruled.by_slot(wide(spark, sf), rule, ANCHOR))


def ruled_by(spark, rows, column):
    """Rows with a column of their rule."""
    return rows.join(F.broadcast(ruled.rules_table(spark).select("skill_id", column)), "skill_id")


def recorded(spark, sf):
    """Recorded positions of the first two roles in the evaluated frames."""
    s = scene.states(spark, sf).where(f"timestep BETWEEN {ANCHOR} AND {LAST}")
    side = lambda t, r: s.select("scenario_id", F.col("track_id").alias(t), "timestep", "time_s", F.col("x").alias(f"{r}_x"), F.col("y").alias(f"{r}_y"))
    one = assigned(spark, sf).select("candidate_id", "scenario_id", "t0", "t1").join(side("t0", "a"), ["scenario_id", "t0"])
    return one.join(side("t1", "b").drop("time_s"), ["scenario_id", "t1", "timestep"], "left").select("candidate_id", "timestep", "time_s", "a_x", "a_y", "b_x", "b_y")


def recorded_crossings(spark, sf):
    return scene.once(spark, sf, "recorded_crossings", lambda: ruled.path_crossings(recorded(spark, sf)))


def seeds(spark, sf):
    """What each candidate's seed knows: lanes of the roles and, for rules that need generation, the recorded crossing where it came within two seconds."""
    lanes = scene.actors(spark, sf).select("scenario_id", "track_id", "lane")
    d = assigned(spark, sf).select("candidate_id", "scenario_id", "skill_id", "mode", "candidate_index", "t0", "t1", "t2")
    for t, name in (("t0", "lane_a"), ("t1", "lane_b"), ("t2", "lane_c")):
        d = d.join(lanes.withColumnsRenamed({"track_id": t, "lane": name}), ["scenario_id", t], "left")
    past = recorded_crossings(spark, sf).where("gap <= 2.0").selectExpr("candidate_id", "cx AS seed_x", "cy AS seed_y")
    known = lambda c: F.when(F.col("mode") == "compatible_seed", F.col(c)).alias(c)
    return scene.once(spark, sf, "seeds", lambda: d.join(past, "candidate_id", "left").select(*d.columns, known("seed_x"), known("seed_y")))


def points(spark, sf):
    return scene.once(spark, sf, "conflict_points", lambda: ruled.conflict_points(rule_rows(spark, sf), recorded(spark, sf), seeds(spark, sf), scene.roads(spark, sf), recorded_crossings(spark, sf)))


def evaluated_rows(spark, sf, where="true"):
    """Rows of the candidates whose rule is wanted, with their events."""
    return ruled.with_events(rule_rows(spark, sf).where(where).join(points(spark, sf), "candidate_id"))


@query("M14b_conflict_point_chain", f"{rq.base()} SELECT candidate_id, {R('px')} AS px, {R('py')} AS py, any_value(point_source) AS point_source, any_value(expo) AS exposure_frame, any_value(cut) AS cut_in_frame, any_value(stage) AS stage_frame FROM cp JOIN e2 USING (candidate_id) GROUP BY candidate_id, px, py")
def m14b(spark, sf):
    events = evaluated_rows(spark, sf).groupBy("candidate_id").agg(*[F.max(c).alias(n) for c, n in (("exposure_frame", "exposure_frame"), ("cut_frame", "cut_in_frame"), ("stage_frame", "stage_frame"))])
    return points(spark, sf).join(events, "candidate_id").selectExpr("candidate_id", f"{R('px')} AS px", f"{R('py')} AS py", "point_source", "exposure_frame", "cut_in_frame", "stage_frame")


def target_risk(spark, sf):
    return ruled.target_check(ruled.risk_by_rule(ruled_by(spark, evaluated_rows(spark, sf), "pairs"), ANCHOR), ruled.rules_table(spark))


@query("K08b_target_risk_by_rule", f"""{rq.base()}, {rq.risk()} SELECT candidate_id, skill_id, metric, status, reason, {R('value', 5)} AS value, pair,
  CASE WHEN value IS NULL THEN 'risk_metric_unavailable' WHEN value < low OR value > high THEN 'risk_out_of_target_range' END AS rejection FROM ev""")
def k08b(spark, sf):
    return target_risk(spark, sf).selectExpr("candidate_id", "skill_id", "metric", "status", "reason", f"{R('value', 5)} AS value", "pair", "rejection")


# --- trigger conditions ---------------------------------------------------------------------------------
#: What a seed shows, from the recorded roles at the anchor: names of matched conditions, and evidence fields.
MATCHED = {"three_vehicle_queue": "lane_a = lane_b AND lane_b = lane_c", "blockage_ahead": "lane_a = lane_b", "priority_roles_assignable": "lane_a <> lane_b", "response_space_available": "left_b IS NOT NULL OR right_b IS NOT NULL",
           "crossing_flow_present": "abs(vx_a * vy_b - vy_a * vx_b) > 1e-9"}
FIELDS = {"conflict_point_xy": "seed_x IS NOT NULL", "actor_heading_difference_deg": "heading_a IS NOT NULL AND heading_b IS NOT NULL", "initiator_lane_diverges": "diverges_a", "lanes_converge": "lane_a <> lane_b AND arrays_overlap(succ_a, succ_b)",
          "minimum_object_path_clearance_m": "type_a IN ('static', 'construction')", "drivable_boundary_distance_m": "type_a = 'pedestrian'", "intersection_entry_distance_m": "cross_a", "crossing_vehicle_arrival_s": "speed_b >= 1", "leading_arrival_time_s": "speed_b >= 1"}
CONDITIONAL = ", ".join(f"'{s}'" for s in ruled.CONDITIONS)


def seed_facts(spark, sf):
    """Seeds of rules that need generation: matched conditions, evidence fields, and the conditions that the seed lacks
    (even candidates: all of the rule; odd ones: those that only the overlay can show)."""
    known = scene.actors(spark, sf).selectExpr("scenario_id", "track_id", "object_type AS type", "vx", "vy", "speed", "heading", "diverges", "succ", "left_id AS left", "right_id AS right", "in_cross AS cross")
    d = seeds(spark, sf).where(f"skill_id IN ({CONDITIONAL})")
    for t, r in (("t0", "a"), ("t1", "b")):
        d = d.join(known.select("scenario_id", F.col("track_id").alias(t), *[F.col(c).alias(f"{c}_{r}") for c in known.columns[2:]]), ["scenario_id", t], "left")
    found = lambda table: F.expr("filter(array(" + ", ".join(f"IF({e}, '{n}', NULL)" for n, e in table.items()) + "), n -> n IS NOT NULL)")
    lacking = ruled.conditions_table(spark).groupBy("skill_id").agg(F.sort_array(F.collect_list("condition")).alias("every"), F.sort_array(F.expr("collect_list(condition) FILTER (WHERE evaluator <> 'structural')")).alias("made"))
    return d.withColumns({"matched": found(MATCHED), "fields": found(FIELDS)}).join(F.broadcast(lacking), "skill_id").withColumn("missing", F.expr("IF(candidate_index % 2 = 0, every, made)"))


def lane_facts(spark, sf, rows, facts):
    """lane_shared: both lane changers come within 2.5 m of the seed's shared lane; lane_realised: the vehicle starts on its seed's lane and
    moves to a neighbouring one before it passes the blockage."""
    segs = ln.segments(scene.roads(spark, sf).where("polyline_type = 'lane_centerline'"))
    goal = facts.where("skill_id = 'simultaneous_lane_change_conflict' AND lane_b IS NOT NULL").select("candidate_id", "scenario_id", F.col("lane_b").alias("polyline_id"))
    pts = rows.where("fut").selectExpr("candidate_id", "inline(array(struct('a' AS role, a_x AS px, a_y AS py), struct('b' AS role, b_x AS px, b_y AS py)))").where("px IS NOT NULL")
    d = ln.project(pts.join(goal, "candidate_id").join(segs, ["scenario_id", "polyline_id"])).groupBy("candidate_id").agg(F.expr("min(distance) FILTER (WHERE role = 'a')").alias("da"), F.expr("min(distance) FILTER (WHERE role = 'b')").alias("db"))
    shared = d.selectExpr("candidate_id", "coalesce(da <= 2.5 AND db <= 2.5, false) AS lane_shared")
    own = facts.where("skill_id = 'forced_lane_change_around_blockage' AND (left_b IS NOT NULL OR right_b IS NOT NULL)").select("candidate_id", "scenario_id", "lane_b")
    mine = rows.select("candidate_id", "timestep", "fut", "a_x", "a_y", "b_x", "b_y", "ob_heading").join(own, "candidate_id")
    lane = ln.nearest_line(mine.selectExpr("scenario_id", "candidate_id", "timestep", "b_x AS px", "b_y AS py").where("px IS NOT NULL"), segs.where("NOT broken"), ["candidate_id", "timestep"], 60.0).selectExpr("scenario_id", "candidate_id", "timestep", "m.polyline_id AS lane")
    side = ln.lane_edges(scene.roads(spark, sf)).where("rel IN ('left', 'right')").select("scenario_id", "src", "dst")
    change = ln.transitions(lane, ["scenario_id", "candidate_id"]).join(side, ["scenario_id", "src", "dst"]).groupBy("candidate_id").agg(F.min("timestep").alias("change"))
    start = lane.where(f"timestep = {ANCHOR}").select("candidate_id", F.col("lane").alias("start"))
    passed = mine.groupBy("candidate_id").agg(F.first("lane_b").alias("lane_b"), F.expr(f"min(timestep) FILTER (WHERE fut AND {fm.forward('a_x - b_x', 'a_y - b_y', 'ob_heading')} <= 0)").alias("pass"), F.expr("max(ob_heading) IS NOT NULL").alias("headed"))
    realised = passed.join(change, "candidate_id").join(start, "candidate_id").selectExpr("candidate_id", "headed AND start = lane_b AND (pass IS NULL OR change <= pass) AS lane_realised")
    return shared.join(realised, "candidate_id", "full")


def past_speed(spark, sf):
    """Greatest recorded speed of re-entering vehicles in the stopped duration of their rule before the anchor."""
    mine = assigned(spark, sf).where("skill_id = 'stopped_vehicle_reentry'").selectExpr("candidate_id", "scenario_id", "t0 AS track_id", f"{ruled.bound('minimum_stopped_duration_s', 1.0)} AS hold")
    past = tr.speeds(scene.states(spark, sf).where(f"timestep <= {ANCHOR}").join(mine.select("scenario_id", "track_id").distinct(), ["scenario_id", "track_id"], "left_semi"))
    return mine.join(past.select("scenario_id", "track_id", "timestep", "speed"), ["scenario_id", "track_id"]).where(f"timestep >= {ANCHOR} - 10 * hold - 1e-9").groupBy("candidate_id").agg(F.max("speed").alias("past_speed"))


def triggers(spark, sf):
    facts = scene.once(spark, sf, "seed_facts", lambda: seed_facts(spark, sf))
    rows = scene.once(spark, sf, "condition_rows", lambda: evaluated_rows(spark, sf, f"skill_id IN ({CONDITIONAL})"))
    return ruled.trigger_check(ruled.verdicts(ruled_by(spark, rows, "bounds"), facts, lane_facts(spark, sf, rows, facts), past_speed(spark, sf)), ruled.conditions_table(spark))


@query("K09b_conditions_by_rule", f"{rq.base()}, {rq.conditions()} SELECT candidate_id, skill_id, failed, CASE WHEN failed <> '' THEN 'skill_trigger_not_realized' END AS reason FROM tc")
def k09b(spark, sf):
    return triggers(spark, sf)
