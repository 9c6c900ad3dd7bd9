"""Rules over three actors: nearest front / rear neighbours, gaps, reveals, merges and groups.

Each starts from the gated pair table and picks neighbours with ``min(struct(...))``,
so a hot scenario is pre-aggregated before it is shuffled by actor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import lanes as ln, pairs as pr, tracks as tr
from roadsift.operators.grid import CELL, box_cells, point_cell
from roadsift.rules.catalog import RULES, Rule
from roadsift.rules.pair_rules import all_of, bound_list, in_horizon, large, mean, merge_swap, arrival, risk, small

#: Actors without a lane: beyond the largest gap (110 m) and side offset (10 m) of any rule over three actors.
WIDE_RADIUS = 150.0
NO_CONTEXT = "CAST(map() AS MAP<STRING, DOUBLE>)"


def emit(df: DataFrame, rule: Rule, roles: tuple[str, str, str], measured: dict[str, str], score: str, value: str,
         metric: str | None = None, where: str = "true", frames: tuple[str, str, str] = ("ha", "hb", "hc"),
         lanes: tuple[str, str] = ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)"), target: str = "CAST(NULL AS STRING)",
         context: str = NO_CONTEXT) -> DataFrame:
    # parsed piece by piece, as in the rules over two actors
    ok = df.where(all_of([where, *bound_list(rule, measured), f"({value}) IS NOT NULL"]))
    numbers = F.create_map(*[c for n, e in measured.items() for c in (F.lit(n), F.expr(e).cast("double"))])
    out = ok.withColumns({"measured_": numbers, "score_": F.expr(fm.clamp01(score)).cast("double"), "value_": F.expr(value).cast("double")})
    return out.selectExpr(
        "scenario_id", f"'{rule.skill_id}' AS skill_id", f"{roles[0]} AS initiator", f"{roles[1]} AS responder", f"{roles[2]} AS extra",
        "score_ AS score", f"{metric or repr(rule.metric)} AS risk_metric", "value_ AS risk_value",
        "measured_ AS measured", f"{context} AS context", f"{lanes[0]} AS initiator_lane", f"{lanes[1]} AS responder_lane",
        f"{target} AS target_lane", f"size(array_intersect(array_intersect({frames[0]}, {frames[1]}), {frames[2]})) AS shared_steps")


def both_ways(scene, skills: list[str], full: DataFrame, needs: set[str]) -> DataFrame:
    """All ordered pairs among the actors of a rule whose two type lists are the same."""
    return scene.enrich(scene.pairs(skills, full, needs, WIDE_RADIUS), needs)


def queue(scene, skill: str) -> DataFrame:
    """chain_braking and multi_vehicle_gap_squeeze: nearest front and rear of every middle vehicle."""
    rule = RULES[skill]
    chain = skill == "chain_braking"
    lo = rule["minimum_queue_gap_m"] if chain else rule["minimum_current_separation_m"]
    hi = rule["maximum_queue_gap_m"] if chain else rule["maximum_front_gap_m"]
    p = both_ways(scene, [skill], scene.full_actors(), set())
    front, rear = pr.gap("b", "a"), pr.gap("a", "b")
    item = lambda gap: f"struct({gap} AS gap, b AS id, dist, b_speed AS speed, b_hist_frames AS h, b_lane AS lane)"
    related = pr.same_or_successor("b", "a")
    best = p.where(related).groupBy("scenario_id", "a").agg(
        F.expr(f"min({item(front)}) FILTER (WHERE {front} BETWEEN {lo} AND {hi})").alias("f"),
        F.expr(f"min({item(rear)}) FILTER (WHERE {rear} BETWEEN {lo} AND {hi})").alias("r"),
        F.max("a_speed").alias("speed"), F.first("a_hist_frames").alias("h"), F.max("a_lane").alias("lane"))
    best = best.where("f.id <> r.id")
    fc, rc = "(speed - f.speed)", "(r.speed - speed)"
    both = f"(greatest(CAST(0 AS DOUBLE), {fc}) + greatest(CAST(0 AS DOUBLE), {rc}))"
    near, slow = "least(f.dist, r.dist)", "least(f.speed, speed, r.speed)"
    room = small("f.gap + r.gap", str(2 * hi))
    if chain:
        m = {"minimum_queue_gap_m": "least(f.gap, r.gap)", "maximum_queue_gap_m": "greatest(f.gap, r.gap)",
             "minimum_moving_speed_mps": slow, "minimum_vehicle_center_distance_m": near}
        return emit(best, rule, ("f.id", "a", "r.id"), m, mean(room, large(f"greatest({fc}, {rc})", "0.5")), "least(f.gap, r.gap)",
                    where=f"greatest({fc}, {rc}) > 0", frames=("f.h", "h", "r.h"), lanes=("f.lane", "lane"))
    m = {"maximum_front_gap_m": "f.gap", "maximum_rear_gap_m": "r.gap", "minimum_combined_closing_speed_mps": both,
         "minimum_current_separation_m": near}
    return emit(best, rule, ("a", "f.id", "r.id"), m, mean(room, large(both, "0.5")), "least(f.gap, r.gap)",
                frames=("h", "f.h", "r.h"), lanes=("lane", "f.lane"))


def reveal(scene) -> DataFrame:
    rule = RULES["cut_out_reveals_slow_vehicle"]
    lo, hi = rule["minimum_queue_gap_m"], rule["maximum_queue_gap_m"]
    full = scene.full_actors()
    p = both_ways(scene, [rule.skill_id], full, set()).where("a_lane IS NOT NULL AND b_lane IS NOT NULL AND (a_left_id IS NOT NULL OR a_right_id IS NOT NULL)")
    behind, ahead = pr.gap("a", "b"), pr.gap("b", "a")
    key = ["scenario_id", "a"]
    follow = p.where(f"{pr.same_or_successor('a', 'b')} AND {behind} BETWEEN {lo} AND {hi}").groupBy(*key).agg(
        F.expr(f"min(struct({behind} AS gap, b AS id))").alias("f"))
    lead = p.join(follow, key).where(f"b <> f.id AND {pr.same_or_successor('b', 'a')} AND {ahead} BETWEEN {lo} AND {hi} AND b_speed <= {rule['maximum_slow_vehicle_speed_mps']}")
    best = lead.groupBy(*key).agg(F.expr(f"min(struct({ahead} AS gap, b AS id))").alias("s"), F.max("f").alias("f"),
                                  F.max("a_lateral").alias("lateral"), F.first("a_hist_frames").alias("ha"), F.max("a_lane").alias("cut_lane"))
    slim = full.drop("past", "init_mask", "resp_mask")
    both = best.selectExpr("scenario_id", "a AS cut", "f.id AS a", "s.id AS b", "f.gap AS back_gap", "s.gap AS front_gap", "lateral", "ha AS hc", "cut_lane")
    both = pr.with_min_ttc(pr.attach(pr.attach(both, slim, "a"), slim, "b"))
    gap = pr.gap("b", "a")
    seen = in_horizon("min_ttc")
    part = f"CASE WHEN {seen} THEN {risk(rule, 'min_ttc')} ELSE {small(gap, str(2 * hi))} END"
    m = {"maximum_slow_vehicle_speed_mps": "b_speed", "maximum_queue_gap_m": "greatest(back_gap, front_gap)", "minimum_queue_gap_m": "least(back_gap, front_gap)"}
    return emit(both, rule, ("cut", "a", "b"), m, f"0.5 + 0.25 * (CASE WHEN abs(lateral) > 0.5 THEN 1 ELSE 0 END) + 0.25 * ({part})",
                f"CASE WHEN {seen} THEN min_ttc ELSE {gap} END", f"CASE WHEN {seen} THEN '{rule.metric}' ELSE 'newly_exposed_longitudinal_gap' END",
                where=f"{gap} > 0", frames=("hc", "a_hist_frames", "b_hist_frames"), lanes=("cut_lane", "a_lane"))


def _side(gap: str, more: str = "") -> str:
    return f"struct({gap} AS gap, b AS id, min_ttc AS ttc{more}, b_hist_frames AS h, b_lane AS lane)"


def least_ttc(*parts: str) -> str:
    """Least TTC inside the horizon (NULL when none is)."""
    return "least(" + ", ".join(f"(CASE WHEN {in_horizon(p)} THEN {p} END)" for p in parts) + ")"


def narrow_gap(scene) -> DataFrame:
    rule = RULES["narrow_gap_lane_change"]
    p = scene.enrich(scene.pairs([rule.skill_id], scene.full_actors(), set(), WIDE_RADIUS).where(
        f"abs(a_lateral) >= {rule['minimum_lateral_displacement_m']} AND {pr.adjacent('a', 'b')}"), {"min_ttc"})
    ahead = pr.fwd("b", "a")
    best = p.groupBy("scenario_id", "a").agg(
        F.expr(f"min({_side(ahead)}) FILTER (WHERE {ahead} > 0 AND {ahead} <= 15)").alias("f"),
        F.expr(f"min({_side(f'(0 - {ahead})')}) FILTER (WHERE {ahead} < 0 AND {ahead} >= -15)").alias("r"),
        F.max("a_lateral").alias("lateral"), F.first("a_hist_frames").alias("ha"), F.max("a_lane").alias("lane"))
    value = least_ttc("f.ttc", "r.ttc")
    m = {"minimum_lateral_displacement_m": "abs(lateral)", "maximum_front_gap_m": "f.gap", "maximum_rear_gap_m": "r.gap"}
    return emit(best, rule, ("a", "f.id", "r.id"), m, mean(large("abs(lateral)", "2.0"), small("f.gap + r.gap", "30.0"), risk(rule, value)),
                value, frames=("ha", "f.h", "r.h"), lanes=("lane", "f.lane"))


def cyclist_merge(scene) -> DataFrame:
    rule = RULES["cyclist_vehicle_merge"]
    p = scene.pairs([rule.skill_id], scene.full_actors(), set(), WIDE_RADIUS).where(
        f"a_lane IS NOT NULL AND b_lane IS NOT NULL AND abs(a_lateral) >= {rule['minimum_lateral_displacement_m']} AND {pr.adjacent('a', 'b')}")
    p = scene.enrich(p, {"min_ttc", "min_dist", "on_lane"})
    ends = p.selectExpr("scenario_id", "a", "b_lane AS polyline_id", "a_end_x AS px", "a_end_y AS py").distinct()
    hit = ln.project_on(ends, scene.segs, ["a"]).selectExpr("scenario_id", "a", "polyline_id AS b_lane", "distance AS end_dist", "lane_heading")
    p = p.join(hit, ["scenario_id", "a", "b_lane"]).where("end_dist <= 5.0 AND end_dist < at_lane_dist")
    ahead = "(b_lane_arc - at_lane_arc)"
    best = p.groupBy("scenario_id", "a", "b_lane").agg(
        F.expr(f"min({_side(ahead, ', min_dist')}) FILTER (WHERE {ahead} > 0 AND {ahead} <= 30)").alias("f"),
        F.expr(f"min({_side(f'(0 - {ahead})', ', min_dist')}) FILTER (WHERE {ahead} < 0 AND {ahead} >= -30)").alias("r"),
        F.max("a_lateral").alias("lateral"), F.first("a_hist_frames").alias("ha"), F.max("a_lane").alias("lane"),
        F.max(F.expr(f"degrees({fm.heading_gap('a_end_heading', 'lane_heading')})")).alias("turn")).where("f.id <> r.id")
    ttc = least_ttc("f.ttc", "r.ttc")
    near = "least(f.min_dist, r.min_dist)"
    m = {"minimum_lateral_displacement_m": "abs(lateral)", "maximum_front_gap_m": "f.gap", "maximum_rear_gap_m": "r.gap",
         "maximum_merge_heading_difference_deg": "turn"}
    part = f"CASE WHEN {ttc} IS NOT NULL THEN {risk(rule, ttc)} ELSE {small(near, '70.0')} END"
    return emit(best, rule, ("a", "f.id", "r.id"), m, mean(large("abs(lateral)", "0.5"), small("f.gap + r.gap", "60.0"), part),
                f"coalesce({ttc}, {near})", f"CASE WHEN {ttc} IS NOT NULL THEN '{rule.metric}' ELSE 'minimum_front_rear_trajectory_distance' END",
                frames=("ha", "f.h", "r.h"), lanes=("lane", "f.lane"), target="b_lane")


def filtering(scene) -> DataFrame:
    rule = RULES["motorcyclist_filtering_conflict"]
    sep, reach, gap_max = (rule[n] for n in ("minimum_current_separation_m", "maximum_motorcyclist_vehicle_distance_m", "maximum_filtering_vehicle_gap_m"))
    p = scene.pairs([rule.skill_id], scene.full_actors(), set(), reach).where(
        f"a_speed >= {rule['minimum_moving_speed_mps']} AND dist BETWEEN {sep} AND {reach}")
    p = p.selectExpr("scenario_id", "a", "b", "dist", "b_x AS x", "b_y AS y", "a_x", "a_y", "a_speed", "a_hist_frames AS ha", "b_hist_frames AS h", "a_lane", "b_lane")
    # the two vehicles meet on a grid of the largest gap; the nearer one (ties by id) comes first
    other = point_cell(p.selectExpr("scenario_id", "a", "b AS c", "dist AS dist2", "x AS x2", "y AS y2", "h AS h2"), "x2", "y2", gap_max)
    q = box_cells(p, "x", "y", "x", "y", gap_max, gap_max).join(other, [*CELL, "a"]).where("dist < dist2 OR dist = dist2 AND b < c")
    gap = fm.norm("x2 - x", "y2 - y")
    pos = "(((a_x - x) * (x2 - x) + (a_y - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))"
    off = fm.norm(f"a_x - (x + {pos} * (x2 - x))", f"a_y - (y + {pos} * (y2 - y))")
    m = {"minimum_moving_speed_mps": "a_speed", "maximum_filtering_vehicle_gap_m": gap, "maximum_motorcyclist_vehicle_distance_m": "greatest(dist, dist2)",
         "minimum_current_separation_m": f"least(dist, dist2, {gap})"}
    where = f"{gap} BETWEEN {sep} AND {gap_max} AND {pos} BETWEEN 0.1 AND 0.9 AND {off} <= {min(3.0, gap_max / 2)}"
    return emit(q, rule, ("a", "b", "c"), m, mean(small(gap, str(gap_max)), small("greatest(dist, dist2)", str(reach))), "least(dist, dist2)",
                where=where, frames=("ha", "h", "h2"), lanes=("a_lane", "b_lane"))


def zipper(scene) -> DataFrame:
    rule = RULES["zipper_merge_multi_vehicle"]
    sep, gap_max = rule["minimum_current_separation_m"], rule["maximum_competing_vehicle_gap_m"]
    full = scene.full_actors()
    p = scene.pairs([rule.skill_id], full, set())
    p = scene._convergence(p, p).where("a < b AND two_x IS NOT NULL")
    swap, decided = merge_swap("two_", True)
    pick = lambda c: [f"IF({swap}, b_{c}, a_{c}) AS m_{c}", f"IF({swap}, a_{c}, b_{c}) AS k_{c}"]
    p = p.where(decided).selectExpr("scenario_id", "two_x AS x", "two_y AS y", "two_target AS target", f"IF({swap}, b, a) AS m", f"IF({swap}, a, b) AS k",
                                    *[e for c in ("x", "y", "speed", "hist_frames", "lane") for e in pick(c)])
    merging = fm.norm("x - m_x", "y - m_y")
    reach = f"greatest({merging}, {fm.norm('x - k_x', 'y - k_y')})"
    p = p.where(f"{reach} <= {rule['maximum_convergence_distance_m']}")
    # third vehicle on the same flow: b beside main vehicle a; signed gap > 0 puts the third in front
    t = both_ways(scene, [rule.skill_id], full, set()).where(pr.same_or_successor("b", "a"))
    gap = pr.gap("b", "a")
    t = t.where(f"abs({gap}) BETWEEN {sep} AND {gap_max}").selectExpr(
        "scenario_id", "a AS k", f"struct(abs({gap}) AS size, b AS id, {gap} AS gap, b_x AS x, b_y AS y, b_speed AS speed, b_hist_frames AS h) AS t")
    q = p.join(t, ["scenario_id", "k"]).where("t.id <> m")
    roles = [c for c in p.columns if c not in ("scenario_id", "m", "k")]
    q = q.groupBy("scenario_id", "m", "k", "target").agg(F.min("t").alias("t"), *[F.first(c).alias(c) for c in roles if c != "target"])
    lead = lambda mine, third: f"IF(t.gap > 0, {third}, {mine})"
    trail = lambda mine, third: f"IF(t.gap > 0, {mine}, {third})"
    reach = f"greatest({merging}, {fm.norm('x - k_x', 'y - k_y')})"
    time = lambda px, py, v: f"(CASE WHEN {v} > 1e-6 THEN {fm.norm(f'x - {px}', f'y - {py}')} / {v} END)"
    q = q.selectExpr("*", f"{time('m_x', 'm_y', 'm_speed')} AS tm", f"{time('k_x', 'k_y', 'k_speed')} AS tk", f"{time('t.x', 't.y', 't.speed')} AS tt",
                     f"least({fm.norm('m_x - k_x', 'm_y - k_y')}, {fm.norm('m_x - t.x', 'm_y - t.y')}, {fm.norm('k_x - t.x', 'k_y - t.y')}) AS near",
                     f"{reach} AS reach")
    late = "greatest(abs(tm - tk), abs(tm - tt))"
    order = "sort_array(array(tm, tk, tt))"
    m = {"maximum_convergence_distance_m": "reach", "maximum_competing_vehicle_gap_m": "t.size", "maximum_arrival_time_gap_s": late,
         "minimum_current_separation_m": "near"}
    return emit(q, rule, ("m", lead("k", "t.id"), trail("k", "t.id")), m, mean(small("reach", "60.0"), small(late, "5.0")),
                f"least({order}[1] - {order}[0], {order}[2] - {order}[1])", where="tm IS NOT NULL AND tk IS NOT NULL AND tt IS NOT NULL",
                frames=("m_hist_frames", "k_hist_frames", "t.h"), lanes=("m_lane", "k_lane"), target="target", context="map('cx', x, 'cy', y)")


def reentry(scene) -> DataFrame:
    rule = RULES["stopped_vehicle_reentry"]
    near = rule["minimum_vehicle_center_distance_m"]
    still = tr.trailing_stop(scene.states, rule["stopped_speed_mps"])
    p = pr.attach(scene.pairs([rule.skill_id], scene.full_actors(), set(), WIDE_RADIUS), still, "a").where(
        f"a_speed <= {rule['stopped_speed_mps']} AND b_speed >= {rule['minimum_moving_speed_mps']} AND dist >= {near} AND b_lane IS NOT NULL "
        f"AND ({pr.same_or_successor('a', 'b')} OR {pr.adjacent('a', 'b')})")
    p = scene.enrich(p, {"min_dist", "min_ttc", "on_lane"}).where(
        f"at_lane_dist <= {rule['maximum_lateral_reentry_distance_m']} AND min_dist >= {near}")
    ahead = "(b_lane_arc - at_lane_arc)"
    more = ", min_dist, b_speed AS speed"
    best = p.groupBy("scenario_id", "a", "b_lane").agg(
        F.expr(f"min({_side(ahead, more)}) FILTER (WHERE {ahead} BETWEEN {near} AND {rule['maximum_front_gap_m']})").alias("f"),
        F.expr(f"min({_side(f'(0 - {ahead})', more)}) FILTER (WHERE (0 - {ahead}) BETWEEN {near} AND {rule['maximum_rear_gap_m']})").alias("r"),
        F.max("a_speed").alias("speed"), F.max("a_standing_s").alias("still"), F.max("at_lane_dist").alias("side"),
        F.first("a_hist_frames").alias("ha"), F.max("a_lane").alias("lane")).where("f.id <> r.id")
    ttc, dist = least_ttc("f.ttc", "r.ttc"), "least(f.min_dist, r.min_dist)"
    part = f"CASE WHEN {ttc} IS NOT NULL THEN {risk(rule, ttc)} ELSE {small(dist, '55.0')} END"
    m = {"stopped_speed_mps": "speed", "minimum_stopped_duration_s": "still", "minimum_moving_speed_mps": "least(f.speed, r.speed)",
         "minimum_vehicle_center_distance_m": dist, "maximum_lateral_reentry_distance_m": "side", "maximum_front_gap_m": "f.gap", "maximum_rear_gap_m": "r.gap"}
    return emit(best, rule, ("a", "f.id", "r.id"), m, mean(small("speed", "0.500001"), large("still", "1.0"), part), f"coalesce({ttc}, {dist})",
                f"CASE WHEN {ttc} IS NOT NULL THEN '{rule.metric}' ELSE 'minimum_front_rear_trajectory_distance_proxy' END",
                frames=("ha", "f.h", "r.h"), lanes=("lane", "f.lane"), target="b_lane")


def group_walkers(scene) -> DataFrame:
    rule = RULES["group_pedestrian_crossing"]
    full = scene.full_actors()
    p = scene.enrich(scene.pairs([rule.skill_id], full, set()), {"min_dist"}).join(pr.conflicts(scene.actors), ["scenario_id", "a", "b"])
    p = p.where("time_gap <= 4.0 AND min_dist <= 6.0").selectExpr(
        "scenario_id", "b AS car", "a", "dist", "time_gap", "min_dist", "cx", "cy", "a_x AS x", "a_y AS y", "a_heading AS h", "a_hist_frames AS ha", "b_hist_frames AS hb")
    two = p.selectExpr("scenario_id", "car", "a AS c", "time_gap AS gap2", "min_dist AS min2", "cx AS cx2", "cy AS cy2", "x AS x2", "y AS y2", "h AS h2", "ha AS hc")
    # members stand within 5 m of each other: meet on the car and a 5 m grid, not on the car alone
    from roadsift.operators.grid import box_cells, point_cell
    reach = rule["maximum_group_member_distance_m"]
    left = point_cell(p, "x", "y", reach)
    right = box_cells(two, "x2", "y2", "x2", "y2", reach, reach)
    member, turn = fm.norm("x - x2", "y - y2"), f"degrees({fm.heading_gap('h', 'h2')})"
    q = left.join(right, ["scenario_id", "car", "cell_x", "cell_y"]).where(
        f"a <> c AND {member} <= {reach} AND {turn} <= {rule['maximum_group_heading_difference_deg']} AND {fm.norm('cx - cx2', 'cy - cy2')} <= 6.0")
    best = q.groupBy("scenario_id", "car", "a").agg(
        F.expr(f"min(struct({member} AS d, {turn} AS turn, min2, c, gap2, hc))").alias("s"), F.max("dist").alias("dist"),
        F.max("time_gap").alias("time_gap"), F.max("min_dist").alias("min_dist"), F.max("cx").alias("cx"), F.max("cy").alias("cy"),
        F.first("ha").alias("ha"), F.first("hb").alias("hb"))
    first = Window.partitionBy("scenario_id", "car", F.expr("least(a, s.c)"), F.expr("greatest(a, s.c)")).orderBy("dist", "a")
    best = best.withColumn("n", F.row_number().over(first)).where("n = 1")
    m = {"maximum_group_member_distance_m": "s.d", "maximum_group_heading_difference_deg": "s.turn",
         "maximum_arrival_time_gap_s": "greatest(time_gap, s.gap2)", "maximum_conflict_distance_m": "greatest(min_dist, s.min2)"}
    value = "least(time_gap, s.gap2)"
    return emit(best, rule, ("a", "car", "s.c"), m, mean(small("s.d", "5.0"), risk(rule, value)), value, frames=("ha", "hb", "s.hc"),
                context="map('cx', cx, 'cy', cy)")


TRIPLES = {
    "chain_braking": lambda s: queue(s, "chain_braking"), "multi_vehicle_gap_squeeze": lambda s: queue(s, "multi_vehicle_gap_squeeze"),
    "cut_out_reveals_slow_vehicle": reveal, "narrow_gap_lane_change": narrow_gap, "cyclist_vehicle_merge": cyclist_merge,
    "motorcyclist_filtering_conflict": filtering, "zipper_merge_multi_vehicle": zipper, "stopped_vehicle_reentry": reentry,
    "group_pedestrian_crossing": group_walkers,
}
