"""P, F and A operators on single tracks."""

from __future__ import annotations

from roadsift.functions import formulas as fm
from roadsift.operators import frames as fr, tracks as tr
from roadsift.oracles import scene_sql as sc
from roadsift.plans import scene
from roadsift.plans.registry import query

R = fm.rounded
BASE = sc.base()
KEYS = "scenario_id, track_id"
ANCHOR = 34
MINIMUM = 30


def r(*names: str) -> list[str]:
    return [f"{R(n)} AS {n}" for n in names]


def show(*names: str) -> str:
    return ", ".join(r(*names))


@query("P01_global_to_local", f"""{BASE} SELECT {KEYS}, timestep, {R('cos(a.heading) * (s.x - a.x) + sin(a.heading) * (s.y - a.y)')} AS lx,
  {R('cos(a.heading) * (s.y - a.y) - sin(a.heading) * (s.x - a.x)')} AS ly FROM st s JOIN ac a USING (scenario_id, track_id)""")
def p01(spark, sf):
    st = scene.states(spark, sf)
    origin = tr.reference_states(st).selectExpr("scenario_id", "track_id", "x AS ox", "y AS oy", "heading AS oh")
    lx, ly = fr.local_point("x", "y", "ox", "oy", "oh")
    return st.join(origin, tr.KEY).selectExpr(*tr.KEY, "timestep", f"{R(lx)} AS lx", f"{R(ly)} AS ly")


@query("P02_local_to_global", f"""{BASE} SELECT {KEYS}, timestep, {R('a.x + s.x * cos(a.heading) - s.y * sin(a.heading)')} AS gx,
  {R('a.y + s.x * sin(a.heading) + s.y * cos(a.heading)')} AS gy FROM st s JOIN ac a USING (scenario_id, track_id)""")
def p02(spark, sf):
    st = scene.states(spark, sf)
    origin = tr.reference_states(st).selectExpr("scenario_id", "track_id", "x AS ox", "y AS oy", "heading AS oh")
    gx, gy = fr.global_point("x", "y", "ox", "oy", "oh")
    return st.join(origin, tr.KEY).selectExpr(*tr.KEY, "timestep", f"{R(gx)} AS gx", f"{R(gy)} AS gy")


@query("P03_wrap_angle", f"""{BASE} SELECT {KEYS}, timestep, {R('atan2(sin(heading * 3 + x / 7), cos(heading * 3 + x / 7))')} AS wrapped FROM st""")
def p03(spark, sf):
    return scene.states(spark, sf).selectExpr(*tr.KEY, "timestep", f"{R(fm.wrap('heading * 3 + x / 7'))} AS wrapped")


@query("P04_heading_difference", f"""{BASE} SELECT {KEYS}, timestep, {R('acos(greatest(-1.0, least(1.0, cos(x / 7 - heading))))', 5)} AS diff FROM st""")
def p04(spark, sf):
    return scene.states(spark, sf).selectExpr(*tr.KEY, "timestep", f"{R(fm.heading_gap('x / 7', 'heading'), 5)} AS diff")


LOCAL = """SELECT s.scenario_id, s.track_id, timestep, {0} AS x, {1} AS y, {2} AS vx, {3} AS vy FROM st s JOIN o USING (scenario_id)""".format(
    R("cos(oh) * (s.x - ox) + sin(oh) * (s.y - oy)"), R("cos(oh) * (s.y - oy) - sin(oh) * (s.x - ox)"), R("cos(oh) * vx + sin(oh) * vy"), R("cos(oh) * vy - sin(oh) * vx"))
SHOW_LOCAL = [*tr.KEY, "timestep", *r("x", "y", "vx", "vy")]


@query("P05_agent_frame", f"""{BASE}, o AS (SELECT scenario_id, x AS ox, y AS oy, heading AS oh FROM st WHERE timestep = {ANCHOR} AND observed
  QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY track_id) = 1) {LOCAL}""")
def p05(spark, sf):
    st = scene.states(spark, sf)
    origin = fr.anchors(st, ANCHOR).groupBy("scenario_id").agg(fr.F.min(fr.F.struct("track_id", "ox", "oy", "oh")).alias("o")).selectExpr("scenario_id", "o.ox", "o.oy", "o.oh")
    return fr.to_frame(st, origin, ["scenario_id"]).selectExpr(*SHOW_LOCAL)


@query("P06_focal_frame", f"""{BASE}, o AS (SELECT scenario_id, x AS ox, y AS oy, heading AS oh FROM ac QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY track_id DESC) = 1) {LOCAL}""")
def p06(spark, sf):
    st = scene.states(spark, sf)
    focal = st.groupBy("scenario_id").agg(fr.F.max("track_id").alias("focal_track_id"))
    return fr.to_frame(st, fr.focal_origin(st, focal), ["scenario_id"]).selectExpr(*SHOW_LOCAL)


@query("P07_valid_trajectory", f"{BASE} SELECT {KEYS}, timestep, {show('x', 'y')} FROM st WHERE x IS NOT NULL AND y IS NOT NULL")
def p07(spark, sf):
    return tr.valid_frames(scene.states(spark, sf)).selectExpr(*tr.KEY, "timestep", *r("x", "y"))


@query("P08_speed", f"{BASE} SELECT {KEYS}, timestep, {R('sv', 5)} AS speed FROM rt")
def p08(spark, sf):
    return tr.speeds(scene.states(spark, sf)).selectExpr(*tr.KEY, "timestep", f"{R('speed', 5)} AS speed")


@query("P09_acceleration", f"{BASE} SELECT {KEYS}, timestep, {R('acc', 4)} AS accel FROM ra")
def p09(spark, sf):
    return tr.accelerations(scene.states(spark, sf)).selectExpr(*tr.KEY, "timestep", f"{R('accel', 4)} AS accel")


@query("P10_reference_state", f"{BASE} SELECT {KEYS}, object_type, ref_t, {show('x', 'y', 'vx', 'vy', 'heading', 'speed')} FROM ac")
def p10(spark, sf):
    return tr.reference_states(scene.states(spark, sf)).selectExpr(*tr.KEY, "object_type", "ref_t", *r("x", "y", "vx", "vy", "heading", "speed"))


@query("P11_future_window", f"{BASE} SELECT {KEYS}, count(*) AS frames, min(timestep) AS first_t, max(timestep) AS last_t FROM rt WHERE timestep >= ref_t GROUP BY ALL")
def p11(spark, sf):
    return tr.future_window(scene.states(spark, sf)).groupBy(*tr.KEY).agg(
        fr.F.count("*").alias("frames"), fr.F.min("timestep").alias("first_t"), fr.F.max("timestep").alias("last_t"))


def _actors(*columns: str):
    return lambda spark, sf: tr.actors(scene.states(spark, sf)).selectExpr(*tr.KEY, *columns)


for name, columns, sql in (
    ("P12_future_heading_change", [f"{R('turn')} AS turn", f"{R('abs(turn)')} AS absolute"], f"{R('turn')} AS turn, {R('abs(turn)')} AS absolute"),
    ("P13_future_lateral", [f"{R('lateral')} AS lateral_m"], f"{R('lat_m')} AS lateral_m"),
    ("P14_minimum_speed_acceleration", [f"{R('min_speed')} AS min_speed", f"{R('min_accel', 4)} AS min_accel"], f"{R('min_speed')} AS min_speed, {R('min_accel', 4)} AS min_accel"),
    ("P15_future_endpoint", r("end_x", "end_y", "end_heading"), show("end_x", "end_y", "end_heading")),
    ("F09_history_steps", ["CAST(hist_steps AS BIGINT) AS hist_steps", "hist_steps >= 30 AS enough"], "hist_steps, hist_steps >= 30 AS enough"),
):
    query(name, f"{BASE} SELECT {KEYS}, {sql} FROM a1")(_actors(*columns))


@query("P18_sample_period", f"""{BASE} SELECT scenario_id, {R('median(d)')} AS period_s, {R('max(m)')} AS last_s FROM (SELECT scenario_id, time_s - lag(time_s) OVER (PARTITION BY scenario_id ORDER BY time_s) AS d,
  time_s AS m FROM (SELECT DISTINCT scenario_id, time_s FROM st)) GROUP BY 1""")
def p18(spark, sf):
    # distinct time stamps of a scenario: at most 110 rows per scenario
    t = scene.states(spark, sf).select("scenario_id", "time_s").distinct()
    w = fr.F.lag("time_s").over(tr.Window.partitionBy("scenario_id").orderBy("time_s"))
    return t.withColumn("d", fr.F.col("time_s") - w).groupBy("scenario_id").agg(
        fr.F.expr(R("percentile(d, 0.5) FILTER (WHERE d > 0)")).alias("period_s"), fr.F.expr(R("max(time_s)")).alias("last_s"))


@query("P23_candidate_anchor", f"{BASE} SELECT {KEYS}, {R('x')} AS ox, {R('y')} AS oy, {R('CASE WHEN sqrt(vx * vx + vy * vy) > 1e-6 THEN atan2(vy, vx) ELSE heading END')} AS oh FROM st WHERE timestep = {ANCHOR}")
def p23(spark, sf):
    st = scene.states(spark, sf).withColumn("heading", fr.F.expr(f"CASE WHEN {fm.norm('vx', 'vy')} > 1e-6 THEN CAST(NULL AS DOUBLE) ELSE heading END"))
    return fr.anchors(st, ANCHOR).selectExpr(*tr.KEY, *r("ox", "oy", "oh"))


FILL = """CASE WHEN timestep % 2 = 0 OR timestep >= 35 THEN heading WHEN lag(timestep) OVER w = timestep - 1 AND sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 1e-6
   THEN atan2(y - lag(y) OVER w, x - lag(x) OVER w) WHEN sqrt(vx * vx + vy * vy) > 1e-6 THEN atan2(vy, vx) END"""


@query("P24_fill_headings", f"{BASE} SELECT {KEYS}, timestep, {R(FILL)} AS filled FROM st WINDOW w AS (PARTITION BY {KEYS} ORDER BY timestep)")
def p24(spark, sf):
    st = scene.states(spark, sf).withColumn("heading", fr.F.expr("CASE WHEN timestep % 2 = 0 OR timestep >= 35 THEN heading END"))
    return fr.fill_headings(st, 35).selectExpr(*tr.KEY, "timestep", f"{R('filled')} AS filled")


SEEN = "observed AND (abs(vx) + abs(vy) > 8.3 OR timestep = 34)"


STOPPED = f"timestep = {ANCHOR} AND track_id LIKE '%3'"  # these tracks lose their velocity at the anchor


@query("P25_target_resolution", f"""{BASE} SELECT {KEYS}, count(*) FILTER (WHERE {SEEN} AND NOT ({STOPPED})) AS valid_steps,
  CASE WHEN count(*) FILTER (WHERE {SEEN} AND NOT ({STOPPED})) < {MINIMUM} THEN 'history_too_short' WHEN max(track_id) LIKE '%3' THEN 'anchor_velocity_missing' END AS reason FROM st WHERE timestep <= {ANCHOR} GROUP BY ALL""")
def p25(spark, sf):
    states = scene.states(spark, sf).withColumn("observed", fr.F.expr(SEEN)).withColumn("vx", fr.F.expr(f"IF({STOPPED}, NULL, vx)"))
    return fr.resolve_targets(states, ANCHOR, MINIMUM).selectExpr(*tr.KEY, "valid_steps", "reason")


@query("A24_low_speed_duration", f"""{BASE}, h AS (SELECT {KEYS}, timestep - row_number() OVER (PARTITION BY {KEYS} ORDER BY timestep) AS g FROM rt WHERE timestep >= ref_t AND sqrt(vx * vx + vy * vy) <= 5.0)
  SELECT {KEYS}, {R('max(n) * CAST(0.1 AS DOUBLE)')} AS low_s FROM (SELECT {KEYS}, g, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL""")
def a24(spark, sf):
    return tr.low_speed(scene.states(spark, sf), 5.0).selectExpr(*tr.KEY, f"{R('low_s')} AS low_s")


@query("A25_moving_to_stopped", f"""{BASE}, sp AS (SELECT {KEYS}, timestep AS stop_t, greatest(0, time_s - rtm) AS stop_time_s, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS stop_travel FROM (
    SELECT *, max(x) FILTER (WHERE timestep = ref_t) OVER p AS rx, max(y) FILTER (WHERE timestep = ref_t) OVER p AS ry, max(time_s) FILTER (WHERE timestep = ref_t) OVER p AS rtm
    FROM rt WINDOW p AS (PARTITION BY {KEYS})) WHERE timestep >= ref_t AND sqrt(vx * vx + vy * vy) <= 4.0 QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY timestep) = 1),
  g AS (SELECT {KEYS}, timestep - row_number() OVER (PARTITION BY {KEYS} ORDER BY timestep) AS g FROM sp JOIN rt USING (scenario_id, track_id) WHERE timestep >= stop_t AND sqrt(vx * vx + vy * vy) <= 4.0),
  d AS (SELECT {KEYS}, max(n) * CAST(0.1 AS DOUBLE) AS stop_s FROM (SELECT {KEYS}, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
  v AS (SELECT {KEYS}, max(sqrt(vx * vx + vy * vy)) AS stop_prior FROM sp JOIN rt USING (scenario_id, track_id) WHERE timestep < stop_t GROUP BY ALL)
  SELECT {KEYS}, {show('stop_s', 'stop_time_s', 'stop_travel', 'stop_prior')} FROM sp JOIN d USING (scenario_id, track_id) JOIN v USING (scenario_id, track_id) WHERE stop_prior >= 2.0""")
def a25(spark, sf):
    return tr.stop_metrics(scene.states(spark, sf), 4.0, 2.0).selectExpr(*tr.KEY, *r("stop_s", "stop_time_s", "stop_travel", "stop_prior"))


@query("A26_trailing_stop", f"""{BASE}, q AS (SELECT {KEYS}, ref_t, max(timestep) FILTER (WHERE NOT (observed AND sqrt(vx * vx + vy * vy) <= 4.0)) AS bad FROM rt WHERE timestep <= ref_t GROUP BY ALL)
  SELECT {KEYS}, {R('(ref_t - coalesce(bad, -1)) * CAST(0.1 AS DOUBLE)')} AS standing_s FROM q WHERE coalesce(bad, -1) < ref_t""")
def a26(spark, sf):
    return tr.trailing_stop(scene.states(spark, sf), 4.0).selectExpr(*tr.KEY, f"{R('standing_s')} AS standing_s")


@query("W05_run_detection", f"""{BASE}, h AS (SELECT {KEYS}, timestep, timestep - row_number() OVER (PARTITION BY {KEYS} ORDER BY timestep) AS g FROM st WHERE vx > 9.0)
  SELECT {KEYS}, max(n) AS frames, max(l - f) AS span FROM (SELECT {KEYS}, g, count(*) AS n, min(timestep) AS f, max(timestep) AS l FROM h GROUP BY ALL) GROUP BY ALL""")
def w05(spark, sf):
    return tr.longest_run(scene.states(spark, sf), tr.KEY, "vx > 9.0")


@query("F06_actor_types", f"{BASE} SELECT scenario_id, count(*) FILTER (WHERE object_type IN ('vehicle', 'bus')) AS vehicles, count(*) FILTER (WHERE object_type IN ('cyclist', 'motorcyclist')) AS cyclists, count(*) FILTER (WHERE object_type = 'pedestrian') AS pedestrians, count(*) FILTER (WHERE object_type IN ('static', 'construction')) AS objects FROM ac GROUP BY 1")
def f06(spark, sf):
    kinds = {"vehicles": "'vehicle', 'bus'", "cyclists": "'cyclist', 'motorcyclist'", "pedestrians": "'pedestrian'", "objects": "'static', 'construction'"}
    return tr.reference_states(scene.states(spark, sf)).groupBy("scenario_id").agg(
        *[fr.F.expr(f"count_if(object_type IN ({types}))").alias(n) for n, types in kinds.items()])
