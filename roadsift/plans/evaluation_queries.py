"""E, A, D, P and F operators: prediction errors, features, sketches, diversity, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.funnel import stages as sg
from roadsift.functions import formulas as fm
from roadsift.operators import audits as au, diversity as dv, evaluation as ev, features as ft, frames as fr, seeds as sd, sketch as sk, tracks as tr
from roadsift.oracles import rules_sql as rs, scene_sql as sc
from roadsift.plans import scene
from roadsift.plans.geometry_queries import CHECKED, CHECKED_SQL, EVERY_SQL, every_match, rule_matches
from roadsift.plans.registry import query
from roadsift.plans.seeds_queries import DC, MF, SR, sha
from roadsift.plans.tracks_queries import BASE, r, show
from roadsift.rules.catalog import RULES, parameters_table
from roadsift.rules.detector import detect, qualified, seed_records, top_matches

R = fm.rounded
STEPS = f"""WITH raw AS (SELECT vec_id, i AS step, CAST(embedding[i] AS DOUBLE) AS dx, CAST(embedding[32 + i] AS DOUBLE) AS dy FROM embeddings, range(1, 33) AS g(i)),
  stp AS ({ad.STEPS_SQL.format(steps='raw')})"""
VALID = "step <= 20 + task_no % 13"
PRED = f"WITH {'pr'} AS (" + ad.PREDICTIONS_SQL.format(lineitem="lineitem") + ")"


def steps(spark, sf):
    return ad.vector_steps(spark, sf)


def prediction_pairs(spark, sf):
    s = steps(spark, sf)
    return s.where("mode < 5"), s.where("mode = 5").selectExpr("task_no", "step", "x AS tx", "y AS ty", f"{VALID} AS valid")


ERR = f"""e AS (SELECT p.task_no, p.mode, p.step, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d FROM stp p JOIN stp t ON t.task_no = p.task_no AND t.mode = 5 AND t.step = p.step WHERE p.mode < 5 AND p.step <= 20 + p.task_no % 13),
  m AS (SELECT task_no, mode, avg(d) AS ade, arg_max(d, step) AS fde FROM e GROUP BY 1, 2)"""


@query("E01_best_of_k", f"{STEPS}, {ERR} SELECT task_no, {R('min(ade)')} AS min_ade, {R('min(fde)')} AS min_fde, min(fde) > 2 AS miss FROM m GROUP BY 1")
def e01(spark, sf):
    return ev.best_of_k(*prediction_pairs(spark, sf), ["task_no"]).selectExpr("task_no", *r("min_ade", "min_fde"), "miss")


@query("E02_single_mode_sums", f"{STEPS}, {ERR} SELECT {R('sum(ade)', 4)} AS ade_sum, {R('sum(fde)', 4)} AS fde_sum, count(*) AS samples, count(*) FILTER (WHERE fde > 2) AS misses FROM m WHERE mode = 0")
def e02(spark, sf):
    p, t = prediction_pairs(spark, sf)
    return ev.metric_sums(ev.best_of_k(p.where("mode = 0"), t, ["task_no"])).selectExpr(f"{R('ade_sum', 4)} AS ade_sum", f"{R('fde_sum', 4)} AS fde_sum", "samples", "misses")


@query("E03_constant_velocity", f"""{BASE}, v AS (SELECT scenario_id, track_id, sqrt((s.x - a.x - a.vx * (timestep - 34) * 0.1) * (s.x - a.x - a.vx * (timestep - 34) * 0.1) + (s.y - a.y - a.vy * (timestep - 34) * 0.1) * (s.y - a.y - a.vy * (timestep - 34) * 0.1)) AS d, timestep
    FROM st s JOIN ac a USING (scenario_id, track_id) WHERE timestep >= 35) SELECT scenario_id, track_id, {R('avg(d)', 5)} AS min_ade, {R('arg_max(d, timestep)', 5)} AS min_fde, arg_max(d, timestep) > 2 AS miss FROM v GROUP BY 1, 2""")
def e03(spark, sf):
    c = ev.constant_velocity(scene.states(spark, sf), 35)
    key = ["scenario_id", "track_id"]
    e = ev.best_of_k(c.select(*key, "mode", "step", "x", "y"), c.selectExpr(*key, "step", "tx", "ty", "true AS valid"), key)
    return e.selectExpr(*key, f"{R('min_ade', 5)} AS min_ade", f"{R('min_fde', 5)} AS min_fde", "miss")


HEX = lambda h, a: "(" + " + ".join(f"CAST(strpos('0123456789abcdef', substr({h}, {a + i}, 1)) - 1 AS DOUBLE) / {16 ** (i + 1)}" for i in range(13)) + ")"


@query("P28_perturbation", f"""{STEPS} SELECT task_no, mode, step, {R('x * sc', 7)} AS x, {R('y * sc + sd * u * u * (3 - 2 * u)', 7)} AS y FROM (SELECT *, 0.98 + 0.04 * {HEX('h', 1)} AS sc, -0.15 + 0.3 * {HEX('h', 17)} AS sd, (step - 1) / 31.0::DOUBLE AS u
    FROM (SELECT *, sha256('e1' || chr(31) || CAST(task_no AS VARCHAR)) AS h FROM stp))""")
def p28(spark, sf):
    f = ft.perturb(steps(spark, sf), "concat_ws('\\u001f', 'e1', CAST(task_no AS STRING))", 32)
    return f.selectExpr("task_no", "mode", "step", f"{R('x', 7)} AS x", f"{R('y', 7)} AS y")


@query("P22_local_to_global_batch", f"{STEPS} SELECT task_no, mode, step, {R('10 + x * cos(0.5) - y * sin(0.5)')} AS x, {R('20 + x * sin(0.5) + y * cos(0.5)')} AS y FROM stp")
def p22(spark, sf):
    f = steps(spark, sf).groupBy("task_no", "mode").agg(F.expr("transform(sort_array(collect_list(struct(step, x, y))), s -> struct(s.x AS x, s.y AS y))").alias("future"))
    gx, gy = fr.global_point("p.x", "p.y", "10D", "20D", "0.5D")
    f = f.withColumn("future", F.expr(f"transform(future, p -> struct({gx} AS x, {gy} AS y))")).selectExpr("task_no", "mode", "posexplode(future) AS (i, p)")
    return f.selectExpr("task_no", "mode", "i + 1 AS step", f"{R('p.x')} AS x", f"{R('p.y')} AS y")


def pred(spark, sf):
    return ad.prediction_rows(spark, sf)


U = lambda c: f"CAST({c} AS DOUBLE) / 10000"
ROWS = f"rw AS (SELECT *, {U('base_ade_u')} AS min_ade, {U('base_ade_u * 2')} AS min_fde, {U('base_ade_u * 2')} > 2 AS miss FROM pr)"


def rows(spark, sf, arm: str = "base"):
    return pred(spark, sf).selectExpr("*", f"{U(f'{arm}_ade_u')} AS min_ade", f"{U(f'{arm}_ade_u * 2')} AS min_fde", f"{U(f'{arm}_ade_u * 2')} > 2 AS miss")


AGG = f"count(*) AS n, {R('avg(min_ade)')} AS min_ade, {R('avg(min_fde)')} AS min_fde, {R('avg(CASE WHEN miss THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS miss"


@query("A08_metric_sums", f"{PRED}, {ROWS} SELECT is_long_tail, {R('sum(min_ade)', 3)} AS ade_sum, count(*) AS samples, count(*) FILTER (WHERE miss) AS misses FROM rw GROUP BY 1")
def a08(spark, sf):
    return rows(spark, sf).groupBy("is_long_tail").agg(F.expr(R("sum(min_ade)", 3)).alias("ade_sum"), F.count("*").alias("samples"), F.expr("count_if(miss)").alias("misses"))


@query("A09_prediction_summary", f"""{PRED}, {ROWS}, t AS (SELECT * FROM rw WHERE is_long_tail) SELECT 'overall' AS view, 'all' AS key, {AGG} FROM rw UNION ALL SELECT 'long_tail', 'all', {AGG} FROM t
  UNION ALL SELECT 'skill', skill_id, {AGG} FROM t GROUP BY skill_id UNION ALL SELECT 'skill', 'never_seen', 0, NULL, NULL, NULL UNION ALL SELECT 'risk', risk_stratum, {AGG} FROM t GROUP BY risk_stratum""")
def a09(spark, sf):
    rws = rows(spark, sf)
    skills = rws.select("skill_id").distinct().unionByName(spark.sql("SELECT 'never_seen' AS skill_id"))
    return ev.summaries(rws, skills).selectExpr("view", "key", "n", *r("min_ade", "min_fde", "miss"))


@query("A10_seed_statistics", f"{PRED}, {ROWS} SELECT skill_id, count(*) AS seeds, {R('avg(m)')} AS mean, {R('stddev_samp(m)')} AS std FROM (SELECT skill_id, train_seed, avg(min_ade) AS m FROM rw GROUP BY 1, 2) GROUP BY 1")
def a10(spark, sf):
    return ev.over_seeds(rows(spark, sf), ["skill_id"], "min_ade").selectExpr("skill_id", "seeds", *r("mean", "std"))


@query("A11_metric_delta", f"""{PRED}, g AS (SELECT skill_id, avg({U('base_ade_u')}) AS b, avg({U('cand_ade_u')}) AS c FROM pr GROUP BY 1) SELECT skill_id, {R('c - b')} AS absolute, {R('CASE WHEN b <> 0 THEN (c - b) / b END')} AS relative FROM g""")
def a11(spark, sf):
    b = rows(spark, sf).groupBy("skill_id").agg(F.avg("min_ade").alias("base"))
    c = rows(spark, sf, "cand").groupBy("skill_id").agg(F.avg("min_ade").alias("cand"))
    absolute, relative = ev.delta("cand", "base")
    return b.join(c, "skill_id").selectExpr("skill_id", f"{R(absolute)} AS absolute", f"{R(relative)} AS relative")


@query("A12_paired_deltas", f"{PRED} SELECT scenario_id, {R(f'avg({U("base_ade_u")})')} AS base, {R('avg(CAST(cand_ade_u AS DOUBLE) / 10000)')} AS cand FROM pr GROUP BY 1")
def a12(spark, sf):
    return ev.scenario_deltas(rows(spark, sf), rows(spark, sf, "cand"), "min_ade").selectExpr("scenario_id", *r("base", "cand"))


@query("A12b_paired_bootstrap")
def a12b(spark, sf):
    return ev.bootstrap(ev.scenario_deltas(rows(spark, sf), rows(spark, sf, "cand"), "min_ade"))


@query("Q07_finite_audit", f"""{PRED}, {ROWS} SELECT unnest(['min_ade', 'min_fde', 'ratio']) AS column_name, unnest([count(*) FILTER (WHERE isnan(min_ade) OR isinf(min_ade)), count(*) FILTER (WHERE isnan(min_fde) OR isinf(min_fde)), count(*) FILTER (WHERE min_ade = 0)]) AS bad FROM rw""")
def q07(spark, sf):
    d = rows(spark, sf).withColumn("ratio", F.expr("IF(min_ade = 0, double('infinity'), min_fde / min_ade)"))
    return au.non_finite(d, ["min_ade", "min_fde", "ratio"])


@query("Q09_predictor_safe_projection", f"{PRED}, {ROWS} SELECT {R('min_ade')} AS min_ade, {R('min_fde')} AS min_fde FROM rw")
def q09(spark, sf):
    return ft.safe_projection(rows(spark, sf), ["min_ade", "min_fde"]).selectExpr(*r("min_ade", "min_fde"))


@query("J30_label_attach", f"""{PRED}, sr AS ({ad.SEED_RECORDS_SQL.format(lineitem='lineitem')}), lb AS (SELECT scenario_id, skill_id, seed_risk_metric, trigger_score FROM sr QUALIFY row_number() OVER (PARTITION BY scenario_id, skill_id ORDER BY trigger_score DESC, seed_risk_metric) = 1)
  SELECT sample_id, lb.seed_risk_metric, {R('lb.trigger_score')} AS trigger_score, lb.skill_id IS NULL AS label_missing FROM pr LEFT JOIN lb ON lb.scenario_id = pr.scenario_id AND lb.skill_id = pr.skill_id AND is_long_tail""")
def j30(spark, sf):
    label = sd.best_label(ad.seed_records(spark, sf), ["scenario_id", "skill_id"], ["seed_risk_metric"]).selectExpr("scenario_id", "skill_id", "seed_risk_metric", "trigger_score", "true AS is_long_tail", "true AS found")
    j = pred(spark, sf).join(label, ["scenario_id", "skill_id", "is_long_tail"], "left")
    return j.selectExpr("sample_id", "seed_risk_metric", f"{R('trigger_score')} AS trigger_score", "found IS NULL AS label_missing")


# --- diversity and distances over the vector futures ----------------------------------------------
def futures(spark, sf):
    f = steps(spark, sf).groupBy("task_no", "mode").agg(F.expr("transform(sort_array(collect_list(struct(step, x, y))), s -> struct(s.x AS x, s.y AS y))").alias("future"))
    f = f.selectExpr("concat_ws('-', CAST(task_no AS STRING), CAST(mode AS STRING)) AS candidate_id", "task_no", "mode", "CAST(CAST(floor(task_no / 4.0) AS BIGINT) AS STRING) AS scenario_id",
                     "concat('s', CAST(task_no % 2 AS STRING)) AS skill_id", "future", "abs(future[31].x) AS quality_score", "future[31].y AS risk")
    return f.withColumn("signature", F.expr(dv.signature("future", (7, 15, 23, 31), "risk", "''")))


@query("D02_pairwise_distance", f"""{STEPS} SELECT p.task_no, p.mode AS a, q.mode AS b, {R('sqrt(avg((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))')} AS rms, {R('arg_max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), p.step)')} AS endpoint
  FROM stp p JOIN stp q ON p.task_no = q.task_no AND p.step = q.step AND p.mode < q.mode GROUP BY ALL""")
def d02(spark, sf):
    f = futures(spark, sf).select("task_no", "mode", "future")
    # the six modes of one task
    other = f.withColumnsRenamed({"mode": "b", "future": "g"})
    rms, end = dv.distances("future", "g")
    return f.join(other, "task_no").where("mode < b").selectExpr("task_no", "mode AS a", "b", f"{R(rms)} AS rms", f"{R(end)} AS endpoint")


SIG = ", ".join(f"CAST(CAST(round_even(max({c}) FILTER (WHERE step = {s}), 0) AS BIGINT) AS VARCHAR)" for s in (8, 16, 24, 32) for c in "xy")


@query("D04_signature", f"{STEPS} SELECT task_no, mode, sha256(concat_ws('|', 's' || CAST(task_no % 2 AS VARCHAR), {SIG}, CAST(CAST(round_even(max(y) FILTER (WHERE step = 32) / 0.25, 0) AS BIGINT) AS VARCHAR), '')) AS signature FROM stp GROUP BY 1, 2")
def d04(spark, sf):
    return futures(spark, sf).select("task_no", "mode", "signature")


@query("D03_greedy_diversity")
def d03(spark, sf):
    return dv.greedy(futures(spark, sf))


@query("D07_round_trip_error", f"{BASE} SELECT scenario_id, true AS within FROM st GROUP BY 1")
def d07(spark, sf):
    st = scene.states(spark, sf)
    origin = tr.reference_states(st).selectExpr("scenario_id", "track_id", "x AS ox", "y AS oy", "heading AS oh")
    lx, ly = fr.local_point("x", "y", "ox", "oy", "oh")
    d = st.join(origin, tr.KEY).withColumns({"lx": F.expr(lx), "ly": F.expr(ly)})
    gx, gy = fr.global_point("lx", "ly", "ox", "oy", "oh")
    return d.groupBy("scenario_id").agg(F.expr(f"max({fm.norm(f'x - {gx}', f'y - {gy}')}) < 1e-9").alias("within"))


# --- sketches and kinematic reference ---------------------------------------------------------------
SPEEDS = f"{BASE}, sv AS (SELECT object_type, 'speed' AS metric, round(sqrt(vx * vx + vy * vy), 6) AS value FROM st)"
BIN = f"CASE WHEN value = 0 THEN -2 WHEN value < 1e-6 THEN -1 WHEN value > 1e4 THEN 2048 ELSE CAST(least(2047, greatest(0, floor(ln(value / 1e-6) / {sk.WIDTH!r}))) AS INT) END"


def speed_values(spark, sf):
    return scene.states(spark, sf).selectExpr("object_type", "'speed' AS metric", f"round({fm.norm('vx', 'vy')}, 6) AS value")


@query("A05_log_histogram", f"{SPEEDS} SELECT object_type, metric, {BIN} AS bin, count(*) AS n, {R('min(value)')} AS minimum, {R('max(value)')} AS maximum FROM sv GROUP BY ALL")
def a05(spark, sf):
    v = speed_values(spark, sf)
    h = sk.merge(sk.log_histogram(v.where("value < 5")), sk.log_histogram(v.where("value >= 5")))
    return h.selectExpr("object_type", "metric", "bin", "n", *r("minimum", "maximum"))


@query("A06_quantile_bounds", f"""{SPEEDS}, h AS (SELECT object_type, metric, {BIN} AS bin, count(*) AS n FROM sv GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY object_type, metric ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY object_type, metric) AS tot FROM h)
  SELECT object_type, metric, p, {R(f'CASE WHEN bin = -2 THEN 0 WHEN bin = -1 THEN 1e-6 WHEN bin < 2048 THEN least(1e-6 * exp((bin + 1) * {sk.WIDTH!r}), 1e4) END')} AS upper_bound FROM c, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p) q WHERE cum >= greatest(1, ceil(p * tot)) AND cum - n < greatest(1, ceil(p * tot))""")
def a06(spark, sf):
    return sk.upper_bounds(sk.log_histogram(speed_values(spark, sf)), [0.5, 0.95, 0.99]).selectExpr("object_type", "metric", "p", f"{R('upper_bound')} AS upper_bound")


def track_kinematics(spark, sf, steps_: int = 10):
    """Windows of the two history frames and the next frames; future positions pass through float32."""
    s = scene.states(spark, sf).where(f"timestep BETWEEN 33 AND {34 + steps_}").withColumn("key", F.expr("concat_ws('/', scenario_id, track_id)"))
    s = s.withColumn("is_future", F.expr("timestep > 34")).withColumns({c: F.expr(f"IF(timestep > 34, CAST(CAST({c} AS FLOAT) AS DOUBLE), {c})") for c in "xy"})
    return fr.future_kinematics(s, "key")


KIN = f"""k0 AS (SELECT scenario_id || '/' || track_id AS key, object_type, timestep, time_s, CASE WHEN timestep > 34 THEN CAST(CAST(x AS FLOAT) AS DOUBLE) ELSE x END AS x, CASE WHEN timestep > 34 THEN CAST(CAST(y AS FLOAT) AS DOUBLE) ELSE y END AS y, vx, vy, heading FROM st WHERE timestep BETWEEN 33 AND 44),
  k1 AS (SELECT *, time_s - lag(time_s) OVER w AS dt, CASE WHEN timestep > 34 THEN (x - lag(x) OVER w) / (time_s - lag(time_s) OVER w) ELSE vx END AS ux, CASE WHEN timestep > 34 THEN (y - lag(y) OVER w) / (time_s - lag(time_s) OVER w) ELSE vy END AS uy FROM k0 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  k2 AS (SELECT *, (ux - lag(ux) OVER w) / dt AS ax, (uy - lag(uy) OVER w) / dt AS ay, sqrt(ux * ux + uy * uy) AS speed FROM k1 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  k3 AS (SELECT *, (ax - lag(ax) OVER w) / dt AS jx, (ay - lag(ay) OVER w) / dt AS jy, (speed - lag(speed) OVER w) / dt AS tang, lag(speed) OVER w AS ls,
     CASE WHEN timestep > 34 AND speed >= 0.5 THEN atan2(uy, ux) WHEN timestep <= 34 THEN heading END AS dir FROM k2 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  k4 AS (SELECT *, (SELECT arg_max(q.dir, q.timestep) FROM k3 q WHERE q.key = k3.key AND q.timestep < k3.timestep AND q.dir IS NOT NULL) AS before FROM k3),
  kk AS (SELECT key, object_type, timestep, speed, tang, greatest(0 - tang, 0) AS decel, sqrt(ax * ax + ay * ay) AS accel, sqrt(jx * jx + jy * jy) AS jerk,
     CASE WHEN speed >= 0.5 AND ls >= 0.5 AND before IS NOT NULL THEN abs({fm.wrap('dir - before')}) / dt ELSE 0 END AS rate, (ls + speed) / 2 AS ms FROM k4 WHERE timestep > 34)"""


@query("P19_future_kinematics", f"{BASE}, {KIN} SELECT key, timestep, {R('speed', 4)} AS speed, {R('tang', 2)} AS tangential, {R('decel', 2)} AS deceleration, {R('rate', 4)} AS heading_rate FROM kk")
def p19(spark, sf):
    return track_kinematics(spark, sf).selectExpr("key", "timestep", f"{R('speed', 4)} AS speed", f"{R('tangential', 2)} AS tangential", f"{R('deceleration', 2)} AS deceleration", f"{R('heading_rate', 4)} AS heading_rate")


@query("P20_observed_kinematics", f"{BASE}, {KIN} SELECT key, {R('max(speed)', 4)} AS speed, {R('max(accel)', 2)} AS acceleration, {R('max(jerk)', 1)} AS jerk, {R('max(CASE WHEN rate > 0 THEN rate / ms ELSE 0 END)', 4)} AS curvature FROM kk GROUP BY 1 HAVING count(*) = 10")
def p20(spark, sf):
    g = track_kinematics(spark, sf).groupBy("key").agg(*[F.max(c).alias(c) for c in ("speed", "acceleration", "jerk", "curvature")], F.count("*").alias("n"))
    return g.where("n = 10").selectExpr("key", f"{R('speed', 4)} AS speed", f"{R('acceleration', 2)} AS acceleration", f"{R('jerk', 1)} AS jerk", f"{R('curvature', 4)} AS curvature")


@query("A07_kinematic_reference", f"""{BASE}, {KIN}, l AS (SELECT object_type, m AS metric, v AS value, key FROM (SELECT object_type, key, unnest(['speed', 'deceleration', 'heading_rate']) AS m, unnest([round(speed, 4), round(decel, 2), round(rate, 4)]) AS v FROM kk)),
  w AS (SELECT object_type, metric, key, max(value) AS value FROM l GROUP BY ALL) SELECT object_type, metric, kind, count(*) AS n, {R('max(value)', 2)} AS maximum FROM (SELECT object_type, metric, value, 'point' AS kind FROM l UNION ALL SELECT object_type, metric, value, 'window' FROM w) GROUP BY ALL""")
def a07(spark, sf):
    kinds = scene.states(spark, sf).selectExpr("concat_ws('/', scenario_id, track_id) AS key", "object_type").distinct()
    k = track_kinematics(spark, sf).join(kinds, "key")
    flat = k.selectExpr("object_type", "key", "stack(3, 'speed', round(speed, 4), 'deceleration', round(deceleration, 2), 'heading_rate', round(heading_rate, 4)) AS (metric, value)")
    window = flat.groupBy("object_type", "metric", "key").agg(F.max("value").alias("value"))
    hist = lambda d, kind: sk.log_histogram(d).groupBy(*sk.KEY).agg(F.sum("n").alias("n"), F.max("maximum").alias("maximum")).withColumn("kind", F.lit(kind))
    return hist(flat, "point").unionByName(hist(window, "window")).selectExpr("object_type", "metric", "kind", "n", f"{R('maximum', 2)} AS maximum")


# --- kinematics of whole tracks: every frame from the anchor to the track's own end ----------------------
FINITE = "coalesce(abs({0}) < 1e308, false)"
PLACED, MOVED = (" AND ".join(FINITE.format(c) for c in pair) for pair in (("x", "y"), ("vx", "vy")))
METRICS = {"speed": 4, "positive_acceleration": 2, "deceleration": 2, "jerk": 1, "heading_rate": 4, "curvature": 4}
QUALITY = ("rows", "tracks", "incomplete_tracks", "invalid_position_rows", "invalid_velocity_rows", "invalid_heading_rows", "invalid_tracks", "window_tracks", "suppressed_turns")


def reference_windows(states):
    """Per track: whether frames 33 to its own last one are all there, and the rows that spoil them (of complete windows only)."""
    g = states.groupBy(*tr.KEY, "object_type").agg(
        F.count("*").alias("rows"), F.expr("sort_array(collect_list(timestep) FILTER (WHERE timestep >= 33)) = sequence(33, greatest(max(timestep), 35))").alias("complete"),
        F.expr(f"count_if(timestep >= 34 AND NOT ({PLACED}))").alias("p"), F.expr(f"count_if(timestep IN (33, 34) AND NOT ({MOVED}))").alias("v"), F.expr(f"count_if(timestep = 34 AND NOT {FINITE.format('heading')})").alias("h"))
    return g.selectExpr("concat_ws('/', scenario_id, track_id) AS key", "object_type", "rows", "complete", *[f"IF(complete, {c}, 0) AS {n}" for c, n in zip("pvh", QUALITY[3:6])],
                        "complete AND p + v = 0 AS valid")


def whole_kinematics(states):
    """Kinematics of all frames after the anchor; future positions pass through float32, the least heading speed is that of the class."""
    s = states.where("timestep >= 33").withColumns({"key": F.expr("concat_ws('/', scenario_id, track_id)"), "is_future": F.expr("timestep > 34"), "min_v": F.expr(f"coalesce({sg._by_type(sg.LIMITS, 7)}, 0.5D)")})
    s = s.withColumns({c: F.expr(f"IF(is_future, CAST(CAST({c} AS FLOAT) AS DOUBLE), {c})") for c in "xy"})
    return fr.future_kinematics(s, "key", "min_v").withColumn("positive_acceleration", F.expr("greatest(tangential, CAST(0 AS DOUBLE))"))


def window_kinematics(states):
    return whole_kinematics(states).join(reference_windows(states).where("valid").select("key", "object_type"), "key")


def window_peaks(states):
    return window_kinematics(states).groupBy("key").agg(F.count("*").alias("frames"), *[F.max(c).alias(c) for c in (*METRICS, "acceleration")])


def kinematic_reference(states):
    """Point and window-maximum distributions of the six metrics by class, and the quality counts."""
    w, known = reference_windows(states), F.col("object_type").isin(list(sg.LIMITS))
    k = window_kinematics(states).where(known)
    flat = k.selectExpr("object_type", "key", f"stack({len(METRICS)}, {', '.join(f'{c!r}, round({c}, {d})' for c, d in METRICS.items())}) AS (metric, value)")
    window = flat.groupBy("object_type", "metric", "key").agg(F.max("value").alias("value"))
    hist = lambda d, kind: sk.log_histogram(d).groupBy(*sk.KEY).agg(F.sum("n").alias("n"), F.max("maximum").alias("maximum")).withColumn("kind", F.lit(kind))
    slow = k.groupBy("object_type").agg(F.expr(f"count_if(speed < {sg._by_type(sg.LIMITS, 7)})").alias("suppressed_turns"))
    sums = {"rows": "sum(rows)", "tracks": "count(*)", "incomplete_tracks": "count_if(NOT complete)", **{c: f"sum({c})" for c in QUALITY[3:6]}, "invalid_tracks": "count_if(complete AND NOT valid)", "window_tracks": "count_if(valid)"}
    counts = w.where(known).groupBy("object_type").agg(*[F.expr(e).alias(n) for n, e in sums.items()]).join(slow, "object_type", "left").selectExpr(
        "object_type", f"stack({len(QUALITY)}, {', '.join(f'{c!r}, coalesce({c}, 0)' for c in QUALITY)}) AS (metric, n)")
    ignored = w.where(~known).groupBy("object_type").agg(F.sum("rows").alias("n")).selectExpr("object_type", "'ignored_rows' AS metric", "n")
    quality = counts.unionByName(ignored).withColumns({"kind": F.lit("quality"), "maximum": F.lit(None).cast("double")})
    return hist(flat, "point").unionByName(hist(window, "window")).unionByName(quality)


KNOWN = "object_type IN ('vehicle', 'bus', 'motorcyclist', 'cyclist', 'pedestrian')"
KWHOLE = f"""h0 AS (SELECT scenario_id || '/' || track_id AS key, object_type, timestep, time_s, CASE WHEN timestep > 34 THEN CAST(CAST(x AS FLOAT) AS DOUBLE) ELSE x END AS x, CASE WHEN timestep > 34 THEN CAST(CAST(y AS FLOAT) AS DOUBLE) ELSE y END AS y, vx, vy, heading,
     CASE object_type WHEN 'cyclist' THEN 0.3::DOUBLE WHEN 'pedestrian' THEN 0.2 ELSE 0.5 END AS least FROM st WHERE timestep >= 33),
  h1 AS (SELECT *, time_s - lag(time_s) OVER w AS dt, CASE WHEN timestep > 34 THEN (x - lag(x) OVER w) / (time_s - lag(time_s) OVER w) ELSE vx END AS ux, CASE WHEN timestep > 34 THEN (y - lag(y) OVER w) / (time_s - lag(time_s) OVER w) ELSE vy END AS uy FROM h0 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  h2 AS (SELECT *, (ux - lag(ux) OVER w) / dt AS ax, (uy - lag(uy) OVER w) / dt AS ay, sqrt(ux * ux + uy * uy) AS speed FROM h1 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  h3 AS (SELECT *, (ax - lag(ax) OVER w) / dt AS jx, (ay - lag(ay) OVER w) / dt AS jy, (speed - lag(speed) OVER w) / dt AS tang, lag(speed) OVER w AS ls, CASE WHEN timestep <= 34 THEN heading WHEN speed >= least THEN atan2(uy, ux) END AS dir FROM h2 WINDOW w AS (PARTITION BY key ORDER BY timestep)),
  h4 AS (SELECT *, last_value(dir IGNORE NULLS) OVER (PARTITION BY key ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h3),
  h5 AS (SELECT key, object_type, timestep, least, speed, tang, greatest(tang, 0) AS positive_acceleration, greatest(0 - tang, 0) AS deceleration, sqrt(ax * ax + ay * ay) AS acceleration, sqrt(jx * jx + jy * jy) AS jerk,
     CASE WHEN speed >= least AND ls >= least AND before IS NOT NULL THEN abs({fm.wrap('dir - before')}) / dt ELSE 0 END AS heading_rate, (ls + speed) / 2 AS ms FROM h4 WHERE timestep > 34),
  hk AS (SELECT *, CASE WHEN heading_rate > 0 THEN heading_rate / ms ELSE 0 END AS curvature FROM h5),
  hw AS (SELECT scenario_id || '/' || track_id AS key, object_type, count(*) AS rows_, count(*) FILTER (WHERE timestep >= 33) = greatest(max(timestep), 35) - 32 AND count(DISTINCT timestep) FILTER (WHERE timestep >= 33) = greatest(max(timestep), 35) - 32 AS complete,
     count(*) FILTER (WHERE timestep >= 34 AND (x IS NULL OR y IS NULL OR NOT isfinite(x) OR NOT isfinite(y))) AS p, count(*) FILTER (WHERE timestep IN (33, 34) AND (vx IS NULL OR vy IS NULL OR NOT isfinite(vx) OR NOT isfinite(vy))) AS v,
     count(*) FILTER (WHERE timestep = 34 AND (heading IS NULL OR NOT isfinite(heading))) AS h FROM st GROUP BY ALL),
  hv AS (SELECT hk.* FROM hk JOIN hw USING (key) WHERE complete AND p + v = 0)"""


@query("P19b_every_future_frame", f"{BASE}, {KWHOLE} SELECT key, timestep, {R('speed', 4)} AS speed, {R('tang', 2)} AS tangential, {R('deceleration', 2)} AS deceleration, {R('heading_rate', 4)} AS heading_rate FROM hk")
def p19b(spark, sf):
    return whole_kinematics(scene.states(spark, sf)).selectExpr("key", "timestep", f"{R('speed', 4)} AS speed", f"{R('tangential', 2)} AS tangential", f"{R('deceleration', 2)} AS deceleration", f"{R('heading_rate', 4)} AS heading_rate")


PEAKS = {**METRICS, "acceleration": 2}


@query("P20b_every_complete_window", f"{BASE}, {KWHOLE} SELECT key, count(*) AS frames, {', '.join(f'{R(f"max({c})", d)} AS {c}' for c, d in PEAKS.items())} FROM hv GROUP BY 1")
def p20b(spark, sf):
    return window_peaks(scene.states(spark, sf)).selectExpr("key", "frames", *[f"{R(c, d)} AS {c}" for c, d in PEAKS.items()])


@query("A07b_whole_kinematic_reference", f"""{BASE}, {KWHOLE}, l AS (SELECT object_type, key, unnest([{', '.join(f"'{c}'" for c in METRICS)}]) AS metric, unnest([{', '.join(f'round({c}, {d})' for c, d in METRICS.items())}]) AS value FROM hv WHERE {KNOWN}),
  w AS (SELECT object_type, metric, key, max(value) AS value FROM l GROUP BY ALL),
  q AS (SELECT object_type, sum(rows_) AS q0, count(*) AS q1, count(*) FILTER (WHERE NOT complete) AS q2, sum(p) FILTER (WHERE complete) AS q3, sum(v) FILTER (WHERE complete) AS q4, sum(h) FILTER (WHERE complete) AS q5,
     count(*) FILTER (WHERE complete AND p + v > 0) AS q6, count(*) FILTER (WHERE complete AND p + v = 0) AS q7 FROM hw WHERE {KNOWN} GROUP BY 1),
  z AS (SELECT object_type, count(*) FILTER (WHERE speed < least) AS q8 FROM hv GROUP BY 1)
  SELECT object_type, metric, kind, count(*) AS n, {R('max(value)', 2)} AS maximum FROM (SELECT object_type, metric, value, 'point' AS kind FROM l UNION ALL SELECT object_type, metric, value, 'window' FROM w) GROUP BY ALL
  UNION ALL SELECT object_type, unnest([{', '.join(f"'{c}'" for c in QUALITY)}]), 'quality', unnest([q0, q1, q2, coalesce(q3, 0), coalesce(q4, 0), coalesce(q5, 0), q6, q7, coalesce(q8, 0)])::BIGINT, NULL FROM q LEFT JOIN z USING (object_type)
  UNION ALL SELECT object_type, 'ignored_rows', 'quality', sum(rows_)::BIGINT, NULL FROM hw WHERE NOT ({KNOWN}) GROUP BY 1""")
def a07b(spark, sf):
    return kinematic_reference(scene.states(spark, sf)).selectExpr("object_type", "metric", "kind", "n", f"{R('maximum', 2)} AS maximum")


# --- features -----------------------------------------------------------------------------------------
def samples(spark, sf):
    """One sample per reference track: anchored in the track's own frame, the track as explicit actor."""
    a = tr.reference_states(scene.states(spark, sf))
    return a.selectExpr("concat_ws('/', scenario_id, track_id) AS sample_id", "scenario_id", "x AS ox", "y AS oy", "heading AS oh", "array(track_id) AS explicit")


SEL = """sel AS (SELECT a.scenario_id || '/' || a.track_id AS sample_id, b.track_id, CASE WHEN b.track_id = a.track_id THEN 0 ELSE row_number() OVER (PARTITION BY a.scenario_id, a.track_id, b.track_id = a.track_id
    ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.track_id) END AS slot, a.x AS ox, a.y AS oy, a.heading AS oh, a.scenario_id FROM ac a JOIN ac b ON a.scenario_id = b.scenario_id
    WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 100 QUALIFY slot < 32)"""


@query("J23_actor_selection", f"{BASE}, {SEL} SELECT sample_id, track_id, CAST(slot AS INT) AS slot FROM sel")
def j23(spark, sf):
    return ft.select_actors(samples(spark, sf), scene.states(spark, sf), 35).select("sample_id", "track_id", "slot")


@query("P26_actor_features", f"""{BASE}, {SEL}, f AS (SELECT sample_id, slot, CAST(cos(oh) * (x - ox) + sin(oh) * (y - oy) AS FLOAT) AS lx, CAST(cos(oh) * (y - oy) - sin(oh) * (x - ox) AS FLOAT) AS ly, CAST(cos(heading - oh) AS FLOAT) AS ch FROM sel JOIN st USING (scenario_id, track_id) WHERE timestep < 35)
  SELECT sample_id, CAST(slot AS INT) AS slot, count(*) AS valid, {R('sum(CAST(lx AS DOUBLE))', 2)} AS sum_x, {R('sum(CAST(ly AS DOUBLE))', 2)} AS sum_y, {R('sum(CAST(ch AS DOUBLE))', 3)} AS sum_cos FROM f GROUP BY 1, 2""")
def p26(spark, sf):
    s, st = samples(spark, sf), scene.states(spark, sf)
    f = ft.actor_features(ft.select_actors(s, st, 35), s, st, 35)
    total = lambda i: f"aggregate(features, CAST(0 AS DOUBLE), (a, v) -> a + CAST(v[{i}] AS DOUBLE))"
    return f.selectExpr("sample_id", "slot", "CAST(size(filter(mask, m -> m)) AS BIGINT) AS valid", f"{R(total(0), 2)} AS sum_x", f"{R(total(1), 2)} AS sum_y", f"{R(total(5), 3)} AS sum_cos")


MAPS = f"""WITHX, pts AS (SELECT * FROM {{points}}), md AS (SELECT scenario_id || '/' || track_id AS sample_id, pid, min(sqrt((pts.x - a.x) * (pts.x - a.x) + (pts.y - a.y) * (pts.y - a.y))) AS d, count(*) AS n FROM ac a, pts WHERE sqrt((pts.x - a.x) * (pts.x - a.x) + (pts.y - a.y) * (pts.y - a.y)) <= 100 GROUP BY ALL),
  mr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, CASE WHEN pid = 'X0' THEN 4 WHEN pid LIKE 'S%' THEN 5 ELSE 1 END, pid) - 1 AS slot FROM md)"""
from roadsift.plans.geometry_queries import POINTS_SQL  # noqa: E402
MAPS = BASE + MAPS.replace("WITHX", "").format(points=POINTS_SQL)


@query("W03_map_ranking", f"{MAPS} SELECT sample_id, pid AS polyline_id, CAST(slot AS INT) AS slot FROM mr WHERE slot < 8")
def w03(spark, sf):
    return ft.map_features(samples(spark, sf), scene.roads(spark, sf), limit=8)[0].select("sample_id", "polyline_id", "slot")


@query("P27_map_features", f"{MAPS} SELECT sample_id, CAST(slot AS INT) AS slot, n AS points FROM mr WHERE slot < 128")
def p27(spark, sf):
    return ft.map_features(samples(spark, sf), scene.roads(spark, sf))[0].selectExpr("sample_id", "slot", "CAST(size(tangents) AS BIGINT) AS points")


@query("A19_map_clip_statistics", f"{MAPS}, s AS (SELECT sample_id, count(*) AS e, count(*) FILTER (WHERE slot < 8) AS k, count(*) FILTER (WHERE slot >= 8) AS dr, sum(n) AS p FROM mr GROUP BY 1) SELECT CAST(sum(e) AS BIGINT) AS eligible, CAST(sum(k) AS BIGINT) AS retained, CAST(sum(dr) AS BIGINT) AS dropped, CAST(sum(p) AS BIGINT) AS points, max(e) AS most, count(*) FILTER (WHERE dr > 0) AS clipped FROM s")
def a19(spark, sf):
    s = ft.map_features(samples(spark, sf), scene.roads(spark, sf), limit=8)[1]
    return s.agg(F.sum("eligible").alias("eligible"), F.sum("retained").alias("retained"), F.sum("dropped").alias("dropped"), F.sum("points_in_radius").alias("points"), F.max("eligible").alias("most"), F.expr("count_if(dropped > 0)").alias("clipped"))


# --- parameters -----------------------------------------------------------------------------------------
def drawn(spark, sf):
    """Draws for every track as a record of each rule with parameters."""
    ids = tr.reference_states(scene.states(spark, sf)).select("scenario_id", "track_id")
    records = ids.withColumn("skill_id", F.explode(F.array(*[F.lit(k) for k in RULES])))
    return ft.sample_parameters(records, parameters_table(spark), "concat_ws('|', scenario_id, track_id)")


_PARAMS = [(k, n, v) for k, rule in RULES.items() for n, v in rule.parameters.items()]
PVALUES = ", ".join(f"('{k}', '{n}', " + (f"NULL, NULL, {list(v)!r}" if isinstance(v[0], str) else f"CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE), NULL") + ")" for k, n, v in _PARAMS)
DRAW = f"""{BASE}, pv AS (SELECT * FROM (VALUES {PVALUES}) AS p(skill_id, name, lo, hi, choices)), dr AS (SELECT scenario_id, track_id, pv.*, sha256('2026' || chr(31) || skill_id || chr(31) || scenario_id || '|' || track_id || chr(31) || name) AS h FROM ac, pv),
  du AS (SELECT *, {HEX('h', 1)} AS u FROM dr)"""


@query("P35_parameter_sampling", f"{DRAW} SELECT scenario_id, track_id, skill_id, name, {R('lo + (hi - lo) * u')} AS number, CASE WHEN choices IS NOT NULL THEN choices[CAST(floor(u * len(choices)) AS INT) + 1] END AS choice FROM du")
def p35(spark, sf):
    return drawn(spark, sf).selectExpr("scenario_id", "track_id", "skill_id", "name", f"{R('number')} AS number", "choice")


@query("P42_parameter_encoding", f"{DRAW} SELECT scenario_id, track_id, skill_id, CAST(sum(CASE WHEN choices IS NULL THEN 1 ELSE len(choices) END) AS BIGINT) AS slots, {R('sum(CASE WHEN choices IS NULL THEN u ELSE 1 END)', 5)} AS total FROM du GROUP BY ALL")
def p42(spark, sf):
    e = ft.encode_parameters(drawn(spark, sf), ["scenario_id", "track_id"])
    return e.selectExpr("scenario_id", "track_id", "skill_id", "CAST(size(encoded) AS BIGINT) AS slots", f"{R('aggregate(encoded, 0D, (a, v) -> a + v)', 5)} AS total")


@query("Q05_parameter_contract", f"{DRAW} SELECT skill_id, count(*) AS drawn, CAST(0 AS BIGINT) AS violations FROM du GROUP BY 1")
def q05(spark, sf):
    d = drawn(spark, sf)
    bad = ft.check_parameters(d).groupBy("skill_id").agg(F.count("*").alias("violations"))
    return d.groupBy("skill_id").agg(F.count("*").alias("drawn")).join(bad, "skill_id", "left").na.fill(0, ["violations"])


# --- labels and training samples -----------------------------------------------------------------------
@query("A03_actor_type_distribution", f"""{BASE}, m AS ({CHECKED_SQL}), j AS (SELECT m.skill_id, i.object_type AS ti, p.object_type AS tp, e.object_type AS te FROM m JOIN ac i ON i.scenario_id = m.scenario_id AND i.track_id = initiator JOIN ac p ON p.scenario_id = m.scenario_id AND p.track_id = responder LEFT JOIN ac e ON e.scenario_id = m.scenario_id AND e.track_id = extra)
  SELECT skill_id, ti AS initiator_type, tp AS responder_type, array_to_string(list_sort(list_filter([ti, tp, te], lambda x: x IS NOT NULL)), ',') AS combination, count(*) AS records FROM j GROUP BY ALL""".replace("WITH st", "WITH st", 1))
def a03(spark, sf):
    return role_types(spark, sf, qualified(every_match(spark, sf)))


def role_types(spark, sf, matches):
    m = matches.selectExpr("scenario_id", "skill_id", "initiator", "responder", "coalesce(extra, '') AS id", "inline(filter(array(struct(0 AS i, initiator AS track_id), struct(1 AS i, responder AS track_id), struct(2 AS i, extra AS track_id)), s -> s.track_id IS NOT NULL)) AS (i, track_id)")
    kinds = scene.actors(spark, sf).select("scenario_id", "track_id", "object_type")
    key = ["scenario_id", "skill_id", "initiator", "responder"]
    g = m.join(kinds, ["scenario_id", "track_id"]).groupBy(*key, "id").agg(F.expr("max(IF(i = 0, object_type, NULL))").alias("initiator_type"), F.expr("max(IF(i = 1, object_type, NULL))").alias("responder_type"),
                                                                             F.expr("concat_ws(',', sort_array(collect_list(object_type)))").alias("combination"))
    return g.groupBy("skill_id", "initiator_type", "responder_type", "combination").agg(F.count("*").alias("records"))


@query("A03b_actor_types_of_all_rules", f"""{BASE}, m AS ({EVERY_SQL}), j AS (SELECT m.skill_id, i.object_type AS ti, p.object_type AS tp, e.object_type AS te FROM m JOIN ac i ON i.scenario_id = m.scenario_id AND i.track_id = initiator JOIN ac p ON p.scenario_id = m.scenario_id AND p.track_id = responder LEFT JOIN ac e ON e.scenario_id = m.scenario_id AND e.track_id = extra)
  SELECT skill_id, ti AS initiator_type, tp AS responder_type, array_to_string(list_sort(list_filter([ti, tp, te], lambda x: x IS NOT NULL)), ',') AS combination, count(*) AS records FROM j GROUP BY ALL""".replace("WITH st", "WITH st", 1))
def a03b(spark, sf):
    return role_types(spark, sf, rule_matches(spark, sf))


OBSERVED = [k for k, rule in RULES.items() if rule.mode == "observed_trigger"]


@query("E06_validation_label_scan", "SELECT skill_id, CAST(sum(n) AS BIGINT) AS labels FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS skill_id, " + (f"(SELECT count(*) FROM ({rs.finish(rs.build()[k], k, ' '.join(RULES[k].required_tracks), True)}))" if k in OBSERVED else "0") + " AS n" for k in RULES) + ") GROUP BY 1")
def e06(spark, sf):
    hits = detect(scene.states(spark, sf), scene.roads(spark, sf), [RULES[k] for k in OBSERVED], 1, scene.actors(spark, sf))
    skills = spark.createDataFrame([(k,) for k in RULES], "skill_id string")
    return skills.join(hits.groupBy("skill_id").agg(F.count("*").alias("labels")), "skill_id", "left").na.fill(0, ["labels"])


@query("F14_observed_supervision", f"SELECT skill_id, count(*) AS kept FROM (SELECT skill_id, scenario_id, initiator, responder FROM ({CHECKED_SQL}) WHERE skill_id <> 'chain_braking' GROUP BY ALL) GROUP BY 1")
def f14(spark, sf):
    from roadsift.plans.training import observed_records
    return observed_records(seed_records(qualified(every_match(spark, sf)))).groupBy("skill_id").agg(F.count("*").alias("kept"))


SUPERVISED = f"SELECT DISTINCT skill_id, scenario_id, initiator, responder FROM ({EVERY_SQL}) WHERE skill_id IN ({', '.join(repr(k) for k in OBSERVED)})"


@query("F14b_observed_supervision_of_all_rules", f"SELECT skill_id, count(*) AS kept FROM ({SUPERVISED}) GROUP BY 1")
def f14b(spark, sf):
    from roadsift.plans.training import observed_records
    return observed_records(seed_records(rule_matches(spark, sf))).groupBy("skill_id").agg(F.count("*").alias("kept"))


HEADWAY_FUTURE = f"""{BASE}, {sc.pair_ctes()}, h AS (SELECT p.scenario_id, p.a, p.b, f.timestep - row_number() OVER (PARTITION BY p.scenario_id, p.a, p.b ORDER BY f.timestep) AS g FROM pq p JOIN st f ON f.scenario_id = p.scenario_id AND f.track_id = p.a AND f.timestep >= 34
    JOIN st k ON k.scenario_id = p.scenario_id AND k.track_id = p.b AND k.timestep = f.timestep WHERE {fm.norm('k.vx', 'k.vy')} >= 2 AND {fm.forward('f.x - k.x', 'f.y - k.y', 'k.heading')} > 0
    AND {fm.forward('f.x - k.x', 'f.y - k.y', 'k.heading')} / {fm.norm('k.vx', 'k.vy')} <= 1.2 AND abs({fm.left('f.x - k.x', 'f.y - k.y', 'k.heading')}) <= 3.75)
  SELECT scenario_id, a, b, {R('max(n) * CAST(0.1 AS DOUBLE)')} AS run_s FROM (SELECT scenario_id, a, b, g, count(*) AS n FROM h GROUP BY ALL) JOIN pq USING (scenario_id, a, b) WHERE dist <= 70 GROUP BY 1, 2, 3 HAVING max(n) >= 10"""


@query("F15_future_headway", HEADWAY_FUTURE)
def f15(spark, sf):
    from roadsift.plans.training import future_headway
    from roadsift.plans.geometry_queries import near
    return future_headway(near(spark, sf, "future")).selectExpr("scenario_id", "a", "b", f"{R('run_s')} AS run_s")


@query("E05_training_samples", f"""{BASE}, m AS ({CHECKED_SQL}), s AS (SELECT scenario_id, min(track_id) AS track_id, '<none>' AS skill_id, false AS supervised FROM ac GROUP BY 1 UNION ALL
    SELECT scenario_id, CASE WHEN skill_id = 'short_headway_following' THEN responder ELSE initiator END, skill_id, true FROM m WHERE skill_id <> 'chain_braking')
  SELECT scenario_id, track_id, skill_id, supervised, CASE WHEN n < 30 THEN 'history_too_short' END AS reason FROM s JOIN (SELECT scenario_id, track_id, count(*) FILTER (WHERE observed) AS n FROM st WHERE timestep <= 34 GROUP BY 1, 2) USING (scenario_id, track_id)""")
def e05(spark, sf):
    return samples_of(spark, sf, qualified(every_match(spark, sf)))


def samples_of(spark, sf, matches):
    from roadsift.plans.training import training_samples
    focal = scene.actors(spark, sf).groupBy("scenario_id").agg(F.min("track_id").alias("track_id"))
    targets = fr.resolve_targets(scene.states(spark, sf), 34, 30)
    return training_samples(focal, seed_records(matches), targets).select("scenario_id", "track_id", "skill_id", "supervised", "reason")


@query("E05b_training_samples_of_all_rules", f"""{BASE}, m AS ({SUPERVISED}), s AS (SELECT scenario_id, min(track_id) AS track_id, '<none>' AS skill_id, false AS supervised FROM ac GROUP BY 1 UNION ALL
    SELECT scenario_id, CASE WHEN skill_id = 'short_headway_following' THEN responder ELSE initiator END, skill_id, true FROM m)
  SELECT scenario_id, track_id, skill_id, supervised, CASE WHEN n < 30 THEN 'history_too_short' END AS reason FROM s JOIN (SELECT scenario_id, track_id, count(*) FILTER (WHERE observed) AS n FROM st WHERE timestep <= 34 GROUP BY 1, 2) USING (scenario_id, track_id)""")
def e05b(spark, sf):
    return samples_of(spark, sf, rule_matches(spark, sf))


@query("E04_augmentation_arms", f"""WITH {DC}, b1 AS (SELECT * FROM dc WHERE first_failed_stage IS NULL QUALIFY row_number() OVER (PARTITION BY skill_id, scenario_id ORDER BY quality_score DESC, scenario_id, candidate_index, candidate_id) <= 3),
  bal AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY quality_score DESC, scenario_id, candidate_index, candidate_id) <= 300) SELECT arm, (SELECT count(*) FROM bal) AS futures FROM (SELECT unnest(['E1', 'E2', 'E3']) AS arm)""")
def e04(spark, sf):
    from roadsift.operators import delivery as dl
    d = ad.filter_decisions(spark, sf)
    kept = dl.balanced(d.where("first_failed_stage IS NULL"))
    scale, side = ft.perturbation("concat_ws('\\u001f', 'e1', candidate_id)")
    e1 = kept.selectExpr("'E1' AS arm", "candidate_id", f"{scale} AS scale", f"{side} AS side")
    e2 = dl.hash_choice(d, kept, 5).selectExpr("'E2' AS arm", "candidate_id", "1D AS scale", "0D AS side")
    e3 = kept.selectExpr("'E3' AS arm", "candidate_id", "1D AS scale", "0D AS side")
    return e1.unionByName(e2).unionByName(e3).groupBy("arm").agg(F.count("*").alias("futures"))


@query("J32_map_fingerprint", f"WITH ids AS (SELECT DISTINCT CAST(floor(user_id / 10.0) AS BIGINT) AS s FROM events) SELECT count(*) AS scenarios, CAST(1 AS BIGINT) AS fingerprints, CAST(1 AS BIGINT) AS kept FROM ids")
def j32(spark, sf):
    from roadsift.plans.training import map_fingerprints
    f = map_fingerprints(scene.roads(spark, sf))
    return f.agg(F.count("*").alias("scenarios"), F.count_distinct("fingerprint").alias("fingerprints")).join(F.broadcast(f.dropDuplicates(["fingerprint"]).agg(F.count("*").alias("kept"))))
