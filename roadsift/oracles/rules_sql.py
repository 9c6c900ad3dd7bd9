"""One brute-force SQL per interaction rule."""

from __future__ import annotations

from roadsift.functions import formulas as fm
from roadsift.oracles import scene_sql as sc

small, large = fm.score_small, fm.score_large
R6 = fm.rounded
fw = lambda o, r: fm.forward(f"{o}_x - {r}_x", f"{o}_y - {r}_y", f"{r}_heading")
lt = lambda o, r: fm.left(f"{o}_x - {r}_x", f"{o}_y - {r}_y", f"{r}_heading")
SAME = f"""(CASE WHEN a_lane IS NULL OR b_lane IS NULL THEN abs({{lat}}) <= 3.5 ELSE a_lane = b_lane OR list_contains(b_succ, a_lane)
  OR list_contains(a_succ, b_lane) OR list_contains(b_pred, a_lane) OR list_contains(a_pred, b_lane) END)"""
SAME_AB, SAME_BA = SAME.format(lat=lt("a", "b")), SAME.format(lat=lt("b", "a"))
GAP = lambda l, f: f"(CASE WHEN a_lane = b_lane THEN {l}_lane_arc - {f}_lane_arc ELSE {fw(l, f)} END)"
GAP_AB, GAP_BA = GAP("a", "b"), GAP("b", "a")
ADJ = lambda o, r: f"""(CASE WHEN a_lane IS NULL OR b_lane IS NULL THEN abs({lt(o, r)}) > 3.5 AND abs({lt(o, r)}) < 10
  ELSE coalesce(b_lane IN (a_left_id, a_right_id), false) OR coalesce(a_lane IN (b_left_id, b_right_id), false) END)"""
ADJ_AB = ADJ("a", "b")
TTC = fm.ttc("(b_x - a_x)", "(b_y - a_y)", "(b_vx - a_vx)", "(b_vy - a_vy)")
ANG = f"degrees({fm.heading_gap('a_heading', 'b_heading')})"
NEAR = "dist <= 70"
RISK = fm.risk_score
HZ = lambda v: f"coalesce({v} BETWEEN 0 AND 6, false)"
CROSS = lambda lo, hi, v, d: (f"a_lane <> b_lane AND NOT {SAME_AB} AND NOT {ADJ_AB} AND b_speed >= {v} AND dist >= {d} AND {ANG} BETWEEN {lo} AND {hi}")

PT = lambda keys, x, y, rel, pid=None: f"(SELECT scenario_id, {keys}, {x} AS px, {y} AS py{', ' + pid + ' AS pid' if pid else ''} FROM {rel})"
J = lambda name, keys="scenario_id, a, b": f" LEFT JOIN {name} USING ({keys})"

def rows(where: str, score: str, metric: str, value: str, ctes: str = "", joins: str = "", ini: str = "a", res: str = "b", rel: str = "pq", gate: str = "30",
         extra: str = "CAST(NULL AS VARCHAR)", types: tuple[str, str] | None = ("'vehicle'", "'vehicle'"), order: str = "") -> str:
    """All matches of a rule, before the per-scenario limit."""
    kinds = f"a_object_type IN ({types[0]}) AND b_object_type IN ({types[1]}) AND a_hist_steps >= {gate} AND b_hist_steps >= {gate} AND " if types else ""
    metric = metric if metric.startswith("CASE") else f"'{metric}'"
    return f"""{sc.base()}, {sc.pair_ctes()}{', ' + ctes if ctes else ''}
    SELECT scenario_id, {ini} AS initiator, {res} AS responder, {extra} AS extra, CAST({fm.clamp01(score)} AS DOUBLE) AS score,
           {metric} AS risk_metric, CAST({value} AS DOUBLE) AS risk_value FROM {rel}{joins} WHERE {kinds}{where}"""


def finish(sql: str, skill: str, required: str, limit: bool) -> str:
    """Required tracks, distinct roles, optional per-scenario limit, rounding."""
    kinds = " AND ".join(f"scenario_id IN (SELECT CAST(CAST(floor(user_id / 10.0) AS BIGINT) AS VARCHAR) FROM ({_seated()}) WHERE object_type = '{k}')" for k in required.split())
    pick = ("QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY score DESC, initiator, responder, extra) = 1" if limit else "")
    return (f"SELECT scenario_id, '{skill}' AS skill_id, initiator, responder, extra, {R6('score')} AS score, risk_metric, {R6('risk_value')} AS risk_value "
            f"FROM (SELECT * FROM ({sql}) m WHERE risk_value IS NOT NULL AND {kinds} {pick}) z")


def _seated() -> str:
    from roadsift.adapters import seats_sql
    return f"SELECT e.user_id, p.object_type FROM events e JOIN ({seats_sql()}) p ON CAST(floor(user_id / 10.0) AS BIGINT) % 6 = p.g AND user_id % 10 = p.k"


ARR = lambda s, x, y: f"(CASE WHEN {s}_speed > 1e-6 THEN {fm.norm(f'{x} - {s}_x', f'{y} - {s}_y')} / {s}_speed END)"
STOP = """sp AS (SELECT scenario_id, track_id AS a, timestep AS stop_t, time_s AS stop_time, x AS sx, y AS sy FROM rt WHERE timestep >= ref_t
      AND sqrt(vx * vx + vy * vy) <= 0.5 QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY timestep) = 1),
    sg AS (SELECT s.scenario_id, a, r.timestep - row_number() OVER (PARTITION BY s.scenario_id, a ORDER BY r.timestep) AS g
      FROM sp s JOIN rt r ON r.scenario_id = s.scenario_id AND r.track_id = a AND r.timestep >= stop_t AND sqrt(vx * vx + vy * vy) <= 0.5),
    sr AS (SELECT scenario_id, a, max(n) * CAST(0.1 AS DOUBLE) AS stop_s FROM (SELECT scenario_id, a, g, count(*) AS n FROM sg GROUP BY 1, 2, 3) GROUP BY 1, 2),
    sv AS (SELECT s.scenario_id, s.a, max(sqrt(vx * vx + vy * vy)) AS prior FROM sp s JOIN rt r ON r.scenario_id = s.scenario_id AND r.track_id = s.a AND r.timestep < stop_t GROUP BY 1, 2)"""
STOP_JOIN = J("sp", "scenario_id, a") + J("sr", "scenario_id, a") + J("sv", "scenario_id, a")
LOW = """lo AS (SELECT scenario_id, a, max(n) * CAST(0.1 AS DOUBLE) AS low_s FROM (SELECT scenario_id, a, g, count(*) AS n FROM (SELECT scenario_id, track_id AS a,
      timestep - row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY timestep) AS g FROM rt WHERE timestep >= ref_t AND sqrt(vx * vx + vy * vy) <= 2.0)
      GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
HEAD = f"""hw AS (SELECT scenario_id, a, b, max(n) * CAST(0.1 AS DOUBLE) AS run FROM (SELECT scenario_id, a, b, g, count(*) AS n FROM (
      SELECT p.scenario_id, p.a, p.b, f.timestep - row_number() OVER (PARTITION BY p.scenario_id, p.a, p.b ORDER BY f.timestep) AS g
      FROM pq p JOIN st f ON f.scenario_id = p.scenario_id AND f.track_id = p.a AND f.observed
                JOIN st k ON k.scenario_id = p.scenario_id AND k.track_id = p.b AND k.timestep = f.timestep AND k.observed
      WHERE {fm.norm('k.vx', 'k.vy')} >= 2.0 AND {fm.forward('f.x - k.x', 'f.y - k.y', 'k.heading')} > 0
        AND {fm.norm('k.vx', 'k.vy')} > 1e-9 AND {fm.forward('f.x - k.x', 'f.y - k.y', 'k.heading')} / {fm.norm('k.vx', 'k.vy')} <= 1.2) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
ENTRY = sc.nearest("(SELECT scenario_id, track_id, x AS px, y AS py FROM al)", "scenario_id, track_id", "s.pid IN (SELECT pid FROM lane0 WHERE in_cross)", "en")
ENTRY_A = " LEFT JOIN (SELECT scenario_id, track_id AS a, d AS a_entry FROM en) ea USING (scenario_id, a)"
ENTRY_B = " LEFT JOIN (SELECT scenario_id, track_id AS b, d AS b_entry FROM en) eb USING (scenario_id, b)"
CPT = "(SELECT scenario_id, a, b, cx AS px, cy AS py FROM cf)"
CCROSS = sc.nearest(CPT, "scenario_id, a, b", "s.pid IN (SELECT pid FROM lane0 WHERE in_cross)", "cc")
CC_JOIN = J("cf") + " LEFT JOIN (SELECT scenario_id, a, b, d AS cc_d FROM cc) c1 USING (scenario_id, a, b)"
WALK = (sc.nearest("(SELECT scenario_id, track_id, x AS px, y AS py FROM al)", "scenario_id, track_id", "ptype = 'pedestrian_crossing'", "wn") + ", "
        + sc.inside("(SELECT scenario_id, track_id, x AS px, y AS py FROM al)", "scenario_id, track_id", "pedestrian_crossing", "wi"))
WALK_JOIN = (" LEFT JOIN (SELECT wn.scenario_id, wn.track_id AS a, CASE WHEN wi.track_id IS NOT NULL THEN 0 ELSE d END AS a_walk FROM wn LEFT JOIN wi USING (scenario_id, track_id)) w "
             "USING (scenario_id, a)")
ON_B = sc.on_polyline(PT("a", "a_x", "a_y", "pq WHERE b_lane IS NOT NULL", "b_lane").replace("SELECT", "SELECT DISTINCT"), "scenario_id, a", "ob")
ON_B_JOIN = " LEFT JOIN (SELECT scenario_id, a, pid AS b_lane, d AS at_d, arc AS at_arc FROM ob) o1 USING (scenario_id, a, b_lane)"
END_B = sc.on_polyline(PT("a", "a_end_x", "a_end_y", "pq WHERE b_lane IS NOT NULL", "b_lane").replace("SELECT", "SELECT DISTINCT"), "scenario_id, a", "oe")
END_B_JOIN = " LEFT JOIN (SELECT scenario_id, a, pid AS b_lane, d AS end_d, hd AS end_hd FROM oe) o2 USING (scenario_id, a, b_lane)"
CONV = f"""cv0 AS (SELECT p.scenario_id, p.a, p.b, l.pid AS target, 'two_sources' AS relation, l.first_x AS x, l.first_y AS y, l.start_h FROM pq p JOIN lane l
        ON list_contains(a_succ, l.pid) AND list_contains(b_succ, l.pid) AND list_contains(l.pred, a_lane) AND list_contains(l.pred, b_lane) WHERE a_lane <> b_lane
      UNION ALL SELECT p.scenario_id, p.a, p.b, l.pid, 'first_feeds', l.first_x, l.first_y, l.start_h FROM pq p JOIN lane l ON l.pid = b_lane
        WHERE a_lane <> b_lane AND list_contains(a_succ, b_lane) AND list_contains(b_pred, a_lane) AND len(list_distinct(b_pred)) >= 2
      UNION ALL SELECT p.scenario_id, p.a, p.b, l.pid, 'second_feeds', l.first_x, l.first_y, l.start_h FROM pq p JOIN lane l ON l.pid = a_lane
        WHERE a_lane <> b_lane AND list_contains(b_succ, a_lane) AND list_contains(a_pred, b_lane) AND len(list_distinct(a_pred)) >= 2),
    cv1 AS (SELECT c.*, {fm.forward('c.x - a_x', 'c.y - a_y', 'a_heading')} AS f1, {fm.forward('c.x - b_x', 'c.y - b_y', 'b_heading')} AS f2,
        {fm.heading_gap('a_lane_end_heading', 'start_h')} AS ca, {fm.heading_gap('b_lane_end_heading', 'start_h')} AS cb FROM cv0 c JOIN pq USING (scenario_id, a, b)),
    cv AS (SELECT scenario_id, a, b, relation, target, x AS mx, y AS my, ca, cb FROM cv1 WHERE f1 > 0 AND f2 > 0 {{only}}
        QUALIFY row_number() OVER (PARTITION BY scenario_id, a, b ORDER BY greatest(f1, f2), relation, target) = 1)"""
CONV_ALL, CONV_TWO = CONV.format(only=""), CONV.format(only="AND relation = 'two_sources'")
TIE = "abs(ca - cb) <= radians(0.5)"
SWAP = f"(CASE relation WHEN 'first_feeds' THEN false WHEN 'second_feeds' THEN true ELSE (CASE WHEN {TIE} THEN (b_lane, b) < (a_lane, a) ELSE cb > ca END) END)"


def _merge(limits: str, metric: str, low: float, high: float, ties: bool, two: bool) -> str:
    ta, tb = ARR("a", "mx", "my"), ARR("b", "mx", "my")
    gap = f"abs({ta} - {tb})"
    where = f"{NEAR} AND a < b AND mx IS NOT NULL AND {ta} <= 6 AND {tb} <= 6 AND {limits.format(gap=gap)}" + ("" if ties else f" AND NOT (relation = 'two_sources' AND {TIE})")
    where += f" AND greatest({fm.norm('mx - a_x', 'my - a_y')}, {fm.norm('mx - b_x', 'my - b_y')}) <= 60"
    return rows(where, f"(({RISK(gap, low, high)}) + ({small('min_dist', '70.0')})) / 2", metric, gap, CONV_TWO if two else CONV_ALL, J("cv") + J("pd"),
                ini=f"CASE WHEN {SWAP} THEN b ELSE a END", res=f"CASE WHEN {SWAP} THEN a ELSE b END")


def _conflict(turn: str, low: float, high: float, metric: str, most: str = "3.0") -> str:
    return rows(f"{NEAR} AND {turn} AND time_gap <= {most} AND min_dist <= 6 AND cc_d <= 6", f"(({RISK('time_gap', low, high)}) + ({small('min_dist', '6.0')})) / 2",
                metric, "time_gap", CCROSS, CC_JOIN + J("pd"))


def _vru(cond: str, kind: str, ctes: str = "", joins: str = "") -> str:
    return rows(f"{NEAR} AND {cond} AND time_gap <= 4 AND min_dist <= 6", f"(({small('min_dist', '6.0')}) + ({RISK('time_gap', 0.5, 4.0)})) / 2", "post_encroachment_time",
                "time_gap", ctes, J("cf") + J("pd") + joins, types=(kind, "'vehicle'"), gate="20")


def _static(kind: str) -> str:
    late = "(CASE WHEN b_speed > 1e-6 THEN dist / b_speed END)"
    return rows(f"{NEAR} AND a_speed <= 0.5 AND {fw('a', 'b')} > 0 AND {late} <= 6 AND path_dist <= 8",
                f"(({small('path_dist', '8.0')}) + ({RISK('path_dist', 1.0, 4.0)})) / 2", "minimum_object_clearance", "path_dist", "", J("pp"), types=(kind, "'vehicle'"), gate="20")


def _ttc_or(metric: str, bound: str, low: float, high: float, proxy: str = "minimum_trajectory_distance"):
    s = HZ("min_ttc")
    return (f"CASE WHEN {s} THEN '{metric}' ELSE '{proxy}' END", f"CASE WHEN {s} THEN min_ttc ELSE min_dist END",
            f"CASE WHEN {s} THEN {RISK('min_ttc', low, high)} ELSE {small('min_dist', bound)} END")


def _queue(skill: str, lo: float, hi: float, tail: str) -> str:
    vb = "'vehicle', 'bus'"
    front, rear = GAP_BA, GAP_AB
    ctes = f"""q0 AS (SELECT * FROM pq WHERE a_object_type IN ({vb}) AND b_object_type IN ({vb}) AND a_hist_steps >= 30 AND b_hist_steps >= 30 AND {SAME_BA}),
    qf AS (SELECT scenario_id, a, b AS f, {front} AS fg, dist AS fd, b_speed AS fs FROM q0 WHERE {front} BETWEEN {lo} AND {hi}
           QUALIFY row_number() OVER (PARTITION BY scenario_id, a ORDER BY {front}, b) = 1),
    qr AS (SELECT scenario_id, a, b AS r, {rear} AS rg, dist AS rd, b_speed AS rs FROM q0 WHERE {rear} BETWEEN {lo} AND {hi}
           QUALIFY row_number() OVER (PARTITION BY scenario_id, a ORDER BY {rear}, b) = 1),
    qq AS (SELECT q.*, al.speed AS ms FROM (qf JOIN qr USING (scenario_id, a)) q JOIN al ON al.scenario_id = q.scenario_id AND al.track_id = q.a WHERE f <> r)"""
    score = small("fg + rg", str(2 * hi))
    if skill == "chain_braking":
        close = "greatest(ms - fs, rs - ms)"
        return rows(f"least(fd, rd) >= 2 AND least(fs, ms, rs) >= 1 AND {close} > 0", f"(({score}) + ({large(close, '0.5')})) / 2", tail, "least(fg, rg)", ctes, "",
                    "f", "a", "qq", extra="r", types=None)
    close = "(greatest(0, ms - fs) + greatest(0, rs - ms))"
    return rows(f"least(fd, rd) >= 2 AND {close} >= 0.5", f"(({score}) + ({large(close, '0.5')})) / 2", tail, "least(fg, rg)", ctes, "", "a", "f", "qq", extra="r", types=None)


def _front_rear(filt: str, joins: str, front: str, rear: str, fr: str, rr: str, part: str, more: str, kinds: str) -> str:
    """Nearest front and rear neighbours per (actor, group) as relation ``n``."""
    return f"""n0 AS (SELECT *, {front} AS fg, {rear} AS rg FROM pq{joins} WHERE {kinds} AND {filt}),
    nf AS (SELECT {part}, b AS f, fg, min_ttc AS ft {more.format(p='f')} FROM n0 WHERE {fr} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY fg, b) = 1),
    nr AS (SELECT {part}, b AS r, rg, min_ttc AS rt {more.format(p='r')} FROM n0 WHERE {rr} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY rg, b) = 1),
    nn AS (SELECT q.*, al.lat_m, al.speed FROM (nf JOIN nr USING ({part})) q JOIN al ON al.scenario_id = q.scenario_id AND al.track_id = q.a)"""


LEAST = f"least(CASE WHEN {HZ('ft')} THEN ft END, CASE WHEN {HZ('rt')} THEN rt END)"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    lead = f"{NEAR} AND {SAME_AB} AND {GAP_AB} > 0"
    close = "(b_speed - a_speed)"
    out["lead_hard_brake"] = rows(f"{lead} AND {GAP_AB} <= 55 AND a_min_accel <= -2 AND {close} >= 1 AND {TTC} IS NOT NULL",
                                  f"(({large('(0 - a_min_accel)', '2.0')}) + ({RISK(TTC, 1.0, 4.0)})) / 2", "time_to_collision", TTC)
    margin = f"({GAP_AB} + {fm.norm('sx - a_x', 'sy - a_y')} - b_speed * greatest(0, stop_time - a_ref_time))"
    out["lead_sudden_stop"] = rows(f"{lead} AND {GAP_AB} BETWEEN 2 AND 55 AND b_speed >= 1 AND {close} >= 0.5 AND prior >= 2 AND stop_s >= 1 AND {margin} >= 0",
                                   f"((({large('stop_s', '1.0')}) + ({small('a_min_speed', '0.500001')})) / 2 + ({RISK(margin, 0.5, 8.0)})) / 2",
                                   "stopping_distance_margin", margin, STOP, STOP_JOIN)
    out["slow_lead_blockage"] = rows(f"{lead} AND {GAP_AB} BETWEEN 2 AND 45 AND a_speed <= 2 AND b_speed >= 1 AND {close} >= 0.5 AND low_s >= 2",
                                     f"((({small('a_speed', '2.0')}) + ({large('low_s', '2.0')})) / 2 + ({RISK(GAP_AB, 3.0, 15.0)})) / 2",
                                     "minimum_longitudinal_gap", GAP_AB, LOW, J("lo", "scenario_id, a"), types=("'vehicle', 'bus'", "'vehicle'"))
    way = f"({GAP_AB} / b_speed)"
    out["short_headway_following"] = rows(f"{lead} AND b_speed >= 2 AND {way} <= 1.2 AND run >= 1", RISK(way, 0.4, 1.2), "time_headway", way, HEAD, J("hw"))
    out["rear_vehicle_rapid_approach"] = rows(f"{NEAR} AND {SAME_BA} AND {GAP_BA} > 0 AND {GAP_BA} <= 40 AND a_speed - b_speed >= 1 AND {TTC} <= 4",
                                              f"(({large('(a_speed - b_speed)', '1.0')}) + ({RISK(TTC, 1.0, 4.0)})) / 2", "rear_time_to_collision", TTC)
    out["chain_braking"] = _queue("chain_braking", 2.0, 45.0, "minimum_longitudinal_gap")
    out["multi_vehicle_gap_squeeze"] = _queue("multi_vehicle_gap_squeeze", 2.0, 25.0, "minimum_combined_clearance")
    final = fm.forward("a_end_x - b_end_x", "a_end_y - b_end_y", "b_end_heading")
    out["adjacent_vehicle_cut_in"] = rows(f"{NEAR} AND abs(a_lat_m) >= 2 AND {ADJ_AB} AND end_d <= 5 AND {final} BETWEEN 4 AND 18 AND {HZ('min_ttc')}",
                                          f"(({large('abs(a_lat_m)', '2.0')}) + ({RISK('min_ttc', 1.0, 4.0)})) / 2", "post_cut_in_time_to_collision", "min_ttc",
                                          END_B, END_B_JOIN + J("pt"))
    veh = "a_object_type = 'vehicle' AND b_object_type = 'vehicle' AND a_hist_steps >= 30 AND b_hist_steps >= 30"
    ctes = f"""r0 AS (SELECT * FROM pq WHERE {veh} AND a_lane IS NOT NULL AND b_lane IS NOT NULL AND coalesce(a_left_id, a_right_id) IS NOT NULL),
    rf AS (SELECT scenario_id, a, b AS f, {GAP_AB} AS bg FROM r0 WHERE {SAME_AB} AND {GAP_AB} BETWEEN 2 AND 55
           QUALIFY row_number() OVER (PARTITION BY scenario_id, a ORDER BY {GAP_AB}, b) = 1),
    rl AS (SELECT scenario_id, a, f, b AS s, a_lat_m AS lat_cut FROM r0 JOIN rf USING (scenario_id, a) WHERE b <> f AND {SAME_BA} AND {GAP_BA} BETWEEN 2 AND 55 AND b_speed <= 2
           QUALIFY row_number() OVER (PARTITION BY scenario_id, a ORDER BY {GAP_BA}, b) = 1),
    rr AS (SELECT pq.*, min_ttc, rl.a AS cut, lat_cut FROM rl JOIN pq ON pq.scenario_id = rl.scenario_id AND pq.a = rl.f AND pq.b = rl.s
           JOIN pt ON pt.scenario_id = pq.scenario_id AND pt.a = pq.a AND pt.b = pq.b)"""
    part = f"CASE WHEN {HZ('min_ttc')} THEN {RISK('min_ttc', 1.0, 4.0)} ELSE {small(GAP_BA, '110.0')} END"
    out["cut_out_reveals_slow_vehicle"] = rows(f"{GAP_BA} > 0", f"0.5 + 0.25 * (CASE WHEN abs(lat_cut) > 0.5 THEN 1 ELSE 0 END) + 0.25 * ({part})",
        f"CASE WHEN {HZ('min_ttc')} THEN 'newly_exposed_time_to_collision' ELSE 'newly_exposed_longitudinal_gap' END",
        f"CASE WHEN {HZ('min_ttc')} THEN min_ttc ELSE {GAP_BA} END", ctes, "", "cut", "a", "rr", extra="b", types=None)
    ahead = fw("b", "a")
    ctes = _front_rear(f"abs(a_lat_m) >= 2 AND {ADJ_AB}", J("pt"), ahead, f"0 - {ahead}", "fg > 0 AND fg <= 15", "rg > 0 AND rg <= 15", "scenario_id, a", "", veh)
    out["narrow_gap_lane_change"] = rows("f <> r", f"(({large('abs(lat_m)', '2.0')}) + ({small('fg + rg', '30.0')}) + ({RISK(LEAST, 1.0, 4.0)})) / 3",
                                         "minimum_front_rear_time_to_collision", LEAST, ctes, "", "a", "f", "nn", extra="r", types=None)
    cyc = "a_object_type = 'cyclist' AND b_object_type IN ('vehicle', 'bus') AND a_hist_steps >= 20 AND b_hist_steps >= 20"
    ctes = (ON_B + ", " + END_B + ", " + _front_rear(
        f"a_lane IS NOT NULL AND b_lane IS NOT NULL AND abs(a_lat_m) >= 0.5 AND {ADJ_AB} AND end_d <= 5 AND end_d < at_d AND degrees({fm.heading_gap('a_end_heading', 'end_hd')}) <= 45",
        ON_B_JOIN + END_B_JOIN + J("pt") + J("pd"), "b_lane_arc - at_arc", "at_arc - b_lane_arc", "fg > 0 AND fg <= 30", "rg > 0 AND rg <= 30", "scenario_id, a, b_lane",
        ", min_dist AS {p}m", cyc))
    mn = "least(fm, rm)"
    out["cyclist_vehicle_merge"] = rows("f <> r", f"(({large('abs(lat_m)', '0.5')}) + ({small('fg + rg', '60.0')}) + (CASE WHEN {LEAST} IS NOT NULL THEN {RISK(LEAST, 1.0, 4.0)} "
        f"ELSE {small(mn, '70.0')} END)) / 3", f"CASE WHEN {LEAST} IS NOT NULL THEN 'minimum_front_rear_time_to_collision' ELSE 'minimum_front_rear_trajectory_distance' END",
        f"coalesce({LEAST}, {mn})", ctes, "", "a", "f", "nn", extra="r", types=None)
    trail = """ts AS (SELECT scenario_id, track_id AS a, (ref_t - coalesce(max(timestep) FILTER (WHERE NOT slow), -1)) * CAST(0.1 AS DOUBLE) AS still FROM (
        SELECT scenario_id, track_id, timestep, ref_t, observed AND sqrt(vx * vx + vy * vy) <= 0.5 AS slow FROM rt WHERE timestep <= ref_t) GROUP BY 1, 2, ref_t)"""
    ctes = (ON_B + ", " + trail + ", " + _front_rear(
        f"a_speed <= 0.5 AND still >= 1 AND b_speed >= 1 AND dist >= 2 AND b_lane IS NOT NULL AND ({SAME_AB} OR {ADJ_AB}) AND at_d <= 5 AND min_dist >= 2",
        ON_B_JOIN + J("pt") + J("pd") + J("ts", "scenario_id, a"), "b_lane_arc - at_arc", "at_arc - b_lane_arc", "fg BETWEEN 2 AND 55", "rg BETWEEN 2 AND 55", "scenario_id, a, b_lane",
        ", min_dist AS {p}m, still AS {p}still", veh))
    out["stopped_vehicle_reentry"] = rows("f <> r", f"(({small('speed', '0.500001')}) + ({large('fstill', '1.0')}) + (CASE WHEN {LEAST} IS NOT NULL THEN {RISK(LEAST, 1.0, 4.0)} "
        f"ELSE {small(mn, '55.0')} END)) / 3", f"CASE WHEN {LEAST} IS NOT NULL THEN 'minimum_front_rear_time_to_collision' ELSE 'minimum_front_rear_trajectory_distance_proxy' END",
        f"coalesce({LEAST}, {mn})", ctes, "", "a", "f", "nn", extra="r", types=None)
    moto = "a_object_type = 'motorcyclist' AND b_object_type IN ('vehicle', 'bus') AND a_hist_steps >= 20 AND b_hist_steps >= 20"
    ctes = f"""m0 AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, a ORDER BY dist, b) AS n FROM pq WHERE {moto} AND a_speed >= 1 AND dist BETWEEN 1 AND 7),
    m1 AS (SELECT p.scenario_id, p.a, p.b, q.b AS c, p.dist AS d1, q.dist AS d2, p.a_x AS mx, p.a_y AS my, p.b_x AS x1, p.b_y AS y1, q.b_x - p.b_x AS dx, q.b_y - p.b_y AS dy
           FROM m0 p JOIN m0 q ON p.scenario_id = q.scenario_id AND p.a = q.a AND p.n < q.n),
    m2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS g, ((mx - x1) * dx + (my - y1) * dy) / (dx * dx + dy * dy) AS pos FROM m1)"""
    out["motorcyclist_filtering_conflict"] = rows(f"g BETWEEN 1 AND 10 AND pos BETWEEN 0.1 AND 0.9 AND {fm.norm('mx - (x1 + pos * dx)', 'my - (y1 + pos * dy)')} <= 3",
        f"(({small('g', '10.0')}) + ({small('greatest(d1, d2)', '7.0')})) / 2", "minimum_combined_clearance", "least(d1, d2)", ctes, "", "a", "b", "m2", extra="c", types=None)
    shared = f"""sn0 AS (SELECT p.*, l.pid AS tid, l.left_id AS tl, l.right_id AS tr, l.lane_length AS tlen,
        coalesce(a_right_id = l.pid AND b_left_id = l.pid, false) AS fwd_ok, coalesce(b_right_id = l.pid AND a_left_id = l.pid, false) AS back_ok
        FROM pq p JOIN lane l ON l.pid IN (a_left_id, a_right_id) AND l.pid IN (b_left_id, b_right_id) WHERE a < b AND a_lane <> b_lane
        QUALIFY row_number() OVER (PARTITION BY scenario_id, a, b ORDER BY l.pid) = 1),
      sn1 AS (SELECT *, CASE WHEN fwd_ok THEN (CASE WHEN tl = a_lane AND tr = b_lane THEN 'a' END) WHEN back_ok AND tl = b_lane AND tr = a_lane THEN 'b' END AS lft FROM sn0),
      {sc.on_polyline("(SELECT DISTINCT scenario_id, a AS k, a_x AS px, a_y AS py, tid AS pid FROM sn1 WHERE lft IS NOT NULL UNION SELECT DISTINCT scenario_id, b, b_x, b_y, tid FROM sn1 WHERE lft IS NOT NULL)", "scenario_id, k", "sk")},
      sn AS (SELECT sn1.*, u.off_m AS la1, v.off_m AS lb1 FROM sn1 JOIN sk u ON u.scenario_id = sn1.scenario_id AND u.k = a AND u.pid = tid
             JOIN sk v ON v.scenario_id = sn1.scenario_id AND v.k = b AND v.pid = tid WHERE lft IS NOT NULL)"""
    along = f"(CASE WHEN lft = 'b' THEN abs({fw('b', 'a')}) ELSE abs({fw('a', 'b')}) END)"
    metric, value, part = _ttc_or("lateral_time_to_collision", "70.0", 0.5, 3.0)
    out["simultaneous_lane_change_conflict"] = rows(f"{NEAR} AND NOT {SAME_AB} AND dist >= 2 AND {along} <= 12 AND tlen >= 15 AND la1 * lb1 < 0 AND min_dist IS NOT NULL",
        f"0.5 + 0.25 * ({small(along, '12.0')}) + 0.25 * ({part})", metric, value, shared, J("pt") + J("pd"),
        "CASE WHEN lft = 'b' THEN b ELSE a END", "CASE WHEN lft = 'b' THEN a ELSE b END", "sn")
    block = f"""tb0 AS (SELECT scenario_id, a AS v, b AS o, dist AS od FROM pq WHERE b_object_type IN ('vehicle', 'bus') AND {ADJ_AB}),
      tb AS (SELECT p.scenario_id, p.a, p.b, min(od) AS traffic FROM pq p JOIN tb0 t ON t.scenario_id = p.scenario_id AND t.v = p.b AND t.o <> p.a GROUP BY 1, 2, 3)"""
    comb = "least(path_dist, coalesce(traffic, path_dist))"
    out["forced_lane_change_around_blockage"] = rows(
        f"{NEAR} AND a_speed <= 0.5 AND b_speed >= 1 AND dist >= 2 AND {fw('a', 'b')} BETWEEN 2 AND 35 AND coalesce(b_left_id, b_right_id) IS NOT NULL "
        f"AND (a_object_type NOT IN ('vehicle', 'bus') OR {SAME_AB}) AND path_dist <= 8", f"(({small('path_dist', '8.0')}) + ({RISK(comb, 1.0, 6.0)})) / 2",
        "minimum_combined_clearance", comb, block, J("pp") + " LEFT JOIN tb USING (scenario_id, a, b)", types=("'vehicle', 'static', 'construction'", "'vehicle'"))
    end = "greatest(0, a_lane_length - a_lane_arc)"
    gap = f"abs({fw('b', 'a')})"
    both = "'vehicle', 'bus'"
    out["late_lane_change_before_diverge"] = rows(f"{NEAR} AND a_diverges AND b_lane IS NOT NULL AND {ADJ_AB} AND {end} > 0 AND {end} <= 60 AND b_lane_length >= 20 AND {gap} <= 20 AND dist >= 2",
        f"(({small(end, '60.0')}) + ({small(gap, '20.0')})) / 2", "distance_to_diverge", end, types=(both, both))
    metric, value, part = _ttc_or("minimum_crossing_time_to_collision", "18.0", 1.0, 4.0)
    out["diverge_lane_crossing_conflict"] = rows(f"{NEAR} AND a_diverges AND a_lane <> b_lane AND {ADJ_AB} AND {end} > 0 AND {end} <= 60 AND {gap} <= 18 AND abs(a_lat_m) >= 0.25 "
        f"AND a_lat_m * {lt('b', 'a')} > 0", f"0.5 + 0.25 * ({small(end, '60.0')}) + 0.25 * ({part})", metric, value, "", J("pt") + J("pd"))
    out["ramp_merge_small_gap"] = _merge("{gap} <= 3 AND min_dist <= 6", "conflict_point_time_gap", 0.5, 3.0, False, False)
    out["lane_drop_merge_competition"] = _merge("dist <= 55", "convergence_time_gap", 0.5, 3.0, False, True)
    out["merge_without_yield"] = _merge("{gap} <= 4", "conflict_point_time_gap", 0.5, 2.5, True, False)
    any_point = """ap AS (SELECT p.scenario_id, p.a, p.b, l.first_x AS ax0, l.first_y AS ay0 FROM pq p JOIN lane l ON l.pid = CASE
        WHEN len(list_intersect(a_succ, b_succ)) > 0 THEN list_min(list_intersect(a_succ, b_succ)) WHEN list_contains(a_succ, b_lane) THEN b_lane WHEN list_contains(b_succ, a_lane) THEN a_lane END)"""
    ta, tb = ARR("a", "ax0", "ay0"), ARR("b", "ax0", "ay0")
    bike = f"(CASE WHEN time_gap IS NOT NULL THEN time_gap WHEN {ta} <= 6 AND {tb} <= 6 THEN abs({ta} - {tb}) END)"
    out["bike_lane_vehicle_merge_conflict"] = rows(f"{NEAR} AND {bike} <= 3 AND min_dist <= 6", f"(({RISK(bike, 0.5, 3.0)}) + ({small('min_dist', '70.0')})) / 2",
        "post_encroachment_time", bike, any_point, J("cf") + J("pd") + J("ap"), types=("'cyclist'", "'vehicle'"), gate="20")
    zt = lambda s: f"(CASE WHEN {s}_speed > 1e-6 THEN {fm.norm(f'mx - {s}_x', f'my - {s}_y')} / {s}_speed END)"
    zip_ = f"""{CONV_TWO},
      z0 AS (SELECT scenario_id, mx, my, CASE WHEN {SWAP} THEN b ELSE a END AS m, CASE WHEN {SWAP} THEN a ELSE b END AS k FROM pq JOIN cv USING (scenario_id, a, b)
             WHERE a < b AND dist <= 70 AND a_object_type IN ({both}) AND b_object_type IN ({both}) AND a_hist_steps >= 30 AND b_hist_steps >= 30
             AND greatest({fm.norm('mx - a_x', 'my - a_y')}, {fm.norm('mx - b_x', 'my - b_y')}) <= 60),
      z1 AS (SELECT z0.*, q.b AS c, {GAP_BA} AS sg FROM z0 JOIN pq q ON q.scenario_id = z0.scenario_id AND q.a = z0.k AND q.b <> z0.m
             WHERE q.b_object_type IN ({both}) AND q.b_hist_steps >= 30 AND {SAME_BA} AND abs({GAP_BA}) BETWEEN 2 AND 35
             QUALIFY row_number() OVER (PARTITION BY z0.scenario_id, z0.m, z0.k ORDER BY abs({GAP_BA}), q.b) = 1),
      z2 AS (SELECT z1.*, {', '.join(f'{s}.x AS {s}_x, {s}.y AS {s}_y, {s}.speed AS {s}_speed' for s in ('tm', 'tk', 'tc'))} FROM z1
             JOIN al tm ON tm.scenario_id = z1.scenario_id AND tm.track_id = m JOIN al tk ON tk.scenario_id = z1.scenario_id AND tk.track_id = k
             JOIN al tc ON tc.scenario_id = z1.scenario_id AND tc.track_id = c),
      z3 AS (SELECT *, {zt('tm')} AS t1, {zt('tk')} AS t2, {zt('tc')} AS t3, greatest({fm.norm('mx - tm_x', 'my - tm_y')}, {fm.norm('mx - tk_x', 'my - tk_y')}) AS reach,
             least({fm.norm('tm_x - tk_x', 'tm_y - tk_y')}, {fm.norm('tm_x - tc_x', 'tm_y - tc_y')}, {fm.norm('tk_x - tc_x', 'tk_y - tc_y')}) AS near FROM z2)"""
    late = "greatest(abs(t1 - t2), abs(t1 - t3))"
    mid = "(t1 + t2 + t3 - least(t1, t2, t3) - greatest(t1, t2, t3))"
    so = "list_sort([t1, t2, t3])"
    out["zipper_merge_multi_vehicle"] = rows(f"near >= 2 AND {late} <= 5", f"(({small('reach', '60.0')}) + ({small(late, '5.0')})) / 2", "convergence_time_gap",
        f"least({so}[2] - {so}[1], {so}[3] - {so}[2])", zip_, "", "m", "CASE WHEN sg > 0 THEN c ELSE k END", "z3", extra="CASE WHEN sg > 0 THEN k ELSE c END", types=None)
    out["unprotected_left_turn_conflict"] = _conflict(f"degrees(a_turn) >= 25 AND {ANG} >= 120", 0.5, 3.0, "post_encroachment_time")
    out["right_turn_vehicle_conflict"] = _conflict("degrees(0 - a_turn) >= 25", 0.5, 3.0, "conflict_point_time_gap")
    out["crossing_path_conflict"] = _conflict(f"a < b AND {ANG} >= 25", 0.5, 3.0, "post_encroachment_time")
    wait = "greatest(0, tb - b_ref_time)"
    out["intersection_creep_conflict"] = rows(f"{NEAR} AND a_speed <= 2 AND a_entry <= 8 AND {CROSS(30, 150, 1, 2)} AND cc_d <= 6 AND {wait} <= 5",
        f"0.5 + 0.25 * ({small('a_entry', '8.0')}) + 0.25 * ({small(wait, '5.0')})", "conflict_area_intrusion_margin", "greatest(a_entry, 1e-6)", ENTRY + ", " + CCROSS, ENTRY_A + CC_JOIN)
    cl = sc.on_polyline("(SELECT scenario_id, a, b, cx AS px, cy AS py, a_lane AS pid FROM cf JOIN pq USING (scenario_id, a, b))", "scenario_id, a, b", "cl")
    over = f"greatest(0, least(a_lane_length / greatest(a_speed, 0.1), 5.0) - {wait})"
    out["intersection_blocking_vehicle"] = rows(f"{NEAR} AND a_speed <= 0.5 AND a_in_cross AND a_lane_dist <= 6 AND a_lane_length >= 3 AND {CROSS(30, 150, 1, 2)} AND cl_d <= 6 AND {wait} <= 5 AND {over} > 0",
        f"(({small('a_speed', '0.5')}) + ({RISK(over, 0.5, 3.0, True)})) / 2", "potential_conflict_area_occupancy_overlap_proxy", over, cl,
        J("cf") + " LEFT JOIN (SELECT scenario_id, a, b, d AS cl_d FROM cl) c2 USING (scenario_id, a, b)")
    far = "greatest(a_entry, b_entry)"
    out["mutual_yield_deadlock"] = rows(f"{NEAR} AND a < b AND greatest(a_speed, b_speed) <= 2 AND a_entry <= 8 AND b_entry <= 8 AND {CROSS(30, 150, 0, 2)}",
        f"(({small('greatest(a_speed, b_speed)', '2.0')}) + ({small(far, '8.0')})) / 2", "maximum_distance_to_intersection_entry", far, ENTRY, ENTRY_A + ENTRY_B)
    out["abrupt_u_turn_conflict"] = rows(f"{NEAR} AND a_speed >= 0.5 AND a_entry <= 12 AND dist BETWEEN 2 AND 45 AND {ANG} >= 120",
        f"(({small('a_entry', '12.0')}) + ({large(ANG, '120.0')})) / 2", f"CASE WHEN {HZ(TTC)} THEN 'head_on_time_to_collision' ELSE 'oncoming_vehicle_distance' END",
        f"CASE WHEN {HZ(TTC)} THEN {TTC} ELSE dist END", ENTRY, ENTRY_A, types=(both, both))
    out["crosswalk_pedestrian_crossing"] = _vru("a_walk <= 8", "'pedestrian'", WALK, WALK_JOIN)
    out["turning_vehicle_crosswalk_conflict"] = _vru("a_walk <= 8 AND degrees(abs(b_turn)) >= 25", "'pedestrian'", WALK, WALK_JOIN)
    out["cyclist_crossing"] = _vru(f"{ANG} BETWEEN 45 AND 135", "'cyclist'")
    jay = (sc.nearest(CPT, "scenario_id, a, b", "ptype = 'pedestrian_crossing'", "jn") + ", " + sc.inside(CPT, "scenario_id, a, b", "pedestrian_crossing", "ji") + ", "
           + sc.inside(CPT, "scenario_id, a, b", "drivable_area", "jd"))
    out["jaywalking_pedestrian_crossing"] = _vru(f"{ANG} BETWEEN 30 AND 150 AND j_walk >= 10 AND j_in", "'pedestrian'", jay,
        " LEFT JOIN (SELECT jn.scenario_id, jn.a, jn.b, CASE WHEN ji.a IS NOT NULL THEN 0 ELSE d END AS j_walk, jd.a IS NOT NULL AS j_in FROM jn LEFT JOIN ji USING (scenario_id, a, b) "
        "LEFT JOIN jd USING (scenario_id, a, b)) j USING (scenario_id, a, b)")
    bd = sc.nearest("(SELECT scenario_id, track_id, x AS px, y AS py FROM al)", "scenario_id, track_id", "ptype = 'drivable_area'", "bd")
    late = "(CASE WHEN b_speed > 1e-6 THEN dist / b_speed END)"
    out["roadside_pedestrian_emergence"] = rows(f"{NEAR} AND a_edge <= 8 AND {fw('a', 'b')} > 0 AND {late} <= 4 AND path_dist <= 6",
        f"0.5 + 0.25 * ({small('a_edge', '8.0')}) + 0.25 * ({small(late, '4.0')})", "vehicle_arrival_time_to_boundary_proxy", late, bd,
        J("pp") + " LEFT JOIN (SELECT scenario_id, track_id AS a, d AS a_edge FROM bd) b1 USING (scenario_id, a)", types=("'pedestrian'", "'vehicle'"), gate="20")
    group = f"""g0 AS (SELECT * FROM pq JOIN cf USING (scenario_id, a, b) JOIN pd USING (scenario_id, a, b) WHERE dist <= 70 AND a_object_type = 'pedestrian'
        AND b_object_type IN ({both}) AND a_hist_steps >= 20 AND b_hist_steps >= 20 AND time_gap <= 4 AND min_dist <= 6),
      g1 AS (SELECT f.scenario_id, f.a, f.b, s.a AS c, f.dist, least(f.time_gap, s.time_gap) AS gap, {fm.norm('f.a_x - s.a_x', 'f.a_y - s.a_y')} AS md
        FROM g0 f JOIN g0 s ON f.scenario_id = s.scenario_id AND f.b = s.b AND f.a <> s.a
        WHERE {fm.norm('f.a_x - s.a_x', 'f.a_y - s.a_y')} <= 5 AND degrees({fm.heading_gap('f.a_heading', 's.a_heading')}) <= 45 AND {fm.norm('f.cx - s.cx', 'f.cy - s.cy')} <= 6
        QUALIFY row_number() OVER (PARTITION BY f.scenario_id, f.a, f.b ORDER BY {fm.norm('f.a_x - s.a_x', 'f.a_y - s.a_y')}, degrees({fm.heading_gap('f.a_heading', 's.a_heading')}), s.min_dist, s.a) = 1),
      g2 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY scenario_id, b, least(a, c), greatest(a, c) ORDER BY dist, a) = 1)"""
    out["group_pedestrian_crossing"] = rows("true", f"(({small('md', '5.0')}) + ({RISK('gap', 0.5, 4.0)})) / 2", "post_encroachment_time", "gap", group, "", "a", "b", "g2", extra="c", types=None)
    run = f"""op AS (SELECT scenario_id, a, max(n) * CAST(0.1 AS DOUBLE) AS run FROM (SELECT scenario_id, a, g, count(*) AS n FROM (
        SELECT r.scenario_id, r.track_id AS a, r.timestep - row_number() OVER (PARTITION BY r.scenario_id, r.track_id ORDER BY r.timestep) AS g
        FROM rt r JOIN al ON al.scenario_id = r.scenario_id AND al.track_id = r.track_id WHERE r.observed AND {fm.heading_gap('r.heading', 'any_heading')} >= radians(120)) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    out["wrong_way_vehicle"] = rows(f"{NEAR} AND degrees(a_any_error) >= 120 AND a_speed >= 2 AND NOT coalesce(a_in_cross, false) AND b_lane_error <= radians(60) "
        f"AND (a_any_lane = b_lane OR list_contains(b_pred, a_any_lane) OR list_contains(a_any_succ, b_lane)) AND dist <= 60 AND run >= 1 AND {TTC} IS NOT NULL",
        f"(({large('a_any_error', 'radians(120)')}) + ({RISK(TTC, 1.0, 5.0)})) / 2", "head_on_time_to_collision", TTC, run, J("op", "scenario_id, a"))
    out["construction_object_lane_blockage"] = _static("'construction'")
    out["static_object_avoidance"] = _static("'static'")
    ahead = fw("a", "b")
    room = "greatest(0, b_lane_length - at_arc)"
    metric, value, part = _ttc_or("minimum_stage_time_to_collision", "18.0", 1.0, 4.0)
    out["cut_in_then_brake"] = rows(f"{NEAR} AND {ADJ_AB} AND {ahead} BETWEEN 4 AND 18 AND at_d <= 5 AND {room} >= 10",
        f"0.5 + 0.25 * ({large(room, '10.0')}) + 0.25 * ({part})", metric, value, ON_B, ON_B_JOIN + J("pt") + J("pd"))
    return out


def rule_sql(skill: str, required: str, limit: bool = True) -> str:
    return finish(build()[skill], skill, required, limit)
