"""Brute-force SQL over the driver tables (DuckDB): every pair, every segment, no grids."""

from __future__ import annotations

from roadsift import adapters
from roadsift.functions import formulas as fm


def _list(ids) -> str:
    return "CAST([" + ", ".join(f"'{i}'" for i in ids) + "] AS VARCHAR[])"


def _q(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


def road_ctes() -> str:
    segs = ", ".join(f"('{p}', '{k}', {i}, CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))"
                     for p, (k, *_, pts) in adapters.ROADS.items() for i, (a, b) in enumerate(zip(pts, pts[1:])))
    return f"""
    seg AS (SELECT *, coalesce(sum({fm.norm('x2 - x1', 'y2 - y1')}) OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc0,
              {fm.norm('x2 - x1', 'y2 - y1')} AS len, atan2(y2 - y1, x2 - x1) AS hd
            FROM (VALUES {segs}) AS s(pid, ptype, seq, x1, y1, x2, y2)),
    lane AS (SELECT l.*, g.*, (SELECT count(DISTINCT s.pid) FROM lane0 s WHERE list_contains(l.succ, s.pid) AND list_contains(s.pred, l.pid)) >= 2 AS diverges
             FROM lane0 l JOIN (SELECT pid AS gpid, sum(len) AS lane_length, arg_min(x1, seq) AS first_x, arg_min(y1, seq) AS first_y,
                                       arg_min(hd, seq) AS start_h, arg_max(hd, seq) AS end_h FROM seg GROUP BY pid) g ON l.pid = g.gpid)"""


def lane0_cte() -> str:
    lanes = ", ".join(f"('{p}', {_q(d)}, {str(c).lower()}, {_q(l)}, {_q(r)}, {_list(pr)}, {_list(su)})"
                      for p, (k, d, c, l, r, pr, su, pts) in adapters.ROADS.items() if k == "lane_centerline")
    return f"lane0 AS (SELECT * FROM (VALUES {lanes}) AS l(pid, direction, in_cross, left_id, right_id, pred, succ))"


def base(states: str | None = None) -> str:
    return f"""WITH st AS ({states or adapters.track_states_sql()}), {lane0_cte()}, {road_ctes()},
    rt AS (SELECT *, max(CASE WHEN observed THEN timestep END) OVER (PARTITION BY scenario_id, track_id) AS ref_t,
             {fm.norm('x - lag(x) OVER w', 'y - lag(y) OVER w')} / 0.1 AS sv FROM st WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY timestep)),
    ra AS (SELECT *, (sv - lag(sv) OVER (PARTITION BY scenario_id, track_id ORDER BY timestep)) / 0.1 AS acc FROM rt),
    ac AS (SELECT scenario_id, track_id, object_type, max(ref_t) AS ref_t, max(time_s) FILTER (WHERE timestep = ref_t) AS ref_time,
             max(x) FILTER (WHERE timestep = ref_t) AS x, max(y) FILTER (WHERE timestep = ref_t) AS y,
             max(vx) FILTER (WHERE timestep = ref_t) AS vx, max(vy) FILTER (WHERE timestep = ref_t) AS vy,
             max({fm.norm('vx', 'vy')}) FILTER (WHERE timestep = ref_t) AS speed,
             max(heading) FILTER (WHERE timestep = ref_t) AS heading, count(*) FILTER (WHERE observed) AS hist_steps,
             arg_max(x, timestep) AS end_x, arg_max(y, timestep) AS end_y, arg_max(heading, timestep) AS end_heading,
             min({fm.norm('vx', 'vy')}) FILTER (WHERE timestep >= ref_t) AS min_speed,
             coalesce(min(acc) FILTER (WHERE timestep >= ref_t + 2), 0) AS min_accel
           FROM ra GROUP BY 1, 2, 3),
    a1 AS (SELECT *, {fm.left('end_x - x', 'end_y - y', 'heading')} AS lat_m, {fm.wrap('end_heading - heading')} AS turn FROM ac),
    lc AS (SELECT scenario_id, track_id, a1.heading, pid, hd, arc0 + f * len AS arc, {fm.norm('x - (x1 + f * (x2 - x1))', 'y - (y1 + f * (y2 - y1))')} AS d, seq, f
           FROM (SELECT a1.*, s.*, {fm.seg_fraction('x', 'y', 'x1', 'y1', 'x2', 'y2')} AS f FROM a1, seg s
                 WHERE s.ptype = 'lane_centerline' AND object_type NOT IN ('static', 'construction', 'pedestrian')) a1),
    lb AS (SELECT lc.*, {fm.heading_gap('heading', 'hd')} AS err FROM lc
           QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id, pid ORDER BY d, seq, f) = 1),
    lm AS (SELECT lb.*, a1.object_type FROM lb JOIN a1 USING (scenario_id, track_id) JOIN lane0 USING (pid)
           WHERE d <= 5 AND CASE WHEN object_type = 'cyclist' THEN direction = 'bike' ELSE direction IN ('vehicle', 'bus') END),
    la AS (SELECT scenario_id, track_id, pid AS lane, d AS lane_dist, err AS lane_error, arc AS lane_arc FROM lm WHERE err <= radians(60)
           QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY d, err, pid) = 1),
    lg AS (SELECT scenario_id, track_id, pid AS any_lane, d AS any_dist, err AS any_error, hd AS any_heading FROM lm
           QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY d, err, pid) = 1),
    al AS (SELECT a1.*, la.lane, lane_dist, lane_error, lane_arc, any_lane, any_dist, any_error, any_heading, l.succ, l.pred, l.left_id, l.right_id,
             l.in_cross, l.lane_length, l.end_h AS lane_end_heading, l.diverges, g.succ AS any_succ
           FROM a1 LEFT JOIN la USING (scenario_id, track_id) LEFT JOIN lg USING (scenario_id, track_id)
           LEFT JOIN lane l ON la.lane = l.pid LEFT JOIN lane g ON lg.any_lane = g.pid)"""


COLUMNS = ("object_type ref_t ref_time x y vx vy speed heading hist_steps lat_m turn end_x end_y end_heading min_speed min_accel lane lane_dist lane_error "
           "lane_arc any_lane any_error any_heading succ pred left_id right_id in_cross lane_length lane_end_heading diverges any_succ").split()


def pair_ctes() -> str:
    cols = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in COLUMNS)
    return f"""
    pq AS (SELECT a.scenario_id, a.track_id AS a, b.track_id AS b, {fm.norm('a.x - b.x', 'a.y - b.y')} AS dist, {cols}
           FROM al a JOIN al b ON a.scenario_id = b.scenario_id AND a.track_id <> b.track_id),
    pf AS (SELECT p.scenario_id, p.a, p.b, f.timestep AS t, f.x - g.x AS rx, f.y - g.y AS ry, f.vx - g.vx AS rvx, f.vy - g.vy AS rvy
           FROM pq p JOIN st f ON f.scenario_id = p.scenario_id AND f.track_id = p.a AND f.timestep >= greatest(a_ref_t, b_ref_t)
                     JOIN st g ON g.scenario_id = p.scenario_id AND g.track_id = p.b AND g.timestep = f.timestep),
    pt AS (SELECT scenario_id, a, b, min({fm.ttc('(0 - rx)', '(0 - ry)', '(0 - rvx)', '(0 - rvy)')}) AS min_ttc FROM pf GROUP BY 1, 2, 3),
    pn AS (SELECT *, lead(t) OVER w AS nt, lead(rx) OVER w AS nx, lead(ry) OVER w AS ny FROM pf WINDOW w AS (PARTITION BY scenario_id, a, b ORDER BY t)),
    pd AS (SELECT scenario_id, a, b, min(CASE WHEN nt = t + 1 THEN {fm.interval_distance('rx', 'ry', 'nx', 'ny')} ELSE {fm.norm('rx', 'ry')} END) AS min_dist
           FROM pn GROUP BY 1, 2, 3),
    ps AS (SELECT scenario_id, track_id, timestep AS t, x AS x1, y AS y1, time_s AS s1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(time_s) OVER w AS s2
           FROM rt WHERE timestep >= ref_t WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY timestep)),
    cx0 AS (SELECT f.scenario_id, f.track_id AS a, g.track_id AS b, f.t AS a_seg, g.t AS b_seg, f.x1, f.y1, f.x2, f.y2, f.s1, f.s2, g.s1 AS t1, g.s2 AS t2,
              g.x1 - f.x1 AS ox, g.y1 - f.y1 AS oy, f.x2 - f.x1 AS eax, f.y2 - f.y1 AS eay, g.x2 - g.x1 AS ebx, g.y2 - g.y1 AS eby
            FROM ps f JOIN ps g ON f.scenario_id = g.scenario_id AND f.track_id <> g.track_id AND f.x2 IS NOT NULL AND g.x2 IS NOT NULL
             AND least(f.x1, f.x2) <= greatest(g.x1, g.x2) + 1e-9 AND least(g.x1, g.x2) <= greatest(f.x1, f.x2) + 1e-9
             AND least(f.y1, f.y2) <= greatest(g.y1, g.y2) + 1e-9 AND least(g.y1, g.y2) <= greatest(f.y1, f.y2) + 1e-9),
    cx1 AS (SELECT *, eax * eax + eay * eay AS la2, ebx * ebx + eby * eby AS lb2, eax * eby - eay * ebx AS den FROM cx0),
    cx2 AS (SELECT *, CASE WHEN la2 > 1e-9 AND lb2 > 1e-9 AND abs(den) > 1e-9 THEN (ox * eby - oy * ebx) / den END AS u,
              CASE WHEN la2 > 1e-9 AND lb2 > 1e-9 AND abs(den) > 1e-9 THEN (ox * eay - oy * eax) / den END AS v,
              CASE WHEN lb2 <= 1e-9 AND la2 > 1e-9 THEN (ox * eax + oy * eay) / la2 END AS fa,
              CASE WHEN la2 <= 1e-9 AND lb2 > 1e-9 THEN (0 - (ox * ebx + oy * eby)) / lb2 END AS fb FROM cx1),
    cx3 AS (SELECT *, CASE WHEN la2 <= 1e-9 AND lb2 <= 1e-9 THEN (CASE WHEN {fm.norm('ox', 'oy')} <= 1e-9 THEN 0.0 END)
                WHEN la2 <= 1e-9 THEN (CASE WHEN fb BETWEEN -1e-9 AND 1 + 1e-9 AND {fm.norm('ox + fb * ebx', 'oy + fb * eby')} <= 1e-9 THEN 0.0 END)
                WHEN lb2 <= 1e-9 THEN (CASE WHEN fa BETWEEN -1e-9 AND 1 + 1e-9 AND {fm.norm('ox - fa * eax', 'oy - fa * eay')} <= 1e-9 THEN {fm.clamp01('fa')} END)
                WHEN u BETWEEN -1e-9 AND 1 + 1e-9 AND v BETWEEN -1e-9 AND 1 + 1e-9 THEN {fm.clamp01('u')} END AS cu,
              CASE WHEN lb2 <= 1e-9 THEN 0.0 WHEN la2 <= 1e-9 THEN {fm.clamp01('fb')} ELSE {fm.clamp01('v')} END AS cv FROM cx2),
    cf AS (SELECT scenario_id, a, b, abs(ta - tb) AS time_gap, ta, tb, cx, cy FROM (
             SELECT *, s1 + cu * (s2 - s1) AS ta, t1 + cv * (t2 - t1) AS tb, x1 + cu * eax AS cx, y1 + cu * eay AS cy FROM cx3 WHERE cu IS NOT NULL)
           QUALIFY row_number() OVER (PARTITION BY scenario_id, a, b ORDER BY abs(ta - tb), greatest(ta, tb), a_seg, b_seg) = 1),
    pp AS (SELECT scenario_id, a, b, min(CASE WHEN x2 IS NULL THEN {fm.norm('a_x - x1', 'a_y - y1')}
                 ELSE {fm.norm('a_x - (x1 + f * (x2 - x1))', 'a_y - (y1 + f * (y2 - y1))')} END) AS path_dist
           FROM (SELECT p.scenario_id, p.a, p.b, p.a_x, p.a_y, s.x1, s.y1, s.x2, s.y2, {fm.seg_fraction('p.a_x', 'p.a_y', 's.x1', 's.y1', 's.x2', 's.y2')} AS f
                 FROM pq p JOIN ps s ON s.scenario_id = p.scenario_id AND s.track_id = p.b) q WHERE x2 IS NOT NULL OR f IS NOT NULL GROUP BY 1, 2, 3)"""


def on_polyline(points: str, keys: str, name: str) -> str:
    """Best projection of (px, py) on polyline ``pid`` named in the row of the relation ``points``."""
    return f"""{name} AS (SELECT {keys}, pid, d, arc, hd, off_m FROM (
        SELECT q.*, {fm.norm('px - (x1 + f * (x2 - x1))', 'py - (y1 + f * (y2 - y1))')} AS d, arc0 + f * len AS arc,
               cos(hd) * (py - (y1 + f * (y2 - y1))) - sin(hd) * (px - (x1 + f * (x2 - x1))) AS off_m
        FROM (SELECT t.*, s.x1, s.y1, s.x2, s.y2, s.seq, s.arc0, s.len, s.hd, {fm.seg_fraction('px', 'py', 's.x1', 's.y1', 's.x2', 's.y2')} AS f
              FROM {points} t JOIN seg s ON s.pid = t.pid) q)
        QUALIFY row_number() OVER (PARTITION BY {keys}, pid ORDER BY d, seq, f) = 1)"""


def nearest(points: str, keys: str, where: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, min({fm.norm('px - (x1 + f * (x2 - x1))', 'py - (y1 + f * (y2 - y1))')}) AS d
        FROM (SELECT t.*, s.*, {fm.seg_fraction('px', 'py', 's.x1', 's.y1', 's.x2', 's.y2')} AS f FROM {points} t, seg s WHERE {where}) q GROUP BY {keys})"""


def inside(points: str, keys: str, ptype: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {keys} FROM (SELECT {keys}, pid, sum(CASE WHEN (y2 > py) <> (y1 > py)
          AND px < (x1 - x2) * (py - y2) / (y1 - y2) + x2 THEN 1 ELSE 0 END) AS n FROM {points} t, seg s WHERE ptype = '{ptype}' GROUP BY {keys}, pid) WHERE n % 2 = 1)"""
