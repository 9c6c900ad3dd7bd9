"""Wide frame rows of the candidates, built with plain joins (DuckDB)."""

from __future__ import annotations

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.funnel import risk as rk
from roadsift.oracles import scene_sql as sc

STATE = ("x", "y", "vx", "vy", "heading")


def base() -> str:
    sides = ", ".join(f"{t}.{c} AS {t}_{c}" for t in ("b", "c") for c in STATE)
    w = "WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)"
    speed = lambda r: f"{fm.norm(f'{r}_x - lag({r}_x) OVER w', f'{r}_y - lag({r}_y) OVER w')} / (time_s - lag(time_s) OVER w) AS {r}_speed"
    anchor = ", ".join(f"max({r}_{c}) FILTER (WHERE timestep = 34) OVER p AS o{r}_{c}" for r in "abc" for c in ("x", "y", "heading"))
    cross = "u BETWEEN -1e-9 AND 1 + 1e-9 AND v BETWEEN -1e-9 AND 1 + 1e-9"
    return f"""{sc.base()}, cd AS ({ad.CANDIDATES_SQL.format(states='st')}), tk AS (SELECT DISTINCT candidate_id, scenario_id, a, b, c, object_type, candidate_index FROM cd),
    o0 AS (SELECT candidate_id, timestep, CAST(timestep AS DOUBLE) / 10 AS time_s, x, y, NULL AS vx, NULL AS vy, NULL AS heading FROM cd
           UNION ALL SELECT tk.candidate_id, timestep, time_s, x, y, vx, vy, heading FROM tk JOIN st ON st.scenario_id = tk.scenario_id AND st.track_id = tk.a WHERE timestep IN (33, 34)),
    o1 AS (SELECT *, CASE WHEN timestep > 34 THEN (x - lag(x) OVER w) / (time_s - lag(time_s) OVER w) ELSE vx END AS ux, CASE WHEN timestep > 34 THEN (y - lag(y) OVER w) / (time_s - lag(time_s) OVER w) ELSE vy END AS uy FROM o0 {w}),
    o2 AS (SELECT *, CASE WHEN timestep <= 34 THEN heading WHEN sqrt(ux * ux + uy * uy) > 1e-6 THEN atan2(uy, ux) END AS turn FROM o1),
    ov AS (SELECT candidate_id, timestep, time_s, x, y, ux AS vx, uy AS vy, last_value(turn IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY timestep) AS heading FROM o2),
    wd AS (SELECT ov.candidate_id, tk.scenario_id, tk.a, tk.b, tk.c, tk.object_type, ov.timestep, ov.time_s, 4.8::DOUBLE AS end_s, {', '.join(f'ov.{c} AS a_{c}' for c in STATE)}, {sides}
           FROM ov JOIN tk USING (candidate_id) LEFT JOIN st b ON b.scenario_id = tk.scenario_id AND b.track_id = tk.b AND b.timestep = ov.timestep
           LEFT JOIN st c ON c.scenario_id = tk.scenario_id AND c.track_id = tk.c AND c.timestep = ov.timestep WHERE ov.timestep >= 34),
    w1 AS (SELECT *, {', '.join(speed(r) for r in 'abc')} FROM wd {w}),
    w2 AS (SELECT *, {', '.join(f'({r}_speed - lag({r}_speed) OVER w) / (time_s - lag(time_s) OVER w) AS {r}_accel' for r in 'abc')}, {anchor} FROM w1 WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep), p AS (PARTITION BY candidate_id)),
    {', '.join(f"s{r} AS (SELECT candidate_id, timestep AS t, time_s AS s1, {r}_x AS x1, {r}_y AS y1, lead({r}_x) OVER w AS x2, lead({r}_y) OVER w AS y2, lead(time_s) OVER w AS s2 FROM wd {w})" for r in 'abc')},
    {_gap_cte('ab')}, {_gap_cte('ac')},
    cl AS (SELECT candidate_id, min({fm.norm('a_x - b_x', 'a_y - b_y')}) AS d, min_by((a_x + b_x) / 2, ({fm.norm('a_x - b_x', 'a_y - b_y')}, timestep)) AS mx, min_by((a_y + b_y) / 2, ({fm.norm('a_x - b_x', 'a_y - b_y')}, timestep)) AS my
           FROM wd WHERE b_x IS NOT NULL GROUP BY 1),
    w3 AS (SELECT w2.*, timestep > 34 AS fut, coalesce(g.cx, CASE WHEN cl.d <= 6 THEN mx END) AS px, coalesce(g.cy, CASE WHEN cl.d <= 6 THEN my END) AS py FROM w2 LEFT JOIN gab g USING (candidate_id) LEFT JOIN cl USING (candidate_id)),
    w4 AS (SELECT *, coalesce(lag({rk.inside_square('a')}) OVER (PARTITION BY candidate_id ORDER BY timestep), false) AS last_inside FROM w3)"""


def _gap_cte(pair: str) -> str:
    p, q = pair
    return f"""i{pair} AS (SELECT f.candidate_id, f.t AS at1, g.t AS bt1, f.*, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2, g.s1 AS gs1, g.s2 AS gs2,
        (f.x2 - f.x1) * (g.y2 - g.y1) - (f.y2 - f.y1) * (g.x2 - g.x1) AS den FROM s{p} f JOIN s{q} g ON g.candidate_id = f.candidate_id WHERE f.x2 IS NOT NULL AND g.x2 IS NOT NULL
        AND (f.x2 - f.x1) * (f.x2 - f.x1) + (f.y2 - f.y1) * (f.y2 - f.y1) > 1e-9 AND (g.x2 - g.x1) * (g.x2 - g.x1) + (g.y2 - g.y1) * (g.y2 - g.y1) > 1e-9),
      j{pair} AS (SELECT *, ((gx1 - x1) * (gy2 - gy1) - (gy1 - y1) * (gx2 - gx1)) / den AS u, ((gx1 - x1) * (y2 - y1) - (gy1 - y1) * (x2 - x1)) / den AS v FROM i{pair} WHERE abs(den) > 1e-9),
      k{pair} AS (SELECT candidate_id, at1, bt1, s1 + {fm.clamp01('u')} * (s2 - s1) AS ta, gs1 + {fm.clamp01('v')} * (gs2 - gs1) AS tb, x1 + {fm.clamp01('u')} * (x2 - x1) AS cx, y1 + {fm.clamp01('u')} * (y2 - y1) AS cy
        FROM j{pair} WHERE u BETWEEN -1e-9 AND 1 + 1e-9 AND v BETWEEN -1e-9 AND 1 + 1e-9),
      g{pair} AS (SELECT candidate_id, abs(ta - tb) AS value, cx, cy FROM k{pair} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY abs(ta - tb), greatest(ta, tb), at1, bt1) = 1)"""
