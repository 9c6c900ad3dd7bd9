"""Target risk, conflict points and trigger conditions with a rule for each candidate, written out for DuckDB.

Nothing here is made from the implementation's text: every metric is spelled out over all frames and all segment pairs.
Only fixed values (rules, bounds) are shared.
"""

from __future__ import annotations

from roadsift.funnel import ruled
from roadsift.oracles import funnel_sql as fs
from roadsift.rules.catalog import RULES


def _rules() -> str:
    rows = ", ".join(f"({i}, '{s}', '{c}', {int(s in ruled.SECOND_ROLE_TARGET)}, {RULES[s].low}::DOUBLE, {RULES[s].high}::DOUBLE, '{RULES[s].metric}', '{RULES[s].mode}')" for i, (s, (c, _)) in enumerate(ruled.RISKS.items()))
    pairs = ", ".join(f"('{s}', {p}, {q}, '{RULES[s].roles[p]}->{RULES[s].roles[q]}')" for s, (_, ps) in ruled.RISKS.items() for p, q in ps)
    bounds = ", ".join(f"('{s}', '{n}', {v}::DOUBLE)" for s in ruled.RISKS for n, v in [*RULES[s].thresholds.items(), *((f"{n}.{e}", v[i]) for n, v in RULES[s].parameters.items() if not isinstance(v[0], str) for i, e in enumerate(("low", "high"))), ("risk_high", RULES[s].high)])
    return f"""ru AS (SELECT * FROM (VALUES {rows}) AS t(no, skill_id, calc, second, low, high, metric, mode)), rp AS (SELECT skill_id, p, q, label FROM (VALUES {pairs}) AS t(skill_id, p, q, label)),
    rb AS (SELECT skill_id, map_from_entries(list((name, v))) AS bounds FROM (VALUES {bounds}) AS t(skill_id, name, v) GROUP BY 1)"""


def _segments(name: str, source: str, x: str, y: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT candidate_id, timestep AS t, time_s AS s1, {x} AS x1, {y} AS y1, lead({x}) OVER w AS x2, lead({y}) OVER w AS y2, lead(time_s) OVER w AS s2, lead(timestep) OVER w AS nt
      FROM {source} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)) WHERE nt = t + 1)"""


def _crossing(name: str, one: str, other: str, key: str = "candidate_id") -> str:
    """Crossing with the least time between the two passages, for each key."""
    return f"""{name} AS (SELECT {key}, abs(ta - tb) AS gap, cx, cy FROM (
        SELECT *, s1 + least(greatest(u, 0), 1) * (s2 - s1) AS ta, o1 + least(greatest(v, 0), 1) * (o2 - o1) AS tb, x1 + least(greatest(u, 0), 1) * (x2 - x1) AS cx, y1 + least(greatest(u, 0), 1) * (y2 - y1) AS cy FROM (
          SELECT *, ((gx - x1) * (hy - gy) - (gy - y1) * (hx - gx)) / den AS u, ((gx - x1) * (y2 - y1) - (gy - y1) * (x2 - x1)) / den AS v FROM (
            SELECT f.*, g.t AS gt, g.x1 AS gx, g.y1 AS gy, g.x2 AS hx, g.y2 AS hy, g.s1 AS o1, g.s2 AS o2, (f.x2 - f.x1) * (g.y2 - g.y1) - (f.y2 - f.y1) * (g.x2 - g.x1) AS den FROM {one} f JOIN {other} g USING ({key}))
          WHERE abs(den) > 1e-9 AND (x2 - x1) ** 2 + (y2 - y1) ** 2 > 1e-9 AND (hx - gx) ** 2 + (hy - gy) ** 2 > 1e-9)
        WHERE u BETWEEN -1e-9 AND 1 + 1e-9 AND v BETWEEN -1e-9 AND 1 + 1e-9)
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY abs(ta - tb), greatest(ta, tb), t, gt) = 1)"""


def _closest(name: str, source: str, q: str) -> str:
    """Least synchronised distance of a and another role, both moving evenly between frames."""
    return f"""{name} AS (SELECT candidate_id, min(d) AS d, arg_min(mx, (d, timestep)) AS mx, arg_min(my, (d, timestep)) AS my FROM (
        SELECT candidate_id, timestep, sqrt((rx + f * sx) ** 2 + (ry + f * sy) ** 2) AS d, (a_x + f * coalesce(nax - a_x, 0) + {q}_x + f * coalesce(nqx - {q}_x, 0)) / 2 AS mx, (a_y + f * coalesce(nay - a_y, 0) + {q}_y + f * coalesce(nqy - {q}_y, 0)) / 2 AS my FROM (
          SELECT *, CASE WHEN nt = timestep + 1 AND sx * sx + sy * sy > 1e-9 THEN least(greatest((0 - (rx * sx + ry * sy)) / (sx * sx + sy * sy), 0), 1) ELSE 0 END AS f FROM (
            SELECT *, coalesce((nax - nqx) - rx, 0) AS sx, coalesce((nay - nqy) - ry, 0) AS sy FROM (
              SELECT *, a_x - {q}_x AS rx, a_y - {q}_y AS ry, lead(timestep) OVER w AS nt, lead(a_x) OVER w AS nax, lead(a_y) OVER w AS nay, lead({q}_x) OVER w AS nqx, lead({q}_y) OVER w AS nqy FROM {source} WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep))
            WHERE rx IS NOT NULL))) GROUP BY 1)"""


def base() -> str:
    """Role rows (a, b, c by slot) of every candidate with its rule, seeds and conflict points."""
    state = ("x", "y", "vx", "vy", "heading")
    swapped = ", ".join(f"CASE second WHEN 1 THEN wd.{o}_{c} ELSE wd.{r}_{c} END AS {r}_{c}" for r, o in (("a", "b"), ("b", "a")) for c in state)
    return f"""{fs.base()}, {_rules()},
    an AS (SELECT tk.*, CASE second WHEN 1 THEN b ELSE a END AS t0, CASE second WHEN 1 THEN a ELSE b END AS t1, c AS t2, ru.* EXCLUDE (no) FROM tk JOIN ru ON ru.no = (CAST(a AS BIGINT) + 11 * candidate_index) % {len(ruled.FORMAL)}),
    r0 AS (SELECT wd.candidate_id, an.metric, an.low, an.high, wd.timestep, wd.time_s, wd.end_s, an.skill_id, an.calc, {swapped}, wd.c_x, wd.c_y, wd.c_vx, wd.c_vy, wd.c_heading FROM wd JOIN an USING (candidate_id)),
    r1 AS (SELECT * REPLACE ({', '.join(f"coalesce({r}_heading, CASE WHEN sqrt({r}_vx ** 2 + {r}_vy ** 2) > 1e-9 THEN atan2({r}_vy, {r}_vx) END) AS {r}_heading" for r in 'abc')}), timestep > 34 AS fut FROM r0),
    q0 AS (SELECT an.candidate_id, x.timestep, x.time_s, x.x AS a_x, x.y AS a_y, y.x AS b_x, y.y AS b_y FROM an JOIN st x ON x.scenario_id = an.scenario_id AND x.track_id = an.t0 LEFT JOIN st y ON y.scenario_id = an.scenario_id AND y.track_id = an.t1 AND y.timestep = x.timestep WHERE x.timestep BETWEEN 34 AND 48),
    {_segments('ga', 'r1', 'a_x', 'a_y')}, {_segments('gb', 'r1', 'b_x', 'b_y')}, {_segments('ra1', 'q0', 'a_x', 'a_y')}, {_segments('rb1', 'q0', 'b_x', 'b_y')},
    {_crossing('made', 'ga', 'gb')}, {_crossing('rec', 'ra1', 'rb1')},
    sd AS (SELECT an.candidate_id, CASE WHEN rec.gap <= 2 AND mode = 'compatible_seed' THEN rec.cx END AS seed_x, CASE WHEN rec.gap <= 2 AND mode = 'compatible_seed' THEN rec.cy END AS seed_y, x.lane AS la, y.lane AS lb, z.lane AS lc FROM an LEFT JOIN rec USING (candidate_id)
      LEFT JOIN al x ON x.scenario_id = an.scenario_id AND x.track_id = t0 LEFT JOIN al y ON y.scenario_id = an.scenario_id AND y.track_id = t1 LEFT JOIN al z ON z.scenario_id = an.scenario_id AND z.track_id = t2),
    ln1 AS (SELECT candidate_id, seq AS t, seq AS s1, seq + 1 AS s2, x1, y1, x2, y2 FROM sd JOIN seg ON pid = la WHERE la <> lb), ln2 AS (SELECT candidate_id, seq AS t, seq AS s1, seq + 1 AS s2, x1, y1, x2, y2 FROM sd JOIN seg ON pid = lb WHERE la <> lb),
    {_crossing('lx', 'ln1', 'ln2')}, {_closest('nb', 'r1', 'b')}, {_closest('nc', 'r1', 'c')},
    cp AS (SELECT sd.candidate_id, coalesce(seed_x, lx.cx, made.cx, rec.cx, CASE WHEN nb.d <= 6 THEN nb.mx END) AS px, coalesce(seed_y, lx.cy, made.cy, rec.cy, CASE WHEN nb.d <= 6 THEN nb.my END) AS py,
      CASE WHEN seed_x IS NOT NULL THEN 'frozen_seed_conflict_point' WHEN lx.cx IS NOT NULL THEN 'frozen_seed_lane_map_intersection' WHEN made.cx IS NOT NULL THEN 'generated_path_intersection' WHEN rec.cx IS NOT NULL THEN 'source_path_intersection' WHEN nb.d <= 6 THEN 'generated_closest_approach_proxy' ELSE 'unavailable' END AS point_source
      FROM sd LEFT JOIN lx USING (candidate_id) LEFT JOIN made USING (candidate_id) LEFT JOIN rec USING (candidate_id) LEFT JOIN nb USING (candidate_id)),
    r2 AS (SELECT r1.*, px, py, abs(a_x - px) <= 2 AND abs(a_y - py) <= 2 AS ina, abs(b_x - px) <= 2 AND abs(b_y - py) <= 2 AS inb, {', '.join(f"CASE WHEN timestep - lag(timestep) OVER w = 1 THEN sqrt(({r}_x - lag({r}_x) OVER w) ** 2 + ({r}_y - lag({r}_y) OVER w) ** 2) / (time_s - lag(time_s) OVER w) END AS {r}_speed" for r in 'abc')},
      {', '.join(f"max({r}_{c}) FILTER (timestep = 34) OVER o AS o{r}_{c}" for r in 'abc' for c in ('x', 'y', 'heading'))} FROM r1 JOIN cp USING (candidate_id) WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep), o AS (PARTITION BY candidate_id)),
    r3 AS (SELECT r2.*, bounds, lag(ina) OVER w AS was_in, {', '.join(f"({r}_speed - lag({r}_speed) OVER w) / (time_s - lag(time_s) OVER w) AS {r}_accel" for r in 'abc')},
      (a_y - b_y) * cos(ob_heading) - (a_x - b_x) * sin(ob_heading) AS lat, (a_x - b_x) * cos(ob_heading) + (a_y - b_y) * sin(ob_heading) AS lon,
      (oa_y - ob_y) * cos(ob_heading) - (oa_x - ob_x) * sin(ob_heading) AS lat0, ((a_y - b_y) - (oa_y - ob_y)) * cos(ob_heading) - ((a_x - b_x) - (oa_x - ob_x)) * sin(ob_heading) AS shift FROM r2 JOIN rb USING (skill_id) WINDOW w AS (PARTITION BY candidate_id ORDER BY timestep)),
    e1 AS (SELECT candidate_id, min(timestep) FILTER (fut AND abs(shift) >= 1) AS expo, min(timestep) FILTER (fut AND abs(lat0) >= 1 AND abs(lat) <= greatest(0.75, 0.35 * abs(lat0)) AND lon > 0) AS cut FROM r3 GROUP BY 1),
    e2 AS (SELECT candidate_id, any_value(expo) AS expo, any_value(cut) AS cut, min(timestep) FILTER (fut AND timestep >= cut AND a_accel <= 0 - coalesce(bounds['peak_deceleration_mps2.low'], 2)) AS stage FROM r3 JOIN e1 USING (candidate_id) GROUP BY 1)"""


TTC = """CASE WHEN g2 <= 0 THEN 0 WHEN w2 <= 1e-9 OR disc < -1e-9 THEN NULL WHEN (0 - lin - sqrt(greatest(disc, 0))) / (2 * w2) >= -1e-9 THEN greatest(0, (0 - lin - sqrt(greatest(disc, 0))) / (2 * w2))
      WHEN (0 - lin + sqrt(greatest(disc, 0))) / (2 * w2) >= -1e-9 THEN greatest(0, (0 - lin + sqrt(greatest(disc, 0))) / (2 * w2)) END"""


def risk() -> str:
    """CTE ``ev``: candidate_id, skill_id, metric, low, high, status, reason, value, pair."""
    pick = lambda c, k: f"[a_{c}, b_{c}, c_{c}][{k} + 1]"
    return f"""p0 AS (SELECT r3.candidate_id, r3.skill_id, metric, low, high, calc, label, timestep AS t, time_s AS s, end_s, fut, px, py, ina, was_in, CASE r3.skill_id WHEN 'cut_out_reveals_slow_vehicle' THEN expo WHEN 'cut_in_then_brake' THEN stage END AS event,
        {', '.join(f"{pick(c, k)} AS {c[0] if c == 'heading' else c}{n}" for n, k in ((1, 'p'), (2, 'q')) for c in ('x', 'y', 'vx', 'vy', 'heading'))} FROM r3 JOIN rp USING (skill_id) JOIN e2 USING (candidate_id)),
    p1 AS (SELECT *, lead(t) OVER w AS nt, lead(s) OVER w AS ns, lead(x1 - x2) OVER w AS nrx, lead(y1 - y2) OVER w AS nry, x1 - x2 AS rx, y1 - y2 AS ry, (x1 - x2) * cos(h2) + (y1 - y2) * sin(h2) AS gap, vx1 * cos(h2) + vy1 * sin(h2) AS lead_v, vx2 * cos(h2) + vy2 * sin(h2) AS own_v,
        (x2 - x1) ** 2 + (y2 - y1) ** 2 AS g2, (vx2 - vx1) ** 2 + (vy2 - vy1) ** 2 AS w2, 2 * ((x2 - x1) * (vx2 - vx1) + (y2 - y1) * (vy2 - vy1)) AS lin, end_s - s + 1e-9 AS left_s, x1 IS NOT NULL AND x2 IS NOT NULL AND vx1 IS NOT NULL AND vx2 IS NOT NULL AS full_,
        cos(h1) + cos(h2) AS mx, sin(h1) + sin(h2) AS my FROM p0 WINDOW w AS (PARTITION BY candidate_id, label ORDER BY t)),
    p2 AS (SELECT *, lin * lin - 4 * w2 * g2 AS disc, sqrt(mx * mx + my * my) AS mn, CASE WHEN nt = t + 1 AND nrx IS NOT NULL THEN (nrx - rx) ** 2 + (nry - ry) ** 2 END AS step2 FROM p1 WHERE fut),
    p3 AS (SELECT *, CASE WHEN mn <= 1e-9 THEN (y2 - y1) * cos(h1) - (x2 - x1) * sin(h1) ELSE ((y2 - y1) * mx - (x2 - x1) * my) / mn END AS sep, CASE WHEN mn <= 1e-9 THEN (vy2 - vy1) * cos(h1) - (vx2 - vx1) * sin(h1) ELSE ((vy2 - vy1) * mx - (vx2 - vx1) * my) / mn END AS sv,
        CASE WHEN gap <= 0 THEN 0 WHEN own_v - lead_v > 1e-9 THEN gap / (own_v - lead_v) END AS along, CASE WHEN full_ THEN {TTC} END AS hit, 0 - ((vx2 - vx1) * (x2 - x1) + (vy2 - vy1) * (y2 - y1)) / sqrt(g2) AS radial,
        CASE WHEN step2 > 1e-9 THEN least(greatest((0 - (rx * (nrx - rx) + ry * (nry - ry))) / step2, 0), 1) ELSE 0 END AS f FROM p2),
    p4 AS (SELECT *, CASE WHEN calc IN ('front_rear_ttc', 'event_ttc') THEN full_ AND h2 IS NOT NULL AND (calc = 'front_rear_ttc' OR coalesce(t >= event, false)) WHEN calc = 'headway' THEN gap IS NOT NULL WHEN calc IN ('point_ttc', 'radial_ttc') THEN full_
          WHEN calc = 'lateral_ttc' THEN full_ AND h1 IS NOT NULL AND h2 IS NOT NULL WHEN calc = 'area_overlap' THEN x1 IS NOT NULL AND x2 IS NOT NULL AND nt IS NOT NULL ELSE false END AS sample,
        CASE calc WHEN 'gap' THEN gap WHEN 'headway' THEN CASE WHEN gap <= 0 THEN 0 WHEN own_v > 1e-9 THEN gap / own_v END WHEN 'stopping_margin' THEN gap - greatest(0, (greatest(0, own_v) ** 2 - greatest(0, lead_v) ** 2) / 12)
          WHEN 'front_rear_ttc' THEN CASE WHEN along <= left_s THEN along END WHEN 'event_ttc' THEN CASE WHEN t >= event AND along <= left_s THEN along END WHEN 'point_ttc' THEN CASE WHEN hit <= left_s THEN hit END
          WHEN 'radial_ttc' THEN CASE WHEN sqrt(g2) <= 1e-9 THEN 0 WHEN radial > 1e-9 AND sqrt(g2) / radial <= left_s THEN sqrt(g2) / radial END
          WHEN 'lateral_ttc' THEN CASE WHEN abs(sep) <= 1e-9 THEN 0 WHEN abs(sv) > 1e-9 AND 0 - sep / sv >= 0 AND 0 - sep / sv <= left_s THEN 0 - sep / sv END
          WHEN 'clearance' THEN sqrt((rx + f * coalesce(nrx - rx, 0)) ** 2 + (ry + f * coalesce(nry - ry, 0)) ** 2)
          WHEN 'area_margin' THEN CASE WHEN x1 + px IS NOT NULL THEN sqrt(greatest(abs(x1 - px) - 2, 0) ** 2 + greatest(abs(y1 - py) - 2, 0) ** 2) END END AS v FROM p3),
    p5 AS (SELECT candidate_id, skill_id, any_value(metric) AS metric, any_value(low) AS low, any_value(high) AS high, calc, min(v) AS v, arg_min(label, (v, label)) FILTER (v IS NOT NULL) AS label, min(label) AS first_label, bool_or(sample) AS sampled, count(px) > 0 AS pointed, count(event) > 0 AS evented,
        coalesce(sum(ns - s) FILTER (sample AND abs(x1 - px) <= 2 AND abs(y1 - py) <= 2 AND abs(x2 - px) <= 2 AND abs(y2 - py) <= 2), 0) AS held, min(t) FILTER (ina AND NOT was_in) AS entry FROM p4 GROUP BY candidate_id, skill_id, calc),
    p6 AS (SELECT candidate_id, vx1 IS NOT NULL AND x2 IS NOT NULL AND vx2 IS NOT NULL AS seen, CASE WHEN hit <= left_s THEN hit END AS hit FROM p3 JOIN p5 USING (candidate_id) WHERE p5.calc = 'area_entry_ttc' AND t = entry),
    y1 AS (SELECT candidate_id || '|' || label AS k, candidate_id AS cand, label, t AS timestep, s AS time_s, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM p0 WHERE calc = 'path_gap'), y2 AS (SELECT k AS candidate_id, * EXCLUDE (k) FROM y1),
    {_segments('ya', 'y2', 'ax', 'ay')}, {_segments('yb', 'y2', 'bx', 'by_')}, {_crossing('yx', 'ya', 'yb')},
    yl AS (SELECT DISTINCT candidate_id FROM (SELECT candidate_id, fl, gl, fx, fy, gx, gy, ox, oy, (fx * gx + fy * gy) / fl AS run, (ox * fx + oy * fy) / fl AS off FROM (
        SELECT f.candidate_id, f.x2 - f.x1 AS fx, f.y2 - f.y1 AS fy, g.x2 - g.x1 AS gx, g.y2 - g.y1 AS gy, g.x1 - f.x1 AS ox, g.y1 - f.y1 AS oy, sqrt((f.x2 - f.x1) ** 2 + (f.y2 - f.y1) ** 2) AS fl, sqrt((g.x2 - g.x1) ** 2 + (g.y2 - g.y1) ** 2) AS gl FROM ya f JOIN yb g USING (candidate_id)) WHERE fl > 1e-9 AND gl > 1e-9)
      WHERE abs(fx * gy - fy * gx) / fl / gl <= 1e-7 AND abs(fx * oy - fy * ox) / fl <= 1e-7 AND least(fl, greatest(off, off + run)) - greatest(0, least(off, off + run)) > 1e-9),
    y3 AS (SELECT cand AS candidate_id, min(gap) AS v, arg_min(label, (gap, label)) FILTER (gap IS NOT NULL) AS label, bool_or(lined AND gap IS NULL) AS ambiguous, bool_or(drawn) AS drawn FROM (
        SELECT y2.candidate_id, any_value(cand) AS cand, any_value(label) AS label, count(ax) > 1 AND count(bx) > 1 AS drawn, any_value(gap) AS gap, y2.candidate_id IN (SELECT candidate_id FROM yl) AS lined FROM y2 LEFT JOIN yx USING (candidate_id) GROUP BY 1) GROUP BY 1),
    v1 AS MATERIALIZED (SELECT p5.*, y3.v AS path_v, y3.label AS path_label, ambiguous, drawn, seen, hit, CASE calc WHEN 'path_gap' THEN y3.v WHEN 'area_overlap' THEN CASE WHEN pointed AND sampled THEN held END WHEN 'area_entry_ttc' THEN CASE WHEN seen THEN hit END ELSE p5.v END AS value FROM p5 LEFT JOIN y3 USING (candidate_id) LEFT JOIN p6 USING (candidate_id)),
    v2 AS (SELECT *, CASE WHEN value IS NOT NULL THEN NULL WHEN calc LIKE 'area%' AND NOT pointed THEN 'required_context_missing' WHEN calc = 'event_ttc' AND NOT evented THEN 'required_context_missing' WHEN calc = 'path_gap' AND ambiguous THEN 'non_unique_path_conflict'
        WHEN calc = 'path_gap' AND drawn THEN 'no_unique_path_conflict' WHEN calc = 'area_entry_ttc' AND entry IS NULL THEN 'event_not_observed' WHEN calc = 'area_entry_ttc' AND seen THEN 'no_predicted_collision'
        WHEN calc IN ('headway', 'front_rear_ttc', 'event_ttc', 'point_ttc', 'radial_ttc', 'lateral_ttc') AND sampled THEN 'no_predicted_collision' ELSE 'insufficient_valid_samples' END AS reason FROM v1),
    ev AS (SELECT candidate_id, skill_id, metric, low, high, value, reason, CASE WHEN value IS NOT NULL THEN 'computed' WHEN reason IN ('no_predicted_collision', 'no_unique_path_conflict', 'event_not_observed') THEN 'no_event' ELSE 'unavailable' END AS status,
        CASE WHEN value IS NULL THEN NULL WHEN calc = 'path_gap' THEN path_label WHEN calc = 'area_overlap' THEN first_label WHEN calc LIKE 'area%' THEN NULL ELSE label END AS pair FROM v2)"""


def _longest(name: str, flag: str) -> str:
    return f"""{name} AS (SELECT candidate_id, max(b - a) * 0.1 AS v FROM (SELECT candidate_id, g, min(timestep) AS a, max(timestep) AS b FROM (
      SELECT candidate_id, timestep, timestep - row_number() OVER (PARTITION BY candidate_id ORDER BY timestep) AS g FROM r4 WHERE fut AND ({flag})) GROUP BY 1, 2) GROUP BY 1)"""


def _line_distance(name: str, points: str, keys: str) -> str:
    """Distance of (px, py) to each centre line."""
    return f"""{name} AS (SELECT {keys}, pid, min(sqrt((px - x1 - f * (x2 - x1)) ** 2 + (py - y1 - f * (y2 - y1)) ** 2)) AS d FROM (
      SELECT t.*, pid, x1, y1, x2, y2, CASE WHEN len > 1e-9 THEN least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len), 0), 1) ELSE 0 END AS f FROM {points} t, seg WHERE ptype = 'lane_centerline') GROUP BY {keys}, pid)"""


#: Conditions as a table: skill, condition, and whether the seed may show it.
def _needed() -> str:
    rows = ", ".join(f"('{s}', '{c}', {str(isinstance(e, tuple)).lower()})" for s, cs in ruled.CONDITIONS.items() for c, e in cs.items())
    return f"nd AS (SELECT * FROM (VALUES {rows}) AS t(skill_id, condition, shown))"


def conditions() -> str:
    """CTE ``tc``: candidate_id, skill_id, failed."""
    k = lambda name, default: f"coalesce(bounds['{name}'], {default})"
    return f"""{_needed()}, r4 AS (SELECT r3.*, expo, cut, stage, sqrt((a_x - b_x) ** 2 + (a_y - b_y) ** 2) AS dab, sqrt((a_x - px) ** 2 + (a_y - py) ** 2) AS pa, sqrt((b_x - px) ** 2 + (b_y - py) ** 2) AS pb, sqrt((c_x - px) ** 2 + (c_y - py) ** 2) AS pc,
        (a_y - oa_y) * cos(oa_heading) - (a_x - oa_x) * sin(oa_heading) AS own_a, (b_y - ob_y) * cos(ob_heading) - (b_x - ob_x) * sin(ob_heading) AS own_b, (b_x - a_x) * cos(oa_heading) + (b_y - a_y) * sin(oa_heading) AS front, (c_x - a_x) * cos(oa_heading) + (c_y - a_y) * sin(oa_heading) AS back,
        sqrt((b_x - c_x) ** 2 + (b_y - c_y) ** 2) AS bc, ((a_x - c_x) * (b_x - c_x) + (a_y - c_y) * (b_y - c_y)) AS onbc, ((b_x - c_x) * (a_y - c_y) - (b_y - c_y) * (a_x - c_x)) AS offbc,
        ((a_x - b_x) * (c_x - b_x) + (a_y - b_y) * (c_y - b_y)) / ((c_x - b_x) ** 2 + (c_y - b_y) ** 2) AS share FROM r3 JOIN e2 USING (candidate_id) WHERE r3.skill_id IN (SELECT skill_id FROM nd)),
    g0 AS (SELECT candidate_id, skill_id, any_value(bounds) AS bounds, min(timestep) FILTER (fut AND a_accel <= 0 - {k('peak_deceleration_mps2.low', 2)}) AS fa, min(timestep) FILTER (fut AND b_accel <= 0 - least(1, {k('peak_deceleration_mps2.low', 2)} / 2)) AS fb, min(timestep) FILTER (fut AND c_accel <= 0 - least(1, {k('peak_deceleration_mps2.low', 2)} / 2)) AS fc,
        min(a_accel) FILTER (fut) AS brake, any_value(expo) AS expo, any_value(cut) AS cut, any_value(stage) AS stage, max((c_x - b_x) * cos(b_heading) + (c_y - b_y) * sin(b_heading)) FILTER (timestep = expo) AS slow_gap, max(abs((a_y - b_y) * cos(b_heading) - (a_x - b_x) * sin(b_heading))) FILTER (timestep = expo) AS slow_side,
        max(sqrt(c_vx ** 2 + c_vy ** 2)) FILTER (timestep = expo) AS slow_speed, bool_or(fut AND abs(own_a) >= 1) AS moves_a, bool_or(fut AND abs(own_b) >= 1) AS moves_b, min(abs(front)) FILTER (fut) AS beside, max(abs(own_a)) FILTER (fut) AS aside,
        max((a_x - b_x) * cos(b_heading) + (a_y - b_y) * sin(b_heading)) FILTER (NOT fut) AS block_gap, max(sqrt(a_vx ** 2 + a_vy ** 2)) FILTER (NOT fut) AS block_speed, max(dab) FILTER (NOT fut) AS dab0, min(dab) FILTER (fut) AS dab1,
        max(pa) FILTER (NOT fut) AS pa0, max(pb) FILTER (NOT fut) AS pb0, min(pa) FILTER (fut) AS pa1, min(pb) FILTER (fut) AS pb1, arg_min(time_s, pa) FILTER (fut AND pa IS NOT NULL) AS ta, arg_min(time_s, pb) FILTER (fut AND pb IS NOT NULL) AS tb, arg_min(time_s, pc) FILTER (fut AND pc IS NOT NULL) AS tc_, min(time_s) AS t0, max(time_s) AS t9,
        median(a_speed) FILTER (fut) AS mid_speed, count(*) FILTER (fut AND ina) AS inside_n, count(px) AS points_n, min(time_s) FILTER (fut AND pa <= 2) AS ea, min(time_s) FILTER (fut AND pb <= 2) AS eb, min(time_s) FILTER (fut AND ina AND NOT was_in) AS enter,
        max(a_speed) FILTER (fut) AS top, bool_or(fut AND bc > 1e-9 AND onbc / bc BETWEEN 0 AND bc AND abs(offbc / bc) <= {k('maximum_lateral_reentry_distance_m', 5)}) AS in_flow,
        max(degrees(abs((a_heading - oa_heading) - 2 * pi() * floor((a_heading - oa_heading + pi()) / (2 * pi()))))) FILTER (fut) AS turned, min(front) FILTER (fut AND front > 0) AS front_gap, min(0 - back) FILTER (fut AND back < 0) AS rear_gap,
        max(front) FILTER (NOT fut) AS front0, max(0 - back) FILTER (NOT fut) AS back0, min(front) FILTER (fut) AS front1, min(0 - back) FILTER (fut) AS back1,
        bool_or(fut AND bc > 1e-9 AND share BETWEEN 0 AND 1 AND sqrt((a_x - b_x - share * (c_x - b_x)) ** 2 + (a_y - b_y - share * (c_y - b_y)) ** 2) <= {k('maximum_motorcyclist_vehicle_distance_m', 7)}) AS amid,
        avg(a_speed) FILTER (fut) AS va, avg(b_speed) FILTER (fut) AS vb, avg(c_speed) FILTER (fut) AS vc FROM r4 GROUP BY 1, 2),
    {_longest('l1', f"skill_id = 'intersection_creep_conflict' AND a_speed >= {k('creep_speed_mps.low', 0.3)} AND a_speed <= {k('maximum_creep_speed_mps', 2)}")}, {_longest('l2', f"skill_id = 'intersection_blocking_vehicle' AND a_speed <= {k('maximum_blocker_speed_mps', 0.5)} AND ina")},
    {_longest('l3', f"skill_id = 'mutual_yield_deadlock' AND a_speed <= {k('maximum_creep_speed_mps', 3)}")}, {_longest('l4', f"skill_id = 'mutual_yield_deadlock' AND b_speed <= {k('maximum_creep_speed_mps', 3)}")},
    l5 AS (SELECT candidate_id, max(sv) AS v FROM an JOIN rt ON rt.scenario_id = an.scenario_id AND rt.track_id = t0 WHERE timestep BETWEEN 24 AND 34 GROUP BY 1),
    fx AS (SELECT an.candidate_id, an.candidate_index, sd.*  EXCLUDE (candidate_id), x.object_type AS type_a, x.heading AS ha, y.heading AS hb, x.vx AS vxa, x.vy AS vya, y.vx AS vxb, y.vy AS vyb, y.speed AS speed_b, x.diverges AS div_a, x.succ AS succ_a, y.succ AS succ_b, y.left_id AS left_b, y.right_id AS right_b, x.in_cross AS cross_a
      FROM an JOIN sd USING (candidate_id) LEFT JOIN al x ON x.scenario_id = an.scenario_id AND x.track_id = t0 LEFT JOIN al y ON y.scenario_id = an.scenario_id AND y.track_id = t1),
    sh0 AS (SELECT candidate_id, lb, role, px, py FROM (SELECT candidate_id, 'a' AS role, a_x AS px, a_y AS py FROM r4 WHERE fut AND skill_id = 'simultaneous_lane_change_conflict' UNION ALL SELECT candidate_id, 'b', b_x, b_y FROM r4 WHERE fut AND skill_id = 'simultaneous_lane_change_conflict') JOIN sd USING (candidate_id) WHERE px IS NOT NULL AND lb IS NOT NULL),
    {_line_distance('sh1', 'sh0', 'candidate_id, lb, role')}, sh AS (SELECT candidate_id, coalesce(min(d) FILTER (role = 'a') <= 2.5 AND min(d) FILTER (role = 'b') <= 2.5, false) AS lane_shared FROM sh1 WHERE pid = lb GROUP BY 1),
    re0 AS (SELECT candidate_id, timestep, b_x AS px, b_y AS py FROM r4 WHERE skill_id = 'forced_lane_change_around_blockage' AND b_x IS NOT NULL), {_line_distance('re1', 're0', 'candidate_id, timestep')},
    re2 AS (SELECT candidate_id, timestep, arg_min(pid, (d, pid)) AS lane FROM re1 GROUP BY 1, 2), re3 AS (SELECT *, lag(lane) OVER (PARTITION BY candidate_id ORDER BY timestep) AS prev FROM re2),
    re AS (SELECT candidate_id, min(timestep) FILTER (prev <> re3.lane AND (re3.lane = l.left_id OR re3.lane = l.right_id)) AS change, max(re3.lane) FILTER (timestep = 34) AS start FROM re3 LEFT JOIN lane0 l ON l.pid = prev GROUP BY 1),
    ps1 AS (SELECT candidate_id, min(timestep) FILTER (fut AND (a_x - b_x) * cos(ob_heading) + (a_y - b_y) * sin(ob_heading) <= 0) AS pass FROM r4 GROUP BY 1),
    vd AS (SELECT g0.candidate_id, g0.skill_id, candidate_index, CASE g0.skill_id
      WHEN 'chain_braking' THEN {{'three_vehicle_queue': la = lb AND lb = lc, 'leader_decelerating': brake <= 0 - {k('peak_deceleration_mps2.low', 2)}, 'delayed_braking_response': fa < fb AND fb < fc AND (fb - fa) * 0.1 >= {k('propagation_delay_s.low', 0.2)} - 1e-9 AND (fc - fb) * 0.1 >= {k('propagation_delay_s.low', 0.2)} - 1e-9}}::JSON
      WHEN 'cut_out_reveals_slow_vehicle' THEN {{'three_vehicle_queue': la = lb AND lb = lc, 'lead_vehicle_cuts_out': expo IS NOT NULL, 'newly_exposed_slow_vehicle': slow_gap > 0 AND slow_side >= 1 AND slow_speed <= {k('maximum_slow_vehicle_speed_mps', 2)}}}::JSON
      WHEN 'simultaneous_lane_change_conflict' THEN {{'shared_target_lane': lane_shared, 'overlapping_lane_change_window': moves_a AND moves_b, 'close_longitudinal_position': beside <= {k('maximum_longitudinal_gap_m', 12)}}}::JSON
      WHEN 'forced_lane_change_around_blockage' THEN {{'blockage_ahead': la = lb AND block_gap > 0 AND block_gap <= {k('maximum_blockage_distance_m', 35)} AND block_speed <= {k('maximum_blocker_speed_mps', 0.5)},
        'adjacent_lane_available': (left_b IS NOT NULL OR right_b IS NOT NULL) AND start = lb AND change IS NOT NULL AND (pass IS NULL OR change <= pass), 'approach_to_safety_buffer': dab0 - dab1 >= 0.5 AND dab1 <= bounds['risk_high']}}::JSON
      WHEN 'late_lane_change_before_diverge' THEN {{'diverging_topology': div_a, 'late_lateral_crossing': aside >= {k('minimum_lateral_displacement_m', 1)}, 'conflicting_vehicle_present': nb.d <= coalesce(bounds['maximum_target_gap_m'], bounds['maximum_competing_vehicle_gap_m'], 20)}}::JSON
      WHEN 'diverge_lane_crossing_conflict' THEN {{'diverging_topology': div_a, 'late_lateral_crossing': aside >= {k('minimum_lateral_displacement_m', 1)}, 'conflicting_vehicle_present': nb.d <= coalesce(bounds['maximum_target_gap_m'], bounds['maximum_competing_vehicle_gap_m'], 20)}}::JSON
      WHEN 'lane_drop_merge_competition' THEN {{'lane_successors_converge': la <> lb AND list_has_any(succ_a, succ_b), 'competing_arrival': pa1 <= 6 AND pb1 <= 6 AND abs(ta - tb) <= bounds['risk_high'], 'insufficient_gap': pa1 <= 6 AND pb1 <= 6 AND abs(ta - tb) <= bounds['risk_high']}}::JSON
      WHEN 'merge_without_yield' THEN {{'converging_lanes': la <> lb AND list_has_any(succ_a, succ_b), 'explicit_priority_role': la <> lb, 'yielding_actor_continues': pa0 - pa1 >= 0.5 AND mid_speed >= 0.5}}::JSON
      WHEN 'zipper_merge_multi_vehicle' THEN {{'converging_lanes': seed_x IS NOT NULL, 'competing_vehicles_present': speed_b >= 1, 'delayed_entry': pa1 <= 6 AND ta - t0 >= 0.5 - 1e-9 AND least(abs(ta - tb), abs(ta - tc_)) <= {k('maximum_arrival_time_gap_s', 5)}}}::JSON
      WHEN 'intersection_creep_conflict' THEN {{'near_intersection_entry': cross_a OR seed_x IS NOT NULL, 'sustained_creep_speed': l1.v >= 0.5 - 1e-9, 'crossing_vehicle_present': abs(vxa * vyb - vya * vxb) > 1e-9 OR speed_b >= 1}}::JSON
      WHEN 'intersection_blocking_vehicle' THEN {{'inside_conflict_area': inside_n > 0, 'sustained_low_speed_or_stop': l2.v >= {k('hold_duration_s.low', 1)} - 1e-9, 'crossing_flow_approaches': pb0 - pb1 >= 0.5}}::JSON
      WHEN 'mutual_yield_deadlock' THEN {{'shared_conflict_point': seed_x IS NOT NULL OR abs(vxa * vyb - vya * vxb) > 1e-9, 'sustained_low_speed_or_stop': l3.v >= 1 - 1e-9 AND l4.v >= 1 - 1e-9, 'delayed_entry': points_n > 0 AND (ea IS NULL OR ea - t0 >= 1 - 1e-9) AND (eb IS NULL OR eb - t0 >= 1 - 1e-9)}}::JSON
      WHEN 'roadside_pedestrian_emergence' THEN {{'pedestrian_near_drivable_boundary': type_a = 'pedestrian', 'delayed_entry': enter - t0 >= {k('emergence_start_s.low', 1)} - 1e-9, 'vehicle_approaching': pb0 - pb1 >= 0.5 AND pb1 <= {k('maximum_conflict_distance_m', 6)}}}::JSON
      WHEN 'stopped_vehicle_reentry' THEN {{'previously_stopped': l5.v <= {k('stopped_speed_mps', 0.5)}, 'begins_moving': top >= {k('minimum_moving_speed_mps', 1)}, 'enters_main_flow': in_flow}}::JSON
      WHEN 'construction_object_lane_blockage' THEN {{'construction_actor_near_path': type_a IN ('static', 'construction'), 'vehicle_approaching': dab0 - dab1 >= 0.5, 'safety_buffer_violation_predicted': nb.d <= bounds['risk_high']}}::JSON
      WHEN 'static_object_avoidance' THEN {{'static_actor_near_path': type_a IN ('static', 'construction'), 'predicted_buffer_intrusion': nb.d <= bounds['risk_high'], 'response_space_available': left_b IS NOT NULL OR right_b IS NOT NULL}}::JSON
      WHEN 'cut_in_then_brake' THEN {{'adjacent_vehicle_cuts_in': cut IS NOT NULL, 'initiator_brakes': stage IS NOT NULL, 'short_post_cut_in_delay': (stage - cut) * 0.1 BETWEEN {k('brake_delay_after_cut_in_s.low', 0.2)} - 1e-9 AND {k('brake_delay_after_cut_in_s.high', 1.5)} + 1e-9}}::JSON
      WHEN 'abrupt_u_turn_conflict' THEN {{'turning_vehicle': turned >= {k('minimum_opposing_heading_difference_deg', 120)}, 'oncoming_vehicle_present': ha IS NOT NULL AND hb IS NOT NULL, 'vehicle_path_conflict': made.gap IS NOT NULL OR coalesce(nb.d <= 6, false)}}::JSON
      WHEN 'multi_vehicle_gap_squeeze' THEN {{'front_gap_small': front_gap <= {k('maximum_front_gap_m', 25)}, 'rear_gap_small': rear_gap <= {k('maximum_rear_gap_m', 25)}, 'multi_direction_gap_closing': front1 < front0 AND back1 < back0 AND (front0 - front1 + back0 - back1) / (t9 - t0) >= {k('minimum_combined_closing_speed_mps', 0.5)} - 1e-9}}::JSON
      WHEN 'motorcyclist_filtering_conflict' THEN {{'motorcyclist_between_vehicles': amid, 'positive_relative_speed': va - (vb + vc) / 2 > 0, 'safety_buffer_violation_predicted': least(nb.d, nc.d) <= bounds['risk_high']}}::JSON END AS held
      FROM g0 JOIN fx USING (candidate_id) LEFT JOIN nb USING (candidate_id) LEFT JOIN nc USING (candidate_id) LEFT JOIN made USING (candidate_id) LEFT JOIN l1 USING (candidate_id) LEFT JOIN l2 USING (candidate_id) LEFT JOIN l3 USING (candidate_id) LEFT JOIN l4 USING (candidate_id) LEFT JOIN l5 USING (candidate_id)
      LEFT JOIN sh USING (candidate_id) LEFT JOIN re USING (candidate_id) LEFT JOIN ps1 USING (candidate_id)),
    tc AS (SELECT candidate_id, vd.skill_id, coalesce(string_agg(condition, ',' ORDER BY condition) FILTER ((candidate_index % 2 = 0 OR NOT shown) AND NOT coalesce(CAST(json_extract(held, '$.' || condition) AS BOOLEAN), false)), '') AS failed FROM vd JOIN nd ON nd.skill_id = vd.skill_id GROUP BY 1, 2)"""
