"""Post-overlay conditions as aggregates over a candidate's wide frame rows.

Each entry holds the aggregate expressions and the verdict over them.  Roles: a is the overlay
target, b and c the recorded others; ``o`` marks the anchor frame; (px, py) is the conflict point.
The text uses only aggregates common to SQL engines; ``MEDIAN(x)`` stands for the exact median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.funnel import risk as rk
from roadsift.operators import tracks as tr

# Lateral event, minimum progress, reach radius, half square (m).
LATERAL, PROGRESS, REACH, HALF = 1.0, 0.5, 6.0, 2.0
FUTURE = "timestep > {anchor}"

own = lambda r: fm.left(f"{r}_x - o{r}_x", f"{r}_y - o{r}_y", f"o{r}_heading")
rel_lat = fm.left("(a_x - b_x) - (oa_x - ob_x)", "(a_y - b_y) - (oa_y - ob_y)", "ob_heading")
now_lat = fm.left("a_x - b_x", "a_y - b_y", "ob_heading")
now_lon = fm.forward("a_x - b_x", "a_y - b_y", "ob_heading")
start_lat = f"abs({fm.left('oa_x - ob_x', 'oa_y - ob_y', 'ob_heading')})"
dist = lambda p, q: fm.norm(f"{p}_x - {q}_x", f"{p}_y - {q}_y")
to_point = lambda r: fm.norm(f"{r}_x - px", f"{r}_y - py")
start_dist = dist("oa", "ob")
squeeze = lambda r: fm.forward(f"{r}_x - a_x", f"{r}_y - a_y", "oa_heading")
start_squeeze = lambda r: fm.forward(f"o{r}_x - oa_x", f"o{r}_y - oa_y", "oa_heading")
main_len = dist("b", "c")
main_pos = f"(((a_x - c_x) * (b_x - c_x) + (a_y - c_y) * (b_y - c_y)) / {main_len})"
main_side = f"abs(((b_x - c_x) * (a_y - c_y) - (b_y - c_y) * (a_x - c_x)) / {main_len})"
between = "(((a_x - b_x) * (c_x - b_x) + (a_y - b_y) * (c_y - b_y)) / ((c_x - b_x) * (c_x - b_x) + (c_y - b_y) * (c_y - b_y)))"
beside = fm.norm(f"a_x - (b_x + {fm.clamp01(between)} * (c_x - b_x))", f"a_y - (b_y + {fm.clamp01(between)} * (c_y - b_y))")
first = lambda cond: f"min(timestep) FILTER (WHERE fut AND {cond})"
low = lambda e: f"min({e}) FILTER (WHERE fut)"
high = lambda e: f"max({e}) FILTER (WHERE fut)"
crosses = f"({rk.inside_square('a')} AND NOT last_inside)"
cut_in = f"{start_lat} >= {LATERAL} AND abs({now_lat}) <= greatest(0.75, 0.35 * {start_lat}) AND {now_lon} > 0"

CONDITIONS: dict[str, tuple[dict[str, str], str]] = {
    "leader_decelerating": ({"v": low("a_accel")}, "v <= -2.0"),
    "delayed_braking_response": ({"fa": first("a_accel <= -2.0"), "fb": first("b_accel <= -1.0"), "fc": first("c_accel <= -1.0")},
                                 "fa < fb AND fb < fc AND (fb - fa) * 0.1 >= 0.2 - 1e-9 AND (fc - fb) * 0.1 >= 0.2 - 1e-9"),
    "lead_vehicle_cuts_out": ({"f": first(f"abs({rel_lat}) >= {LATERAL}")}, "f IS NOT NULL"),
    "newly_exposed_slow_vehicle": (
        {"g": f"min_by({rk.gap('c', 'b')}, timestep) FILTER (WHERE fut AND abs({rel_lat}) >= {LATERAL})",
         "l": f"min_by(abs({fm.left('a_x - b_x', 'a_y - b_y', 'b_heading')}), timestep) FILTER (WHERE fut AND abs({rel_lat}) >= {LATERAL})",
         "s": f"min_by({fm.norm('c_vx', 'c_vy')}, timestep) FILTER (WHERE fut AND abs({rel_lat}) >= {LATERAL})"}, f"g > 0 AND l >= {LATERAL} AND s <= 2.0"),
    "overlapping_lane_change_window": ({"fa": first(f"abs({own('a')}) >= {LATERAL}"), "fb": first(f"abs({own('b')}) >= {LATERAL}")}, "fa IS NOT NULL AND fb IS NOT NULL"),
    "close_longitudinal_position": ({"v": low(f"abs({fm.forward('b_x - a_x', 'b_y - a_y', 'oa_heading')})")}, "v <= 12.0"),
    "blockage_ahead": ({"g": f"max({fm.forward('a_x - b_x', 'a_y - b_y', 'b_heading')}) FILTER (WHERE NOT fut)", "s": f"max({fm.norm('a_vx', 'a_vy')}) FILTER (WHERE NOT fut)"},
                       "g > 0 AND g <= 35.0 AND s <= 0.5"),
    "approach_to_safety_buffer": ({"o": f"max({start_dist})", "v": low(dist("a", "b"))}, f"o - v >= {PROGRESS} AND v <= 6.0"),
    "late_lateral_crossing": ({"v": high(f"abs({own('a')})")}, "v >= 0.25"),
    "competing_arrival": ({"ta": f"min_by(time_s, {to_point('a')}) FILTER (WHERE fut)", "tb": f"min_by(time_s, {to_point('b')}) FILTER (WHERE fut)", "da": low(to_point("a")), "db": low(to_point("b"))},
                          f"da <= {REACH} AND db <= {REACH} AND abs(ta - tb) <= 3.0"),
    "yielding_actor_continues": ({"o": f"max({to_point('a')}) FILTER (WHERE NOT fut)", "v": low(to_point("a")), "s": "MEDIAN(CASE WHEN fut THEN a_speed END)"}, f"o - v >= {PROGRESS} AND s >= 0.5"),
    "delayed_merge_entry": ({"ta": f"min_by(time_s, {to_point('a')}) FILTER (WHERE fut)", "tb": f"min_by(time_s, {to_point('b')}) FILTER (WHERE fut)", "tc": f"min_by(time_s, {to_point('c')}) FILTER (WHERE fut)",
                             "da": low(to_point("a")), "t0": "min(time_s)"}, f"da <= {REACH} AND ta - t0 >= 0.5 - 1e-9 AND least(abs(ta - tb), abs(ta - tc)) <= 5.0"),
    "inside_conflict_area": ({"n": f"count(*) FILTER (WHERE fut AND {rk.inside_square('a')})"}, "n > 0"),
    "crossing_flow_approaches": ({"o": f"max({to_point('b')}) FILTER (WHERE NOT fut)", "v": low(to_point("b"))}, f"o - v >= {PROGRESS}"),
    "delayed_conflict_entry": ({"ea": f"min(time_s) FILTER (WHERE fut AND {to_point('a')} <= {HALF})", "eb": f"min(time_s) FILTER (WHERE fut AND {to_point('b')} <= {HALF})", "t0": "min(time_s)"},
                               "(ea IS NULL OR ea - t0 >= 1.0 - 1e-9) AND (eb IS NULL OR eb - t0 >= 1.0 - 1e-9)"),
    "delayed_pedestrian_entry": ({"e": f"min(time_s) FILTER (WHERE fut AND {crosses})", "t0": "min(time_s)"}, "e - t0 >= 1.0 - 1e-9"),
    "vehicle_approaches_conflict": ({"o": f"max({to_point('b')}) FILTER (WHERE NOT fut)", "v": low(to_point("b"))}, f"o - v >= {PROGRESS} AND v <= {REACH}"),
    "begins_moving": ({"v": high("a_speed")}, "v >= 1.0"),
    "enters_main_flow": ({"f": first(f"{main_len} > 1e-9 AND {main_pos} BETWEEN 0 AND {main_len} AND {main_side} <= 5.0")}, "f IS NOT NULL"),
    "vehicle_approaching": ({"o": f"max({start_dist})", "v": low(dist("a", "b"))}, f"o - v >= {PROGRESS}"),
    "adjacent_vehicle_cuts_in": ({"f": first(cut_in)}, "f IS NOT NULL"),
    "turning_vehicle": ({"v": high(f"degrees({fm.heading_gap('a_heading', 'oa_heading')})")}, "v >= 120.0"),
    "front_gap_small": ({"v": f"min({squeeze('b')}) FILTER (WHERE fut AND {squeeze('b')} > 0)"}, "v <= 25.0"),
    "rear_gap_small": ({"v": f"min(0 - {squeeze('c')}) FILTER (WHERE fut AND {squeeze('c')} < 0)"}, "v <= 25.0"),
    "multi_direction_gap_closing": ({"f0": f"max({start_squeeze('b')})", "r0": f"max(0 - {start_squeeze('c')})", "f": low(squeeze("b")), "r": low(f"0 - {squeeze('c')}"), "h": "max(time_s) - min(time_s)"},
                                    "f < f0 AND r < r0 AND (f0 - f + r0 - r) / h >= 0.5"),
    "motorcyclist_between_vehicles": ({"f": first(f"{dist('b', 'c')} > 1e-9 AND {between} BETWEEN 0 AND 1 AND {beside} <= 7.0")}, "f IS NOT NULL"),
    "positive_relative_speed": ({"m": "avg(CASE WHEN fut THEN a_speed END)", "p": "avg(CASE WHEN fut THEN b_speed END)", "q": "avg(CASE WHEN fut THEN c_speed END)"}, "m - (p + q) / 2 > 0"),
}
EVENTS = {"initiator_brakes": "brake IS NOT NULL", "short_post_cut_in_delay": "(brake - cut) * 0.1 BETWEEN 0.2 - 1e-9 AND 1.5 + 1e-9"}


def prepare(rows: DataFrame, anchor: int) -> DataFrame:
    """Flag future frames and remember whether the previous frame was inside the conflict square."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    return rows.withColumn("fut", F.expr(f"timestep > {anchor}")).withColumn("last_inside", F.expr(f"coalesce(lag({rk.inside_square('a')}) {w}, false)"))


def evaluate(rows: DataFrame, names: list[str]) -> DataFrame:
    """Verdicts of the named conditions in one aggregation."""
    aggs, verdicts = [], []
    for i, n in enumerate(names):
        parts, verdict = CONDITIONS[n]
        for k in sorted(parts, key=len, reverse=True):
            aggs.append(F.expr(parts[k].replace("MEDIAN(", "median(")).alias(f"c{i}_{k}"))
        verdicts.append(f"coalesce({_prefixed(verdict, parts, f'c{i}_')}, false) AS {n}")
    return rows.groupBy("candidate_id").agg(*aggs).selectExpr("candidate_id", *verdicts)


def _prefixed(text: str, names, prefix: str) -> str:
    import re
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", lambda m: prefix + m.group(1), text)


def brake_after_cut_in(rows: DataFrame) -> DataFrame:
    """Frame of the completed cut-in and of the first braking from then on."""
    cut = F.min(F.expr(f"CASE WHEN fut AND {cut_in} THEN timestep END")).over(Window.partitionBy("candidate_id"))
    return rows.withColumn("cut", cut).groupBy("candidate_id").agg(F.max("cut").alias("cut"), F.expr("min(timestep) FILTER (WHERE fut AND timestep >= cut AND a_accel <= -2.0)").alias("brake"))


def sustained(rows: DataFrame, flag: str, seconds: float) -> DataFrame:
    """Longest future run (last minus first time) in which the flag holds."""
    runs = tr.longest_run(rows.where("fut"), ["candidate_id"], flag)
    ids = rows.select("candidate_id").distinct().join(runs, "candidate_id", "left")
    return ids.selectExpr("candidate_id", "coalesce(span, 0) * 0.1D AS longest_s", f"coalesce(span, 0) * 0.1D >= {seconds} - 1e-9 AS passed")


def conflict_context(wide: DataFrame, anchor: int, seed_points: DataFrame | None = None) -> DataFrame:
    """Conflict point per candidate: frozen seed point, else the crossing of the generated paths, else the middle of
    the closest approach if that is within the reach radius; rows gain px, py (NULL when there is none)."""
    crossing = rk.path_gap(wide, [("a", "b")]).selectExpr("candidate_id", "cx", "cy")
    d = dist("a", "b")
    close = wide.groupBy("candidate_id").agg(F.expr(f"min(struct({d} AS d, timestep, (a_x + b_x) / 2 AS mx, (a_y + b_y) / 2 AS my)) FILTER (WHERE {d} IS NOT NULL)").alias("m"))
    p = crossing.join(close, "candidate_id")
    seed = "CAST(NULL AS DOUBLE)"
    if seed_points is not None:
        p = p.join(seed_points.selectExpr("candidate_id", "cx AS seed_x", "cy AS seed_y"), "candidate_id", "left")
    point = lambda c: f"coalesce({f'seed_{c}' if seed_points is not None else seed}, c{c}, CASE WHEN m.d <= {REACH} THEN m.m{c} END) AS p{c}"
    return wide.join(p.selectExpr("candidate_id", point("x"), point("y")), "candidate_id")
