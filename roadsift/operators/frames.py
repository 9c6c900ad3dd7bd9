"""Coordinate frames: global and agent-local points, anchors, headings filled from motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm

SPEC = "(PARTITION BY scenario_id, track_id ORDER BY timestep)"
MOVED = "timestep - lag(timestep) OVER w = 1"


def local_point(x: str, y: str, ox: str, oy: str, h: str) -> tuple[str, str]:
    dx, dy = f"({x} - {ox})", f"({y} - {oy})"
    return fm.forward(dx, dy, h), fm.left(dx, dy, h)


def global_point(lx: str, ly: str, ox: str, oy: str, h: str) -> tuple[str, str]:
    return f"({ox} + {lx} * cos({h}) - {ly} * sin({h}))", f"({oy} + {lx} * sin({h}) + {ly} * cos({h}))"


def fill_headings(states: DataFrame, history: int | None = None) -> DataFrame:
    """Missing headings from the displacement, else the velocity direction; only inside the history when given."""
    moved = f"{MOVED} AND {fm.norm('x - lag(x) OVER w', 'y - lag(y) OVER w')} > 1e-6"
    step = f"CASE WHEN {moved} THEN atan2(y - lag(y) OVER w, x - lag(x) OVER w) END".replace("OVER w", f"OVER {SPEC}")
    speed = f"CASE WHEN {fm.norm('vx', 'vy')} > 1e-6 THEN atan2(vy, vx) END"
    value = f"coalesce(heading, {step}, {speed})"
    return states.selectExpr("*", f"{value if history is None else f'CASE WHEN timestep < {history} THEN {value} ELSE heading END'} AS filled")


def anchors(states: DataFrame, frame: int) -> DataFrame:
    """Origin and heading of every track at a frame: heading, else velocity, else last displacement."""
    moved = f"{MOVED} AND {fm.norm('x - lag(x) OVER w', 'y - lag(y) OVER w')} > 1e-6"
    step = f"CASE WHEN {moved} THEN atan2(y - lag(y) OVER w, x - lag(x) OVER w) END".replace("OVER w", f"OVER {SPEC}")
    speed = f"CASE WHEN {fm.norm('vx', 'vy')} > 1e-6 THEN atan2(vy, vx) END"
    s = states.where(f"timestep BETWEEN {frame - 1} AND {frame}").selectExpr("*", f"coalesce(heading, {speed}, {step}) AS anchor_heading")
    return s.where(f"timestep = {frame} AND observed AND x IS NOT NULL AND y IS NOT NULL AND anchor_heading IS NOT NULL").selectExpr(
        "scenario_id", "track_id", "x AS ox", "y AS oy", "anchor_heading AS oh")


def to_frame(states: DataFrame, origin: DataFrame, keys: list[str]) -> DataFrame:
    """States in the frame of the joined origin (ox, oy, oh); velocities rotate without translation."""
    lx, ly = local_point("x", "y", "ox", "oy", "oh")
    return states.join(origin, keys).selectExpr(
        *[c for c in states.columns if c not in ("x", "y", "vx", "vy", "heading")], f"{lx} AS x", f"{ly} AS y",
        f"{fm.forward('vx', 'vy', 'oh')} AS vx", f"{fm.left('vx', 'vy', 'oh')} AS vy", f"{fm.wrap('heading - oh')} AS heading")


def polylines_to_frame(polylines: DataFrame, origin: DataFrame) -> DataFrame:
    lx, ly = local_point("p.x", "p.y", "ox", "oy", "oh")
    return polylines.join(origin, "scenario_id").withColumn("points", F.expr(f"transform(points, p -> struct({lx} AS x, {ly} AS y))")).drop("ox", "oy", "oh")


def focal_origin(states: DataFrame, focal: DataFrame) -> DataFrame:
    """Last valid observation of each scenario's focal track as the scenario origin."""
    s = states.join(focal.select("scenario_id", F.col("focal_track_id").alias("track_id")), ["scenario_id", "track_id"])
    best = s.where("observed AND x IS NOT NULL AND y IS NOT NULL AND heading IS NOT NULL").groupBy("scenario_id").agg(
        F.max_by(F.struct("x", "y", "heading"), "timestep").alias("r"))
    return best.selectExpr("scenario_id", "r.x AS ox", "r.y AS oy", "r.heading AS oh")


def resolve_targets(states: DataFrame, frame: int, minimum: int) -> DataFrame:
    """Anchor of every track with a reason code when it cannot serve as a target."""
    f = fill_headings(states.where(f"timestep <= {frame}"), frame + 1)
    ok = "observed AND x IS NOT NULL AND y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND filled IS NOT NULL"
    g = f.groupBy("scenario_id", "track_id").agg(
        F.expr(f"coalesce(bool_or(timestep = {frame} AND observed), false)").alias("seen"),
        F.expr(f"max(filled) FILTER (WHERE timestep = {frame})").alias("oh"),
        F.expr(f"max(x) FILTER (WHERE timestep = {frame})").alias("ox"), F.expr(f"max(y) FILTER (WHERE timestep = {frame})").alias("oy"),
        F.expr(f"coalesce(bool_or(timestep = {frame} AND {ok}), false)").alias("anchored"), F.expr(f"count_if({ok})").alias("valid_steps"))
    return g.withColumn("reason", F.expr(
        "CASE WHEN NOT seen THEN 'target_not_observed' WHEN ox IS NULL OR oy IS NULL THEN 'target_position_missing' "
        f"WHEN oh IS NULL THEN 'heading_unresolved' WHEN valid_steps < {minimum} THEN 'history_too_short' WHEN NOT anchored THEN 'anchor_velocity_missing' END"))


def future_kinematics(frames: DataFrame, key: str, minimum_speed: str = "0.5") -> DataFrame:
    """Exact-delta kinematics of future frames including the seam to the anchor.

    ``frames`` holds per key the two history frames (stored velocity vx, vy) and the future
    frames flagged ``is_future`` with positions only.  The heading is carried at low speed; a rate
    is taken only if this and the previous frame move, against the last accepted heading.
    """
    w = f"OVER (PARTITION BY {key} ORDER BY timestep)"
    one = frames.selectExpr("*", f"(time_s - lag(time_s) {w}) AS dt",
                            f"CASE WHEN is_future THEN (x - lag(x) {w}) / (time_s - lag(time_s) {w}) ELSE vx END AS ux",
                            f"CASE WHEN is_future THEN (y - lag(y) {w}) / (time_s - lag(time_s) {w}) ELSE vy END AS uy")
    two = one.selectExpr("*", f"(ux - lag(ux) {w}) / dt AS ax", f"(uy - lag(uy) {w}) / dt AS ay", f"{fm.norm('ux', 'uy')} AS speed")
    three = two.selectExpr("*", f"(ax - lag(ax) {w}) / dt AS jx", f"(ay - lag(ay) {w}) / dt AS jy", f"(speed - lag(speed) {w}) / dt AS tangential",
                           f"speed >= {minimum_speed} AS moving", f"lag(speed) {w} AS last_speed",
                           f"CASE WHEN is_future AND speed >= {minimum_speed} THEN atan2(uy, ux) WHEN NOT is_future THEN "
                           f"coalesce(heading, CASE WHEN speed > 0 THEN atan2(uy, ux) END) END AS direction")
    four = three.selectExpr("*", f"last(direction, true) {w} AS carried",
                            f"last(direction, true) OVER (PARTITION BY {key} ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    turn = f"abs({fm.wrap('direction - before')}) / dt"
    five = four.where("is_future").selectExpr("*", f"CASE WHEN moving AND before IS NOT NULL AND last_speed >= {minimum_speed} THEN {turn} ELSE CAST(0 AS DOUBLE) END AS heading_rate")
    return five.selectExpr(
        key, "timestep", "ux AS vx", "uy AS vy", "speed", "tangential", "greatest(0 - tangential, CAST(0 AS DOUBLE)) AS deceleration",
        f"{fm.norm('ax', 'ay')} AS acceleration", f"{fm.norm('jx', 'jy')} AS jerk", "carried AS heading", "heading_rate",
        "CASE WHEN heading_rate > 0 THEN heading_rate / ((last_speed + speed) / 2) ELSE CAST(0 AS DOUBLE) END AS curvature")
