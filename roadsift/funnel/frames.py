"""Candidate futures laid over recorded role tracks: one wide row per candidate and frame.

Only the role tracks of a candidate are joined, never whole scenarios.  Every risk metric,
condition and limit is then an aggregate over these rows, so one shuffle by candidate serves
them all; a candidate has at most 61 evaluated frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm

ROLES = ("a", "b", "c")
STATE = ("x", "y", "vx", "vy", "heading")


def overlay(candidates: DataFrame, states: DataFrame, anchor: int) -> DataFrame:
    """Target frames with the candidate future: velocity from exact deltas, heading carried at standstill.

    ``candidates``: candidate_id, scenario_id, a (target), timestep, x, y.  Frames before and at the anchor
    come from the record.
    """
    ids = candidates.groupBy("candidate_id").agg(F.first("scenario_id").alias("scenario_id"), F.first("a").alias("track_id"), F.max("timestep").alias("last_t"))
    past = ids.join(states.where(f"timestep BETWEEN {anchor - 1} AND {anchor}"), ["scenario_id", "track_id"]).select("candidate_id", "timestep", "time_s", *STATE)
    clock = states.select("scenario_id", F.col("track_id").alias("a"), "timestep", "time_s")
    future = candidates.join(clock, ["scenario_id", "a", "timestep"], "left").withColumn("time_s", F.expr("coalesce(time_s, timestep * 0.1D)"))
    none = F.lit(None).cast("double")
    rows = past.unionByName(future.select("candidate_id", "timestep", "time_s", "x", "y", none.alias("vx"), none.alias("vy"), none.alias("heading")))
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    dt = f"(time_s - lag(time_s) {w})"
    rows = rows.selectExpr("*", f"timestep > {anchor} AS is_future", f"IF(timestep > {anchor}, (x - lag(x) {w}) / {dt}, vx) AS ux", f"IF(timestep > {anchor}, (y - lag(y) {w}) / {dt}, vy) AS uy")
    turn = f"IF(is_future, CASE WHEN {fm.norm('ux', 'uy')} > 1e-6 THEN atan2(uy, ux) END, coalesce(heading, CASE WHEN {fm.norm('ux', 'uy')} > 1e-6 THEN atan2(uy, ux) END))"
    rows = rows.withColumn("turn", F.expr(turn))
    return rows.selectExpr("candidate_id", "timestep", "time_s", "is_future", "x", "y", "ux AS vx", "uy AS vy", f"last(turn, true) {w} AS heading")


def wide_frames(tasks: DataFrame, candidates: DataFrame, states: DataFrame, anchor: int) -> DataFrame:
    """Overlay of role a beside the recorded roles b and c, frame by frame from the anchor on.

    ``tasks``: candidate_id, scenario_id, a, b, c.
    """
    out = overlay(candidates, states, anchor)
    out = out.where(f"timestep >= {anchor}").select("candidate_id", "timestep", "time_s", *[F.col(c).alias(f"a_{c}") for c in STATE])
    out = out.join(tasks.select("candidate_id", "scenario_id", "b", "c"), "candidate_id")
    for role in ("b", "c"):
        side = states.select("scenario_id", F.col("track_id").alias(role), "timestep", *[F.col(c).alias(f"{role}_{c}") for c in STATE])
        out = out.join(side, ["scenario_id", role, "timestep"], "left")
    return out


def with_steps(wide: DataFrame) -> DataFrame:
    """Path speed and tangential acceleration of each role between consecutive frames."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    dt = f"(time_s - lag(time_s) {w})"
    speed = lambda r: f"CASE WHEN timestep - lag(timestep) {w} = 1 THEN {fm.norm(f'{r}_x - lag({r}_x) {w}', f'{r}_y - lag({r}_y) {w}')} / {dt} END AS {r}_speed"
    one = wide.selectExpr("*", *[speed(r) for r in ROLES])
    return one.selectExpr("*", *[f"({r}_speed - lag({r}_speed) {w}) / {dt} AS {r}_accel" for r in ROLES])


def anchored(wide: DataFrame, anchor: int) -> DataFrame:
    """Adds every role's state at the anchor frame to each row (prefix o)."""
    w = Window.partitionBy("candidate_id")
    at = lambda c: F.max(F.when(F.col("timestep") == anchor, F.col(c))).over(w)
    return wide.withColumns({f"o{r}_{c}": at(f"{r}_{c}") for r in ROLES for c in ("x", "y", "heading")})
