"""Per-track operators over `track_states` (one shuffle on scenario and track)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm

KEY = ["scenario_id", "track_id"]
POSITION = "(x IS NOT NULL AND y IS NOT NULL)"
FULL = "(x IS NOT NULL AND y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND heading IS NOT NULL)"


def by_track():
    return Window.partitionBy(*KEY)


def null_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN means missing in the raw files; everything downstream uses NULL."""
    return df.withColumns({n: F.expr(f"CASE WHEN isnan({n}) THEN NULL ELSE {n} END") for n in names})


def valid_frames(states: DataFrame) -> DataFrame:
    """Valid trajectory points with their original frame numbers."""
    return states.where(POSITION)


def speeds(states: DataFrame) -> DataFrame:
    """Speed over (t-1, t]; NULL on the first frame, on a missing frame and after a gap."""
    joined = f"timestep - lag(timestep) OVER w = 1 AND {POSITION}"
    step = fm.norm("x - lag(x) OVER w", "y - lag(y) OVER w")
    return _over(states, speed=f"CASE WHEN {joined} THEN {step} / (time_s - lag(time_s) OVER w) END")


def accelerations(states: DataFrame) -> DataFrame:
    """Tangential acceleration from two consecutive speeds."""
    return _over(speeds(states), accel="CASE WHEN timestep - lag(timestep) OVER w = 1 "
                 "THEN (speed - lag(speed) OVER w) / (time_s - lag(time_s) OVER w) END")


def _over(df: DataFrame, **columns: str) -> DataFrame:
    spec = "(PARTITION BY scenario_id, track_id ORDER BY timestep)"
    return df.selectExpr("*", *[f"{e.replace('OVER w', 'OVER ' + spec)} AS {n}" for n, e in columns.items()])


def with_reference(states: DataFrame) -> DataFrame:
    """Attach the reference frame: the last observed frame whose state is complete."""
    ref = F.max(F.when(F.expr(f"observed AND {FULL}"), F.col("timestep"))).over(by_track())
    return states.withColumn("ref_t", ref).where("ref_t IS NOT NULL")


def reference_states(states: DataFrame) -> DataFrame:
    state = F.struct("timestep", "x", "y", "vx", "vy", "heading")
    best = states.where(f"observed AND {FULL}").groupBy(*KEY, "object_type").agg(F.max_by(state, "timestep").alias("r"))
    return best.selectExpr(*KEY, "object_type", "r.timestep AS ref_t", "r.x AS x", "r.y AS y", "r.vx AS vx", "r.vy AS vy",
                           "r.heading AS heading", f"{fm.norm('r.vx', 'r.vy')} AS speed")


def future_window(states: DataFrame) -> DataFrame:
    return with_reference(states).where("timestep >= ref_t")


def actors(states: DataFrame) -> DataFrame:
    """One row per track: reference state, history frames, future features and dense frame arrays.

    A track holds at most 110 frames by the time contract, so the arrays are bounded.
    """
    s = with_reference(accelerations_fixed(states))
    at = lambda c, cond, fn: f"{fn}({c}, timestep) FILTER (WHERE {cond})"
    future, moving = "timestep >= ref_t", "timestep >= ref_t AND vx IS NOT NULL AND vy IS NOT NULL"
    full, pos, hd = f"{future} AND {FULL}", f"{future} AND {POSITION}", f"{future} AND heading IS NOT NULL"
    here = "timestep = ref_t"
    g = s.groupBy(*KEY, "object_type").agg(
        F.max("ref_t").alias("ref_t"),
        *[F.expr(f"max({c}) FILTER (WHERE {here})").alias(n) for c, n in
          (("x", "x"), ("y", "y"), ("vx", "vx"), ("vy", "vy"), ("heading", "heading"), ("time_s", "ref_time"))],
        F.expr(f"sort_array(collect_list(timestep) FILTER (WHERE observed AND {POSITION}))").alias("hist_frames"),
        F.expr(at("struct(x, y)", pos, "min_by")).alias("p0"), F.expr(at("struct(x, y)", pos, "max_by")).alias("p1"),
        F.expr(at("heading", hd, "min_by")).alias("h0"), F.expr(at("heading", hd, "max_by")).alias("h1"),
        F.expr(at("struct(x, y, vx, vy, heading)", full, "max_by")).alias("finish"),
        F.expr(f"min({fm.norm('vx', 'vy')}) FILTER (WHERE {moving})").alias("min_speed"),
        F.expr("min(accel_fixed) FILTER (WHERE timestep >= ref_t + 2)").alias("min_accel"),
        F.expr("map_from_entries(collect_list(struct(timestep, struct(observed, time_s, x, y, vx, vy, heading) AS s)))").alias("frames"),
        F.max("timestep").alias("last_t"))
    return g.selectExpr(
        *KEY, "object_type", "ref_t", "ref_time", "x", "y", "vx", "vy", "heading", f"{fm.norm('vx', 'vy')} AS speed",
        "hist_frames", "size(hist_frames) AS hist_steps",
        f"coalesce({fm.left('p1.x - p0.x', 'p1.y - p0.y', 'heading')}, CAST(0 AS DOUBLE)) AS lateral",
        f"coalesce({fm.wrap('h1 - h0')}, CAST(0 AS DOUBLE)) AS turn",
        "min_speed", "coalesce(min_accel, CAST(0 AS DOUBLE)) AS min_accel",
        "finish.x AS end_x", "finish.y AS end_y", "finish.heading AS end_heading",
        "transform(sequence(0, ref_t), t -> frames[t]) AS past",
        "transform(sequence(ref_t, last_t), t -> frames[t]) AS future")


def accelerations_fixed(states: DataFrame) -> DataFrame:
    """Acceleration at a fixed 0.1 s period: second difference of the path, three adjacent frames."""
    step = fm.norm("x - lag(x) OVER w", "y - lag(y) OVER w")
    a = _over(states, step_v=f"CASE WHEN timestep - lag(timestep) OVER w = 1 THEN {step} / 0.1 END")
    return _over(a, accel_fixed="CASE WHEN timestep - lag(timestep) OVER w = 1 THEN (step_v - lag(step_v) OVER w) / 0.1 END").drop("step_v")


def longest_run(df: DataFrame, keys: list[str], flag: str, frame: str = "timestep") -> DataFrame:
    """Longest run of consecutive true frames per key (gaps and islands)."""
    hits = df.where(flag).withColumn(
        "island", F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame)))
    runs = hits.groupBy(*keys, "island").agg(F.count("*").alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last"))
    return runs.groupBy(*keys).agg(F.max("frames").alias("frames"),
                                   F.max(F.col("last") - F.col("first")).alias("span"))


# longest run of true entries of a boolean array, in frames
def array_run(flags: str) -> str:
    return (f"aggregate({flags}, struct(0 AS c, 0 AS m), (s, f) -> struct(IF(f, s.c + 1, 0) AS c, "
            f"greatest(s.m, IF(f, s.c + 1, 0)) AS m), s -> s.m)")


def stop_metrics(states: DataFrame, stopped: float, prior: float) -> DataFrame:
    """Moving-to-stopped: first stopped future frame, fastest speed before it, length of the stop."""
    ok = f"vx IS NOT NULL AND vy IS NOT NULL AND {POSITION}"
    s = with_reference(states).where(ok).withColumn("speed", F.expr(fm.norm("vx", "vy")))
    first = F.min(F.expr(f"CASE WHEN timestep >= ref_t AND speed <= {stopped} THEN timestep END")).over(by_track())
    s = s.withColumn("stop_t", first).where("stop_t IS NOT NULL")
    slow = longest_run(s, KEY, f"timestep >= stop_t AND speed <= {stopped}").selectExpr(*KEY, "frames AS stop_frames")
    at = s.groupBy(*KEY).agg(
        F.expr("max(speed) FILTER (WHERE timestep < stop_t)").alias("prior_speed"),
        F.expr("max(time_s) FILTER (WHERE timestep = stop_t) - max(time_s) FILTER (WHERE timestep = ref_t)").alias("dt"),
        F.expr("max(struct(x, y)) FILTER (WHERE timestep = stop_t)").alias("p"),
        F.expr("max(struct(x, y)) FILTER (WHERE timestep = ref_t)").alias("q"))
    return (at.where(f"prior_speed >= {prior}").join(slow, KEY)
            .selectExpr(*KEY, "stop_frames * 0.1D AS stop_s", "greatest(CAST(0 AS DOUBLE), dt) AS stop_time_s",
                        f"{fm.norm('p.x - q.x', 'p.y - q.y')} AS stop_travel", "prior_speed AS stop_prior"))


def low_speed(states: DataFrame, limit: float) -> DataFrame:
    """Seconds of the longest future run at or below a speed."""
    s = future_window(states).where("vx IS NOT NULL AND vy IS NOT NULL")
    return longest_run(s, KEY, f"{fm.norm('vx', 'vy')} <= {limit}").selectExpr(*KEY, "frames * 0.1D AS low_s")


def trailing_stop(states: DataFrame, limit: float) -> DataFrame:
    """Seconds standing still up to and including the reference frame, without a gap."""
    s = with_reference(states).where("observed AND vx IS NOT NULL AND vy IS NOT NULL AND timestep <= ref_t")
    slow = s.where(f"{fm.norm('vx', 'vy')} <= {limit}")
    hits = slow.withColumn("island", F.col("timestep") - F.row_number().over(by_track().orderBy("timestep")))
    runs = hits.groupBy(*KEY, "island").agg(F.count("*").alias("n"), F.max(F.col("timestep") - F.col("ref_t")).alias("off"))
    return runs.where("off = 0").selectExpr(*KEY, "n * 0.1D AS standing_s")
