"""Model feature tables: selected actors, actor and map features, perturbation, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import frames as fr, polylines as pl
from roadsift.operators.grid import CELL, box_cells, point_cell
from roadsift.operators.ranking import digest, hash_unit

# Actor slots, actor radius, map radius, polylines, points.
ACTORS, ACTOR_RADIUS, MAP_RADIUS, POLYLINES, POINTS = 32, 100.0, 100.0, 128, 20


def select_actors(samples: DataFrame, states: DataFrame, history: int, limit: int = ACTORS, radius: float = ACTOR_RADIUS) -> DataFrame:
    """Explicit role tracks first, then the nearest tracks within the radius, ``limit`` slots in all.

    ``samples``: sample_id, scenario_id, ox, oy, explicit (ordered array of track ids).
    """
    last = states.where(f"timestep < {history} AND observed AND x IS NOT NULL AND y IS NOT NULL").groupBy("scenario_id", "track_id").agg(
        F.max_by(F.struct("x", "y"), "timestep").alias("p")).selectExpr("scenario_id", "track_id", "p.x AS px", "p.y AS py")
    fixed = samples.selectExpr("sample_id", "scenario_id", "posexplode(explicit) AS (slot, track_id)")
    near = point_cell(last, "px", "py", radius).join(box_cells(samples, "ox", "oy", "ox", "oy", radius, radius), CELL)
    near = near.withColumn("d", F.expr(fm.norm("px - ox", "py - oy"))).where(f"d <= {radius} AND NOT array_contains(explicit, track_id)")
    w = Window.partitionBy("sample_id").orderBy("d", "track_id")
    near = near.withColumn("n", F.row_number().over(w)).where(f"n <= {limit}").where(f"n <= {limit} - size(explicit)")
    return fixed.select("sample_id", "scenario_id", "track_id", "slot").unionByName(
        near.selectExpr("sample_id", "scenario_id", "track_id", "CAST(size(explicit) + n - 1 AS INT) AS slot"))


def actor_features(selected: DataFrame, samples: DataFrame, states: DataFrame, history: int) -> DataFrame:
    """Per sample and slot the history as fixed-length arrays: local position and velocity, heading sine and cosine, mask."""
    s = fr.fill_headings(states.where(f"timestep < {history}"), history)
    lx, ly = fr.local_point("x", "y", "ox", "oy", "oh")
    ok = "observed AND x IS NOT NULL AND y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND filled IS NOT NULL"
    item = (f"struct(timestep AS t, array(CAST({lx} AS FLOAT), CAST({ly} AS FLOAT), CAST({fm.forward('vx', 'vy', 'oh')} AS FLOAT), CAST({fm.left('vx', 'vy', 'oh')} AS FLOAT), "
            f"CAST(sin({fm.wrap('filled - oh')}) AS FLOAT), CAST(cos({fm.wrap('filled - oh')}) AS FLOAT)) AS v)")
    j = selected.join(samples.select("sample_id", "ox", "oy", "oh"), "sample_id").join(s, ["scenario_id", "track_id"])
    g = j.groupBy("sample_id", "slot", "track_id").agg(F.expr(f"map_from_entries(collect_list({item}) FILTER (WHERE {ok}))").alias("m"))
    zero = "array_repeat(CAST(0 AS FLOAT), 6)"
    return g.selectExpr("sample_id", "slot", "track_id", f"transform(sequence(0, {history - 1}), t -> coalesce(m[t], {zero})) AS features",
                        f"transform(sequence(0, {history - 1}), t -> m[t] IS NOT NULL) AS mask")


def map_features(samples: DataFrame, polylines: DataFrame, limit: int = POLYLINES, points: int = POINTS, radius: float = MAP_RADIUS) -> tuple[DataFrame, DataFrame]:
    """Nearest polylines inside the radius as local points with unit tangents, and the clip statistics per sample."""
    box = {f"{n}_{c}": F.expr(f"array_{n}(transform(filter(points, p -> p.x IS NOT NULL AND p.y IS NOT NULL), p -> p.{c}))") for n in ("min", "max") for c in "xy"}
    spread = box_cells(polylines.withColumns(box).where("min_x IS NOT NULL"), "min_x", "min_y", "max_x", "max_y", radius, radius)
    near = point_cell(samples, "ox", "oy", radius).join(spread, CELL).withColumn("points", F.expr(
        f"filter(points, p -> p.x IS NOT NULL AND p.y IS NOT NULL AND {fm.norm('p.x - ox', 'p.y - oy')} <= {radius})")).where("size(points) > 0")
    near = near.withColumn("d", F.expr(f"array_min(transform(points, p -> {fm.norm('p.x - ox', 'p.y - oy')}))"))
    kind = "CASE polyline_type WHEN 'lane_centerline' THEN 1 WHEN 'lane_boundary_left' THEN 2 WHEN 'lane_boundary_right' THEN 3 WHEN 'pedestrian_crossing' THEN 4 ELSE 5 END"
    w = Window.partitionBy("sample_id").orderBy("d", "type_id", "polyline_id")
    ranked = near.withColumn("type_id", F.expr(kind)).withColumn("slot", F.row_number().over(w) - 1)
    stats = ranked.groupBy("sample_id").agg(
        F.count("*").alias("eligible"), F.expr(f"count_if(slot < {limit})").alias("retained"), F.expr(f"count_if(slot >= {limit})").alias("dropped"),
        F.expr("sum(size(points))").alias("points_in_radius"), F.expr(f"count_if(slot < {limit} AND size(points) > {points})").alias("resampled"))
    kept = pl.fit(ranked.where(F.col("slot") < limit), "points", points, "points")
    lx, ly = fr.local_point("p.x", "p.y", "ox", "oy", "oh")
    local = kept.withColumn("points", F.expr(f"transform(points, p -> struct({lx} AS x, {ly} AS y))"))
    return local.withColumn("tangents", F.expr(pl.tangents("points"))).select("sample_id", "slot", "type_id", "polyline_id", "points", "tangents"), stats


def perturbation(seed_text: str) -> tuple[str, str]:
    """Position scale in 0.98..1.02 and lateral offset in -0.15..0.15 m from a seed string."""
    h = f"sha2({seed_text}, 256)"
    return f"CAST(0.98D + 0.04D * CAST({hash_unit(h)} AS DOUBLE) AS DOUBLE)", f"CAST(-0.15D + 0.3D * CAST({hash_unit(h, 17)} AS DOUBLE) AS DOUBLE)"


def perturb(futures: DataFrame, seed_text: str, steps: int) -> DataFrame:
    """Scaled local future with a lateral offset that fades in along a smooth step."""
    scale, side = perturbation(seed_text)
    f = futures.withColumns({"scale": F.expr(scale), "side": F.expr(side)}).withColumn("u", F.expr(f"(step - 1) / {steps - 1}D"))
    return f.withColumns({"x": F.expr("x * scale"), "y": F.expr("y * scale + side * u * u * (3 - 2 * u)")}).drop("u")


def sample_parameters(records: DataFrame, parameters: DataFrame, sample_key: str, seed: int = 2026) -> DataFrame:
    """Order-independent parameter draws: uniform in the range, or one of the choices, from a hash per name."""
    j = records.join(F.broadcast(parameters), "skill_id").withColumn("u", F.expr(
        f"CAST({hash_unit(digest(repr(str(seed)), 'skill_id', sample_key, 'name'))} AS DOUBLE)"))
    return j.withColumns({"number": F.expr("low + (high - low) * u"), "choice": F.expr("choices[CAST(floor(u * size(choices)) AS INT)]")})


def encode_parameters(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Min-max scaled ranges and one-hot choices by skill-local slot."""
    slots = ("IF(choices IS NULL, array(struct(slot, IF(high > low, (number - low) / (high - low), 0D) AS v)), "
             "transform(sequence(0, size(choices) - 1), i -> struct(slot + i AS slot, IF(choices[i] = choice, 1D, 0D) AS v)))")
    flat = drawn.selectExpr(*keys, "skill_id", f"inline({slots}) AS (slot, v)")
    return flat.groupBy(*keys, "skill_id").agg(F.expr("transform(sort_array(collect_list(struct(slot, v))), s -> s.v)").alias("encoded"))


def check_parameters(drawn: DataFrame) -> DataFrame:
    """Drawn values outside their range or choices."""
    return drawn.where("coalesce(NOT number BETWEEN low AND high, false) OR coalesce(NOT array_contains(choices, choice), false)")


def safe_projection(table: DataFrame, allowed: list[str]) -> DataFrame:
    """Only allow-listed feature columns reach a model."""
    missing = [c for c in allowed if c not in table.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    return table.select(*allowed)
