"""Training sample tables: supervised records, headway check, base samples, map fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import pairs as pr
from roadsift.operators.seeds import best_label
from roadsift.operators.tracks import array_run
from roadsift.rules.catalog import RULES

OBSERVED = [k for k, r in RULES.items() if r.mode == "observed_trigger"]
KEY = ["scenario_id", "skill_id", "initiator_track_id", "responder_track_id"]


def observed_records(seeds: DataFrame) -> DataFrame:
    """Only observed-trigger rules supervise; one record per scenario, skill, initiator and responder."""
    return best_label(seeds.where(F.col("skill_id").isin(OBSERVED)), KEY, ["seed_risk_value"])


def future_headway(pairs: DataFrame, limit: float = 1.2, lateral: float = 3.75, seconds: float = 1.0, minimum_speed: float = 2.0) -> DataFrame:
    """Pairs whose short headway lasts in the future window with a bounded lateral offset."""
    pa, pb = pr.shared_future()
    gap, side = fm.forward("p.x - q.x", "p.y - q.y", "q.heading"), fm.left("p.x - q.x", "p.y - q.y", "q.heading")
    v = fm.norm("q.vx", "q.vy")
    ok = f"zip_with({pa}, {pb}, (p, q) -> coalesce({v} >= {minimum_speed} AND {gap} > 0 AND {gap} / {v} <= {limit} AND abs({side}) <= {lateral}, false))"
    return pairs.withColumn("run_s", F.expr(f"{array_run(ok)} * 0.1D")).where(f"run_s >= {seconds} - 1e-9")


def training_samples(focal: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """A base sample per scenario and one per observed record, each with its target's rejection reason."""
    base = focal.selectExpr("scenario_id", "track_id", "'<none>' AS skill_id", "false AS supervised")
    role = "IF(skill_id = 'short_headway_following', role_track_ids['close_follower'], initiator_track_id)"
    seen = observed_records(seeds).selectExpr("scenario_id", f"{role} AS track_id", "skill_id", "true AS supervised")
    return base.unionByName(seen).join(targets.select("scenario_id", "track_id", "reason"), ["scenario_id", "track_id"], "left")


def map_fingerprints(polylines: DataFrame) -> DataFrame:
    """Order-free content hash of a scenario's map: polyline hashes combined without collecting the map."""
    one = polylines.select("scenario_id", F.xxhash64("polyline_id", "polyline_type", "direction", "points", "left_neighbor_id", "right_neighbor_id", "predecessor_ids", "successor_ids").alias("h"))
    return one.groupBy("scenario_id").agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).selectExpr(
        "scenario_id", "sha2(concat_ws('|', CAST(x AS STRING), CAST(s AS STRING), CAST(n AS STRING)), 256) AS fingerprint")
