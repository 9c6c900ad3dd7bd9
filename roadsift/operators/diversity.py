"""Trajectory distance, novelty, signatures and the exact greedy diversity selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm
from roadsift.session import materialize

# Diversity policy.
MAX_PER_GROUP, MIN_RMS, MIN_END, SPACE_BIN, RISK_BIN = 3, 1.0, 0.5, 1.0, 0.25


def distances(a: str, b: str) -> tuple[str, str]:
    """RMS and endpoint distance of two futures (arrays of points)."""
    sq = f"aggregate(zip_with({a}, {b}, (p, q) -> (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), CAST(0 AS DOUBLE), (s, v) -> s + v)"
    end = fm.norm(f"element_at({a}, -1).x - element_at({b}, -1).x", f"element_at({a}, -1).y - element_at({b}, -1).y")
    return f"sqrt({sq} / size({a}))", end


def signature(future: str, frames: tuple[int, ...], risk: str, bins: str) -> str:
    """Skill, binned positions at fixed frames, risk bin and parameter bins (half-even rounding)."""
    cells = [f"CAST(CAST(bround({future}[{i}].{c} / {SPACE_BIN}) AS BIGINT) AS STRING)" for i in frames for c in "xy"]
    return f"sha2(concat_ws('|', skill_id, {', '.join(cells)}, CAST(CAST(bround({risk} / {RISK_BIN}) AS BIGINT) AS STRING), {bins}), 256)"


def novelty(candidate: DataFrame, source: DataFrame, keys: list[str], steps: int, minimum_rms: float = 0.5, minimum_end: float = 1.0) -> DataFrame:
    """RMS and endpoint displacement against the original future; needs every step on both sides."""
    src = source.withColumnsRenamed({"x": "sx", "y": "sy"})
    j = candidate.join(src, [*keys, "timestep"], "left").withColumn("d", F.expr(fm.norm("x - sx", "y - sy")))
    g = j.groupBy("candidate_id").agg(F.expr("sqrt(avg(d * d))").alias("rms"), F.max_by("d", "timestep").alias("endpoint"), F.count("d").alias("steps"))
    return g.withColumn("reason", F.expr(f"CASE WHEN steps < {steps} THEN 'novelty_reference_unavailable' WHEN rms < {minimum_rms} AND endpoint < {minimum_end} THEN 'novelty_insufficient' END"))


def greedy(candidates: DataFrame) -> DataFrame:
    """Exact greedy selection in the order (skill, quality, scenario, id), in distributed rounds.

    Columns: candidate_id, scenario_id, skill_id, quality_score, future, signature.  A group is one scenario and skill.
    Rounds only settle what is accepted.  In each, all candidates whose signature is taken leave together, wherever they
    stand: the one that took it comes before them.  Every group then offers its first candidate that is not too similar to
    what it has accepted, and the offer is accepted unless an earlier undecided candidate carries its signature.  A group
    accepts at most three, so a shared signature costs one round and not one for each of its bearers.  The reasons of all
    others follow at the end in one pass over what was accepted before them.
    """
    group, order = ["scenario_id", "skill_id"], "struct(quality_score, scenario_id, candidate_id)"
    everyone = materialize(candidates.withColumn("o", F.expr(order)), "diversity")
    rms, end = distances("future", "f")
    closest = F.expr(f"min(struct({rms} AS rms, {end} AS end, c))").alias("m")
    similar = f"coalesce(m.rms < {MIN_RMS} AND m.end < {MIN_END}, false)"
    alive, accepted = everyone, None
    while True:
        state = alive.withColumns({"similar": F.lit(False), "taken": F.lit(0)})
        if accepted is not None:
            free = alive.join(accepted.select("signature").distinct(), "signature", "left_anti")
            near = free.join(accepted.selectExpr(*group, "candidate_id AS c", "future AS f"), group).groupBy("candidate_id").agg(closest, F.count("*").alias("taken"))
            state = free.join(near, "candidate_id", "left").withColumn("similar", F.expr(similar)).na.fill(0, ["taken"]).drop("m").where(f"taken < {MAX_PER_GROUP}")
        # offers: aggregated before the shuffle, then joined back; similar ones before a group's offer are settled
        first = state.where("NOT similar").groupBy(*group).agg(F.min("o").alias("first"))
        state = materialize(state.join(first, group).where("NOT similar OR o > first"), "diversity")
        if state.isEmpty():
            break
        lead = state.groupBy("signature").agg(F.min("o").alias("lead"))
        won = state.where("o = first").join(lead, "signature").where("o = lead").select("candidate_id", *group, "future", "signature", "o")
        accepted = materialize(won if accepted is None else accepted.unionByName(won), "diversity")
        alive = state.join(accepted.select("candidate_id"), "candidate_id", "left_anti").select(*everyone.columns)
    if accepted is None:
        return everyone.select("candidate_id", *group, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
    before = everyone.join(accepted.selectExpr(*group, "candidate_id AS c", "future AS f", "o AS p"), group).where("p < o").groupBy("candidate_id").agg(closest, F.count("*").alias("taken"))
    out = everyone.join(before, "candidate_id", "left").join(accepted.select("candidate_id", F.lit(True).alias("accepted")), "candidate_id", "left")
    reason = f"CASE WHEN accepted THEN NULL WHEN {similar} THEN 'too_similar' WHEN taken >= {MAX_PER_GROUP} THEN 'scenario_skill_limit' ELSE 'global_duplicate' END"
    return out.select("candidate_id", *group, F.expr("coalesce(accepted, false)").alias("accepted"), F.expr(reason).alias("reason"))
