"""Deliveries, decision audits and review samples over `filter_decisions`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.operators.ranking import digest, quantiles, value_ranks

# Funnel stages in order.
STAGES = ("schema_finite", "history_invariants", "kinematics", "map", "collision", "target_risk", "skill_trigger", "parameter_realization", "diversity")
STAGE_ORDER = "CASE first_failed_stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + " END"


def balanced(accepted: DataFrame, per_scenario: int = 3, per_skill: int = 300, descending: bool = True) -> DataFrame:
    """At most ``per_scenario`` rows per scenario and skill, then ``per_skill`` rows per skill, in quality order.

    Quality is lower-is-better in the funnel, but the reference order of deliveries is descending; both are offered.
    """
    quality = F.col("quality_score").desc() if descending else F.col("quality_score").asc()
    order = [quality, "scenario_id", "candidate_index", "candidate_id"]
    a = accepted.withColumn("n", F.row_number().over(Window.partitionBy("skill_id", "scenario_id").orderBy(*order))).where(F.col("n") <= per_scenario)
    b = a.withColumn("n", F.row_number().over(Window.partitionBy("skill_id").orderBy(*order))).where(F.col("n") <= per_skill)
    return b.drop("n")


def funnel(decisions: DataFrame) -> DataFrame:
    """Candidates per skill, first failed stage and reason, with subtotals (rollup)."""
    d = decisions.withColumn("stage", F.expr("coalesce(first_failed_stage, 'accepted')")).withColumn("why", F.expr("coalesce(reason, 'none')"))
    return d.rollup("skill_id", "stage", "why").agg(F.count("*").alias("candidates"))


def task_depth(decisions: DataFrame) -> DataFrame:
    """Per task: candidates that reached and passed each stage, the deepest stage reached."""
    at = f"coalesce({STAGE_ORDER}, {len(STAGES)})"
    cells = [c for i, s in enumerate(STAGES) for c in (F.expr(f"count_if({at} >= {i})").alias(f"reached_{s}"), F.expr(f"count_if({at} > {i})").alias(f"passed_{s}"))]
    return decisions.groupBy("task_id").agg(*cells, F.expr(f"max(least({at}, {len(STAGES) - 1}))").alias("deepest"), F.expr(f"count_if({at} = {len(STAGES)})").alias("accepted"))


def arm_gate(decisions: DataFrame, minimum: int, rate: float) -> DataFrame:
    """Per skill and arm: acceptance, dominant rejection (count, then stage, reason), support status and gate."""
    d = decisions.withColumn("ok", F.expr("first_failed_stage IS NULL"))
    base = d.groupBy("skill_id", "arm").agg(F.count("*").alias("candidates"), F.expr("count_if(ok)").alias("accepted"), F.count_distinct("scenario_id").alias("scenarios"))
    why = d.where("NOT ok").groupBy("skill_id", "arm", "first_failed_stage", "reason").agg(F.count("*").alias("n"))
    top = why.groupBy("skill_id", "arm").agg(F.expr("min(struct(-n AS k, first_failed_stage AS stage, reason))").alias("w"))
    g = base.join(top, ["skill_id", "arm"], "left")
    return g.selectExpr("skill_id", "arm", "candidates", "accepted", "scenarios", "w.stage AS stage", "w.reason AS reason",
                        f"CASE WHEN accepted >= {minimum} THEN 'supported' WHEN accepted > 0 THEN 'limited' ELSE 'unsupported' END AS support",
                        f"accepted >= {rate} * candidates AS gate")


def capability(decisions: DataFrame) -> DataFrame:
    """Records, scenarios, targets and modes per skill."""
    g = decisions.groupBy("skill_id").agg(
        F.count("*").alias("records"), F.count_distinct("scenario_id").alias("scenarios"), F.count_distinct("target_track_id").alias("targets"),
        F.sort_array(F.collect_set("detection_mode")).alias("modes"), F.expr("count_if(first_failed_stage IS NULL)").alias("accepted"))
    return g.selectExpr("skill_id", "records", "scenarios", "targets", "concat_ws(',', modes) AS modes",
                        "CASE WHEN accepted = 0 THEN 'none' WHEN size(modes) > 1 THEN 'mixed' ELSE 'single' END AS support")


def paired_arms(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Both, one or neither accepted for condition and control rows that share a latent group and index."""
    ok = "coalesce(bool_or(first_failed_stage IS NULL) FILTER (WHERE arm = '{}'), false)"
    has = "count_if(arm = '{}') > 0"
    g = decisions.groupBy("skill_id", *keys).agg(F.expr(ok.format("skill_condition")).alias("c"), F.expr(ok.format("null_condition")).alias("n"),
                                                 F.expr(f"{has.format('skill_condition')} AND {has.format('null_condition')}").alias("paired"))
    return g.where("paired").groupBy("skill_id").agg(F.expr("count_if(c AND n)").alias("both"), F.expr("count_if(c AND NOT n)").alias("condition_only"),
                                                     F.expr("count_if(n AND NOT c)").alias("control_only"), F.expr("count_if(NOT c AND NOT n)").alias("neither"))


def outcome_counts(decisions: DataFrame) -> DataFrame:
    d = decisions.withColumn("outcome", F.expr("IF(first_failed_stage IS NULL, 'accepted', 'rejected')"))
    return d.groupBy("skill_id", "arm").pivot("outcome", ["accepted", "rejected"]).count().na.fill(0, ["accepted", "rejected"])


def scenario_histogram(delivery: DataFrame) -> DataFrame:
    per = delivery.groupBy("scenario_id").agg(F.count("*").alias("rows"))
    return per.groupBy("rows").agg(F.count("*").alias("scenarios"))


def top_share(delivery: DataFrame, n: int = 10) -> DataFrame:
    """Share of the rows held by the ``n`` largest scenarios."""
    per = delivery.groupBy("scenario_id").agg(F.count("*").alias("rows"))
    best = per.orderBy(F.col("rows").desc(), "scenario_id").limit(n).agg(F.sum("rows").alias("top"))
    return best.join(F.broadcast(per.agg(F.sum("rows").alias("total")))).selectExpr("top", "total", "top / total AS share")


def risk_summary(delivery: DataFrame) -> DataFrame:
    base = delivery.groupBy("skill_id").agg(F.count("risk_value").alias("n"), F.min("risk_value").alias("minimum"), F.max("risk_value").alias("maximum"))
    return base.join(quantiles(delivery, ["skill_id"], "risk_value", {"median": 0.5}), "skill_id")


def representative_rejects(decisions: DataFrame, per_skill: int) -> DataFrame:
    """One reject per first-failed stage in stage order with distinct scenarios, then the best remaining ones.

    The distinct-scenario step is greedy over at most nine stages, so per stage only the best nine scenarios of a
    skill can matter, and the filling needs ``per_skill`` more; only these bounded rows reach the grouped step.
    """
    rejects = decisions.where("first_failed_stage IS NOT NULL").withColumn("stage_no", F.expr(STAGE_ORDER))
    order = ["quality_score", "scenario_id", "candidate_id"]
    one = rejects.withColumn("k", F.row_number().over(Window.partitionBy("skill_id", "stage_no", "scenario_id").orderBy(*order))).where("k = 1")
    head = one.withColumn("k", F.row_number().over(Window.partitionBy("skill_id", "stage_no").orderBy(*order))).where(f"k <= {len(STAGES)}")
    fill = rejects.withColumn("k", F.row_number().over(Window.partitionBy("skill_id").orderBy(*order))).where(f"k <= {per_skill + len(STAGES)}")
    cols = ["skill_id", "candidate_id", "scenario_id", "stage_no", "quality_score"]
    pool = head.select(*cols).unionByName(fill.select(*cols)).distinct()

    def choose(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        picked, seen = [], set()
        for _, stage in pdf.groupby("stage_no", sort=True):
            row = next((r for r in stage.itertuples() if r.scenario_id not in seen), None)
            if row is not None and len(picked) < per_skill:
                picked.append(row)
                seen.add(row.scenario_id)
        chosen = {r.candidate_id for r in picked}
        for row in pdf.itertuples():
            if len(picked) >= per_skill:
                break
            if row.candidate_id not in chosen:
                picked.append(row)
                chosen.add(row.candidate_id)
        import pandas as pd
        return pd.DataFrame([(r.skill_id, r.candidate_id, r.scenario_id, i) for i, r in enumerate(picked)], columns=["skill_id", "candidate_id", "scenario_id", "position"])

    return pool.groupBy("skill_id").applyInPandas(choose, "skill_id string, candidate_id string, scenario_id string, position long")


def pilot_representatives(decisions: DataFrame) -> DataFrame:
    """Best accepted row and the first row of the most frequent rejection reason per skill and arm."""
    key = ["skill_id", "arm"]
    good = decisions.where("first_failed_stage IS NULL").groupBy(*key).agg(F.expr("min(struct(quality_score, scenario_id, candidate_id))").alias("r")).selectExpr(
        *key, "'accepted' AS kind", "r.candidate_id AS candidate_id")
    per = decisions.where("first_failed_stage IS NOT NULL").groupBy(*key, "reason").agg(
        F.count("*").alias("n"), F.expr("min(struct(quality_score, scenario_id, candidate_id))").alias("r"))
    bad = per.groupBy(*key).agg(F.expr("min(struct(-n AS k, reason, r))").alias("w")).selectExpr(*key, "'rejected' AS kind", "w.r.candidate_id AS candidate_id")
    return good.unionByName(bad)


def automated_review(decisions: DataFrame) -> DataFrame:
    """Criterion per stage: pass, fail at the first failed stage, not applicable after it; status of the case."""
    at = f"coalesce({STAGE_ORDER}, {len(STAGES)})"
    marks = [f"CASE WHEN {at} > {i} THEN 'pass' WHEN {at} = {i} THEN 'fail' ELSE 'n.a.' END AS {s}" for i, s in enumerate(STAGES)]
    return decisions.selectExpr("candidate_id", "skill_id", *marks, "CASE WHEN first_failed_stage IS NOT NULL THEN 'failed' WHEN quality_score > 0.3 THEN 'uncertain' ELSE 'passed' END AS status")


def review_consistency(reviews: DataFrame, criteria: tuple[str, ...] = STAGES) -> DataFrame:
    """Overall status must agree with the criteria: any fail means failed, failed needs a fail."""
    fails = " + ".join(f"CAST({c} = 'fail' AS INT)" for c in criteria)
    return reviews.withColumn("agrees", F.expr(f"(({fails}) > 0) = (status = 'failed')")).groupBy("skill_id", "status").agg(
        F.count("*").alias("cases"), F.expr("count_if(NOT agrees)").alias("inconsistent"))


def split_audit(splits: DataFrame, delivery: DataFrame, train: str) -> DataFrame:
    """Counts and an order-free hash of each split, and delivered scenarios outside the training split."""
    per = splits.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("scenario_id").alias("scenarios"), F.bit_xor(F.xxhash64("scenario_id")).alias("id_hash"))
    outside = delivery.select("scenario_id").distinct().join(splits.where(F.col("split") == train), "scenario_id", "left_anti").agg(F.count("*").alias("outside_train"))
    return per.join(F.broadcast(outside))


def hash_choice(raw: DataFrame, delivered: DataFrame, seed: int) -> DataFrame:
    """Per task as many hash-ranked raw candidates as were delivered; the outcome is attached only afterwards."""
    w = Window.partitionBy("task_id").orderBy(F.expr(digest(f"'{seed}'", "task_id", "candidate_id")), "candidate_id")
    want = delivered.groupBy("task_id").agg(F.count("*").alias("want"))
    ranked = raw.join(want, "task_id").withColumn("n", F.row_number().over(w))
    return ranked.where("n <= want").select("task_id", "candidate_id", F.expr("coalesce(first_failed_stage, 'accepted')").alias("outcome"))


def resume_state(tasks: DataFrame, candidates: DataFrame, decisions: DataFrame, budget: str) -> DataFrame:
    """generate -> filter -> finalise -> completed / failed per task."""
    c = candidates.groupBy("task_id").agg(F.count("*").alias("made"))
    d = decisions.groupBy("task_id").agg(F.count("*").alias("decided"), F.expr("count_if(first_failed_stage IS NULL)").alias("accepted"))
    t = tasks.join(c, "task_id", "left").join(d, "task_id", "left").na.fill(0, ["made", "decided", "accepted"])
    return t.withColumn("state", F.expr(f"CASE WHEN made < {budget} THEN 'generate' WHEN decided = 0 THEN 'filter' WHEN decided < made THEN 'finalise' WHEN accepted > 0 THEN 'completed' ELSE 'failed' END"))
