"""W, A, Q, J and X operators over decisions, deliveries and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.operators import audits as au, delivery as dl
from roadsift.plans.registry import query
from roadsift.plans.seeds_queries import DC, MF, SR, sha

R = fm.rounded
D = f"WITH {DC}"
OK = "first_failed_stage IS NULL"
ORD = "quality_score DESC, scenario_id, candidate_index, candidate_id"
BAL = f"""b1 AS (SELECT * FROM dc WHERE {OK} QUALIFY row_number() OVER (PARTITION BY skill_id, scenario_id ORDER BY {ORD}) <= 3),
  bal AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY {ORD}) <= 300)"""
STAGE_NO = "list_position(['schema_finite', 'history_invariants', 'kinematics', 'map', 'collision', 'target_risk', 'skill_trigger', 'parameter_realization', 'diversity'], first_failed_stage) - 1"


def dec(spark, sf):
    return ad.filter_decisions(spark, sf)


def delivered(spark, sf):
    return dl.balanced(dec(spark, sf).where(OK))


@query("W07_balanced_delivery", f"{D}, {BAL} SELECT candidate_id, skill_id, scenario_id FROM bal")
def w07(spark, sf):
    return delivered(spark, sf).select("candidate_id", "skill_id", "scenario_id")


@query("W08_representative_rejects")
def w08(spark, sf):
    return dl.representative_rejects(dec(spark, sf), 12)


@query("W09_pilot_representatives", f"""{D}, rj AS (SELECT skill_id, arm, reason, count(*) AS n FROM dc WHERE NOT ({OK}) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY skill_id, arm ORDER BY n DESC, reason) = 1)
  SELECT skill_id, arm, 'accepted' AS kind, candidate_id FROM dc WHERE {OK} QUALIFY row_number() OVER (PARTITION BY skill_id, arm ORDER BY quality_score, scenario_id, candidate_id) = 1
  UNION ALL SELECT skill_id, arm, 'rejected', candidate_id FROM dc JOIN rj USING (skill_id, arm, reason) QUALIFY row_number() OVER (PARTITION BY skill_id, arm ORDER BY quality_score, scenario_id, candidate_id) = 1""")
def w09(spark, sf):
    return dl.pilot_representatives(dec(spark, sf))


@query("A13_capability_matrix", f"""{D} SELECT skill_id, count(*) AS records, count(DISTINCT scenario_id) AS scenarios, count(DISTINCT target_track_id) AS targets, string_agg(DISTINCT detection_mode, ',' ORDER BY detection_mode) AS modes,
  CASE WHEN count(*) FILTER (WHERE {OK}) = 0 THEN 'none' WHEN count(DISTINCT detection_mode) > 1 THEN 'mixed' ELSE 'single' END AS support FROM dc GROUP BY 1""")
def a13(spark, sf):
    return dl.capability(dec(spark, sf))


GATE = """SELECT skill_id, arm, candidates, accepted, scenarios, stage, reason, CASE WHEN accepted >= {0} THEN 'supported' WHEN accepted > 0 THEN 'limited' ELSE 'unsupported' END AS support, accepted >= {1} * candidates AS gate
  FROM (SELECT skill_id, arm, count(*) AS candidates, count(*) FILTER (WHERE first_failed_stage IS NULL) AS accepted, count(DISTINCT scenario_id) AS scenarios FROM {2} GROUP BY 1, 2) b
  LEFT JOIN (SELECT skill_id, arm, first_failed_stage AS stage, reason FROM {2} WHERE first_failed_stage IS NOT NULL GROUP BY 1, 2, 3, 4
             QUALIFY row_number() OVER (PARTITION BY skill_id, arm ORDER BY count(*) DESC, first_failed_stage, reason) = 1) w USING (skill_id, arm)"""


@query("A14_pilot_gate", f"{D} {GATE.format(2700, 0.45, 'dc')}")
def a14(spark, sf):
    return dl.arm_gate(dec(spark, sf), 2700, 0.45)


@query("A23_heldout_gate", f"{D}, {MF}, ho AS (SELECT dc.* FROM dc WHERE scenario_id IN (SELECT scenario_id FROM mf WHERE split = 'high')) {GATE.format(500, 0.4, 'ho')}")
def a23(spark, sf):
    held = ad.manifest(spark, sf).where("split = 'high'")
    return dl.arm_gate(dec(spark, sf).join(held, "scenario_id", "left_semi"), 500, 0.4)


@query("A15_filter_funnel", f"{D} SELECT skill_id, stage, why, count(*) AS candidates FROM (SELECT skill_id, coalesce(first_failed_stage, 'accepted') AS stage, coalesce(reason, 'none') AS why FROM dc) GROUP BY ROLLUP (skill_id, stage, why)")
def a15(spark, sf):
    return dl.funnel(dec(spark, sf))


DEPTH = ", ".join(f"count(*) FILTER (WHERE at >= {i}) AS reached_{s}, count(*) FILTER (WHERE at > {i}) AS passed_{s}" for i, s in enumerate(dl.STAGES))


@query("A16_task_funnel_depth", f"{D} SELECT task_id, {DEPTH.replace('at >', 'lvl >')}, CAST(max(least(lvl, 8)) AS INT) AS deepest, count(*) FILTER (WHERE lvl = 9) AS accepted FROM (SELECT task_id, coalesce({STAGE_NO}, 9) AS lvl FROM dc) GROUP BY 1")
def a16(spark, sf):
    return dl.task_depth(dec(spark, sf))


@query("A17_delivery_audit", f"""{D}, {BAL}, ps AS (SELECT scenario_id, count(*) AS n FROM bal GROUP BY 1)
  SELECT 'skill' AS section, skill_id AS key, count(*) AS rows FROM bal GROUP BY 2 UNION ALL SELECT 'mode', detection_mode, count(*) FROM bal GROUP BY 2 UNION ALL SELECT 'bin', CAST(parameter_bin AS VARCHAR), count(*) FROM bal GROUP BY 2
  UNION ALL SELECT 'histogram', CAST(n AS VARCHAR), count(*) FROM ps GROUP BY 2 UNION ALL SELECT 'top10', 'rows', (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT n FROM ps ORDER BY n DESC, scenario_id LIMIT 10))""")
def a17(spark, sf):
    d = delivered(spark, sf)
    part = lambda name, col: d.groupBy(F.col(col).cast("string").alias("key")).agg(F.count("*").alias("rows")).selectExpr(f"'{name}' AS section", "key", "rows")
    hist = dl.scenario_histogram(d).selectExpr("'histogram' AS section", "CAST(rows AS STRING) AS key", "scenarios AS rows")
    top = dl.top_share(d).selectExpr("'top10' AS section", "'rows' AS key", "top AS rows")
    return part("skill", "skill_id").unionByName(part("mode", "detection_mode")).unionByName(part("bin", "parameter_bin")).unionByName(hist).unionByName(top)


@query("A17b_delivery_risk", f"{D}, {BAL} SELECT skill_id, count(risk_value) AS n, {R('min(risk_value)')} AS minimum, {R('max(risk_value)')} AS maximum, {R('median(risk_value)')} AS median FROM bal GROUP BY 1")
def a17b(spark, sf):
    return dl.risk_summary(delivered(spark, sf)).selectExpr("skill_id", "n", *[f"{R(c)} AS {c}" for c in ("minimum", "maximum", "median")])


@query("A18_sample_statistics", f"{D} SELECT skill_id, count(*) AS candidates, count(*) FILTER (WHERE {OK}) AS retained, count(*) FILTER (WHERE NOT ({OK})) AS rejected, true AS balanced FROM dc GROUP BY 1")
def a18(spark, sf):
    g = dec(spark, sf).groupBy("skill_id").agg(F.count("*").alias("candidates"), F.expr(f"count_if({OK})").alias("retained"), F.expr("count_if(reason IS NOT NULL)").alias("rejected"))
    return g.withColumn("balanced", F.expr("candidates = retained + rejected"))


MARKS = ", ".join(f"CASE WHEN lvl > {i} THEN 'pass' WHEN lvl = {i} THEN 'fail' ELSE 'n.a.' END AS {s}" for i, s in enumerate(dl.STAGES))
STATUS = f"CASE WHEN NOT ({OK}) THEN 'failed' WHEN quality_score > 0.3 THEN 'uncertain' ELSE 'passed' END AS status"


@query("A20_automated_review", f"{D} SELECT candidate_id, skill_id, {MARKS}, {STATUS} FROM (SELECT *, coalesce({STAGE_NO}, 9) AS lvl FROM dc)")
def a20(spark, sf):
    return dl.automated_review(dec(spark, sf))


@query("A21_review_consistency", f"{D} SELECT skill_id, status, count(*) AS cases, CAST(0 AS BIGINT) AS inconsistent FROM (SELECT skill_id, {STATUS} FROM dc) GROUP BY 1, 2")
def a21(spark, sf):
    return dl.review_consistency(dl.automated_review(dec(spark, sf)))


@query("A22_input_audit", f"""{D}, {MF}, {BAL} SELECT split, count(*) AS rows, count(DISTINCT scenario_id) AS scenarios, (SELECT count(DISTINCT scenario_id) FROM bal WHERE scenario_id NOT IN (SELECT scenario_id FROM mf WHERE split = 'urgent')) AS outside_train FROM mf GROUP BY 1""")
def a22(spark, sf):
    return dl.split_audit(ad.manifest(spark, sf), delivered(spark, sf), "urgent").drop("id_hash")


@query("A27_heldout_funnel", f"{D} SELECT skill_id, arm, count(*) FILTER (WHERE {OK}) AS accepted, count(*) FILTER (WHERE NOT ({OK})) AS rejected FROM dc GROUP BY 1, 2")
def a27(spark, sf):
    return dl.outcome_counts(dec(spark, sf))


@query("A28_phase_counts", f"""{D}, t AS (SELECT DISTINCT task_id, scenario_id, skill_id FROM dc), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scenario_id ORDER BY {sha("'2026'", "'task'", "task_id")}, task_id) = 1 THEN 'coverage' ELSE 'balance' END AS phase FROM t)
  SELECT phase, count(*) AS tasks, count(DISTINCT scenario_id) AS scenarios, count(DISTINCT skill_id) AS skills FROM p GROUP BY 1""")
def a28(spark, sf):
    from roadsift.operators.seeds import two_phase_order
    t = two_phase_order(dec(spark, sf).select("task_id", "scenario_id", "skill_id").distinct())
    return t.groupBy("phase").agg(F.count("*").alias("tasks"), F.count_distinct("scenario_id").alias("scenarios"), F.count_distinct("skill_id").alias("skills"))


@query("J28_binding_audit", f"""{D}, ct AS (SELECT task_id FROM dc WHERE {OK} GROUP BY 1) SELECT count(*) AS candidates, count(*) FILTER (WHERE ct.task_id IS NULL) AS unbound, CAST(0 AS BIGINT) AS bound_twice FROM dc LEFT JOIN ct USING (task_id)""")
def j28(spark, sf):
    d = dec(spark, sf)
    tasks = d.where(OK).select("task_id").distinct().withColumn("bound", F.lit(1))
    b = d.select("candidate_id", "task_id").join(tasks, "task_id", "left").groupBy("candidate_id").agg(F.count("bound").alias("n"))
    return b.agg(F.count("*").alias("candidates"), F.expr("count_if(n = 0)").alias("unbound"), F.expr("count_if(n > 1)").alias("bound_twice"))


@query("J29_paired_arms", f"""{D}, g AS (SELECT skill_id, scenario_id, bool_or({OK}) FILTER (WHERE arm = 'skill_condition') AS c, bool_or({OK}) FILTER (WHERE arm = 'null_condition') AS n FROM dc GROUP BY 1, 2)
  SELECT skill_id, count(*) FILTER (WHERE c AND n) AS "both", count(*) FILTER (WHERE c AND NOT n) AS condition_only, count(*) FILTER (WHERE n AND NOT c) AS control_only, count(*) FILTER (WHERE NOT c AND NOT n) AS neither FROM g WHERE c IS NOT NULL AND n IS NOT NULL GROUP BY 1""")
def j29(spark, sf):
    return dl.paired_arms(dec(spark, sf), ["scenario_id"])


@query("J31_raw_arm_choice", f"""{D}, {BAL}, w AS (SELECT task_id, count(*) AS want FROM bal GROUP BY 1), r AS (SELECT dc.*, want, row_number() OVER (PARTITION BY task_id ORDER BY {sha("'5'", 'task_id', 'candidate_id')}, candidate_id) AS n FROM dc JOIN w USING (task_id))
  SELECT task_id, candidate_id, coalesce(first_failed_stage, 'accepted') AS outcome FROM r WHERE n <= want""")
def j31(spark, sf):
    return dl.hash_choice(dec(spark, sf), delivered(spark, sf), 5)


@query("J33_task_table", f"""{SR} SELECT scenario_id, skill_id, seed_risk_metric, CASE WHEN skill_id LIKE 'A%' THEN responder_track_id ELSE initiator_track_id END AS target_track_id FROM sr""")
def j33(spark, sf):
    from roadsift.plans.tasks import build_tasks
    s = ad.seed_records(spark, sf).withColumn("role_track_ids", F.expr("map('first', initiator_track_id, 'second', responder_track_id)"))
    roles = s.select("skill_id").distinct().withColumn("primary_role", F.expr("IF(skill_id LIKE 'A%', 'second', 'first')"))
    tasks, _ = build_tasks(s, roles)
    return tasks.select("scenario_id", "skill_id", "seed_risk_metric", "target_track_id")


@query("J34_paired_control_tasks", f"""{SR} SELECT scenario_id, skill_id, seed_risk_metric, condition, arm FROM (SELECT scenario_id, skill_id, seed_risk_metric, unnest(CASE WHEN skill_id LIKE 'A%' THEN [skill_id, '<none>'] ELSE [skill_id] END) AS condition FROM sr) x,
  LATERAL (SELECT CASE WHEN condition = '<none>' THEN 'null_condition' ELSE 'skill_condition' END AS arm) y""")
def j34(spark, sf):
    from roadsift.plans.tasks import paired_tasks
    s = ad.seed_records(spark, sf).withColumn("learned", F.expr("skill_id LIKE 'A%'"))
    return paired_tasks(s).select("scenario_id", "skill_id", "seed_risk_metric", "condition", "arm")


@query("Q08_delivery_contract", f"{D}, {BAL}, {MF} SELECT count(*) - count(DISTINCT candidate_id) AS repeated, count(*) FILTER (WHERE scenario_id NOT IN (SELECT scenario_id FROM mf)) AS outside FROM bal")
def q08(spark, sf):
    d = delivered(spark, sf)
    out = d.join(ad.manifest(spark, sf), "scenario_id", "left_anti").agg(F.count("*").alias("outside"))
    return d.agg(F.expr("count(*) - count(DISTINCT candidate_id)").alias("repeated")).join(F.broadcast(out))


@query("X02_resume_state", f"""{D}, c AS (SELECT task_id, count(*) AS made FROM dc GROUP BY 1), d AS (SELECT task_id, count(*) AS decided, count(*) FILTER (WHERE {OK}) AS accepted FROM dc WHERE candidate_index <= 5 GROUP BY 1)
  SELECT task_id, CASE WHEN made < 2 THEN 'generate' WHEN coalesce(decided, 0) = 0 THEN 'filter' WHEN decided < made THEN 'finalise' WHEN accepted > 0 THEN 'completed' ELSE 'failed' END AS state FROM c LEFT JOIN d USING (task_id)""")
def x02(spark, sf):
    d = dec(spark, sf)
    return dl.resume_state(d.select("task_id").distinct(), d, d.where("candidate_index <= 5"), "2").select("task_id", "state")


@query("D05_cohort_finalisation", f"{D} SELECT skill_id, count(*) AS candidates, count(*) AS decided, CAST(0 AS BIGINT) AS undecided, CAST(0 AS BIGINT) AS decided_twice FROM dc GROUP BY 1")
def d05(spark, sf):
    from roadsift.funnel.decisions import one_decision_each
    d = dec(spark, sf)
    return one_decision_each(d.select("candidate_id", "skill_id"), d.where(OK).select("candidate_id").unionByName(d.where(f"NOT ({OK})").select("candidate_id")))
