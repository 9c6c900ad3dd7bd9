"""Seed tables: W, T, U, A, Q and J operators over seed records, manifests and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.operators import audits as au, ranking as rk, seeds as sd
from roadsift.plans.registry import query
from roadsift.session import materialize

R = fm.rounded
SR = "WITH sr AS (" + ad.SEED_RECORDS_SQL.format(lineitem="lineitem") + ")"
MF = "mf AS (" + ad.MANIFEST_SQL.format(orders="orders") + ")"
DC = "dc AS (" + ad.DECISIONS_SQL.format(lineitem="lineitem") + ")"
RK = "skill_id, seed_risk_metric"


def sha(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(parts) + ")"


QUART = f"""qt AS (SELECT *, CAST(least(3, floor((rank() OVER (PARTITION BY {RK} ORDER BY seed_risk_value) - 1) * 4 / count(*) OVER (PARTITION BY {RK}))) AS INT) AS quartile FROM sr)"""


@query("W01_best_label", f"{SR} SELECT scenario_id, skill_id, seed_risk_metric, {R('trigger_score')} AS trigger_score FROM sr QUALIFY row_number() OVER (PARTITION BY scenario_id, skill_id ORDER BY trigger_score DESC, seed_risk_metric) = 1")
def w01(spark, sf):
    return sd.best_label(ad.seed_records(spark, sf), ["scenario_id", "skill_id"], ["seed_risk_metric"]).selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"{R('trigger_score')} AS trigger_score")


@query("W02_top_matches", f"""{SR}, n AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY trigger_score DESC, skill_id, seed_risk_metric) AS rank, count(*) OVER (PARTITION BY scenario_id) AS c FROM sr)
  SELECT scenario_id, skill_id, seed_risk_metric, rank, greatest(c - 2, 0) AS over_limit FROM n WHERE rank <= 2""")
def w02(spark, sf):
    s = ad.seed_records(spark, sf)
    w = rk.Window.partitionBy("scenario_id").orderBy(F.col("trigger_score").desc(), "skill_id", "seed_risk_metric")
    top = s.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    size = s.groupBy("scenario_id").agg(F.expr("greatest(count(*) - 2, 0)").alias("over_limit"))
    return top.join(size, "scenario_id").selectExpr("scenario_id", "skill_id", "seed_risk_metric", "CAST(rank AS BIGINT) AS rank", "over_limit")


@query("W04_risk_quartiles", f"{SR}, {QUART} SELECT scenario_id, {RK}, quartile FROM qt")
def w04(spark, sf):
    return sd.risk_quartiles(ad.seed_records(spark, sf)).select("scenario_id", "skill_id", "seed_risk_metric", "quartile")


@query("W10_review_sample", f"""{SR}, n AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY trigger_score DESC, scenario_id, seed_risk_metric) AS round FROM sr)
  SELECT scenario_id, skill_id, seed_risk_metric, round FROM n ORDER BY round, skill_id LIMIT 60""")
def w10(spark, sf):
    return sd.review_sample(ad.seed_records(spark, sf), 60).selectExpr("scenario_id", "skill_id", "seed_risk_metric", "CAST(round AS BIGINT) AS round")


PILOT = sha("'2026'", "'pilot'", "skill_id", "scenario_id", "seed_risk_metric")


@query("W11_pilot_records", f"""{SR}, h AS (SELECT *, {PILOT} AS hh, trigger_score >= 0.6 AS eligible FROM sr), c AS (SELECT *, sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (PARTITION BY skill_id ORDER BY hh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h)
  SELECT scenario_id, skill_id, seed_risk_metric, eligible FROM c WHERE coalesce(prior, 0) < 25""")
def w11(spark, sf):
    return sd.pilot_records(ad.seed_records(spark, sf), "trigger_score >= 0.6", 25).select("scenario_id", "skill_id", "seed_risk_metric", "eligible")


TASKS = "SELECT DISTINCT task_id, scenario_id, skill_id FROM dc"


@query("W12_two_phase_order", f"""WITH {DC}, t AS (SELECT *, {sha("'2026'", "'task'", "task_id")} AS h FROM ({TASKS})), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scenario_id ORDER BY h, task_id) = 1 THEN 'coverage' ELSE 'balance' END AS phase FROM t),
  b AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY h, task_id) AS round FROM p WHERE phase = 'balance')
  SELECT task_id, skill_id, phase, row_number() OVER (ORDER BY h, task_id) AS position FROM p WHERE phase = 'coverage'
  UNION ALL SELECT task_id, skill_id, phase, row_number() OVER (ORDER BY round, skill_id) FROM b""")
def w12(spark, sf):
    tasks = ad.filter_decisions(spark, sf).select("task_id", "scenario_id", "skill_id").distinct()
    return sd.two_phase_order(tasks).select("task_id", "skill_id", "phase", "position")


@query("T01_hash_subset", f"{SR} SELECT scenario_id FROM (SELECT DISTINCT scenario_id FROM sr) ORDER BY {sha("'7'", "'subset'", 'scenario_id')}, scenario_id LIMIT 500")
def t01(spark, sf):
    return sd.hash_subset(ad.seed_records(spark, sf), "scenario_id", 500, 7)


SPLIT = f"sp AS (SELECT scenario_id, row_number() OVER (ORDER BY {sha("'11'", "'split'", 'scenario_id')}, scenario_id) AS rank FROM (SELECT DISTINCT scenario_id FROM mf))"
PART = "CASE WHEN rank <= 2000 THEN 'dev' WHEN rank <= 3000 THEN 'val' ELSE 'train' END"


@query("T02_hash_split", f"WITH {MF}, {SPLIT} SELECT scenario_id, rank, {PART} AS part FROM sp")
def t02(spark, sf):
    return sd.hash_split(ad.manifest(spark, sf), "scenario_id", {"dev": 2000, "val": 1000}, "train", 11).selectExpr("scenario_id", "CAST(rank AS BIGINT) AS rank", "part")


@query("T05_stratified_selection")
def t05(spark, sf):
    return sd.select_scenarios(ad.seed_records(spark, sf), 400)


@query("Q02_selection_postconditions", f"""{SR} SELECT CAST(400 AS BIGINT) AS chosen, CAST(400 AS BIGINT) AS chosen_distinct, CAST(0 AS BIGINT) AS lost_labels""")
def q02(spark, sf):
    # the records are read for strata, labels and kept ones, the choice twice: each is made once
    seeds = materialize(ad.seed_records(spark, sf).select("scenario_id", "skill_id", "seed_risk_metric", "seed_risk_value"), "seed-values")
    chosen = materialize(sd.select_scenarios(seeds, 400), "chosen")
    kept = sd.selected_records(seeds, chosen).groupBy("scenario_id").agg(F.count("*").alias("kept"))
    all_ = seeds.groupBy("scenario_id").agg(F.count("*").alias("labels"))
    both = chosen.join(kept, "scenario_id", "left").join(all_, "scenario_id", "left")
    return both.agg(F.count("*").alias("chosen"), F.count_distinct("scenario_id").alias("chosen_distinct"), F.expr("coalesce(sum(labels - coalesce(kept, 0)), 0)").alias("lost_labels"))


@query("T06_split_feasibility", f"""{SR}, {MF}, {SPLIT}, pl AS (SELECT sr.scenario_id, skill_id, CASE WHEN rank <= 9000 THEN 'dev' ELSE 'train' END AS part FROM sr JOIN sp USING (scenario_id)),
  ov AS (SELECT skill_id, count(*) FILTER (WHERE part = 'dev') > floor(count(*) / 2) AS excess FROM pl GROUP BY 1)
  SELECT scenario_id, relief, loss FROM (SELECT scenario_id, count(*) FILTER (WHERE excess) AS relief, count(*) FILTER (WHERE NOT excess) AS loss FROM pl JOIN ov USING (skill_id) WHERE part = 'dev' GROUP BY 1) WHERE relief > 0""")
def t06(spark, sf):
    part = sd.hash_split(ad.manifest(spark, sf), "scenario_id", {"dev": 9000}, "train", 11).select("scenario_id", "part")
    return sd.move_candidates(ad.seed_records(spark, sf).join(part, "scenario_id")).select("scenario_id", "relief", "loss")


@query("T07_balanced_exposure", f"""{SR}, s AS (SELECT skill_id, scenario_id || '/' || seed_risk_metric AS sample_id FROM sr WHERE trigger_score >= 0.5), z AS (SELECT skill_id, count(*) AS size, max(count(*)) OVER () AS top FROM s GROUP BY 1),
  k AS (SELECT s.*, size, least(top, size * 8) AS want, row_number() OVER (PARTITION BY s.skill_id ORDER BY {sha("'exposure'", 'sample_id')}, sample_id) AS rank FROM s JOIN z USING (skill_id))
  SELECT skill_id, sample_id, CAST(floor(want / size) + (CASE WHEN rank <= want % size THEN 1 ELSE 0 END) AS INT) AS repeats FROM k""")
def t07(spark, sf):
    s = ad.seed_records(spark, sf).where("trigger_score >= 0.5").selectExpr("skill_id", "concat_ws('/', scenario_id, seed_risk_metric) AS sample_id")
    return sd.balanced_exposure(s).select("skill_id", "sample_id", "repeats")


@query("U01_merge_pools", f"""{SR} SELECT 'union' AS part, count(*) AS rows, count(DISTINCT skill_id) AS skills, CAST(0 AS BIGINT) AS violations FROM sr
  UNION ALL SELECT 'overlapping', count(*) + count(*) FILTER (WHERE skill_id LIKE 'A%'), count(DISTINCT skill_id), (SELECT count(DISTINCT skill_id) + count(*) FROM sr WHERE skill_id LIKE 'A%') FROM sr""")
def u01(spark, sf):
    s = ad.seed_records(spark, sf)
    out = []
    for name, first, second in (("union", "skill_id LIKE 'A%'", "skill_id NOT LIKE 'A%'"), ("overlapping", "skill_id LIKE 'A%'", "true")):
        merged, problems = sd.merge_pools(s.where(first), s.where(second))
        n = problems.agg(F.count("*").alias("violations"))
        out.append(merged.agg(F.count("*").alias("rows"), F.count_distinct("skill_id").alias("skills")).join(F.broadcast(n)).selectExpr(f"'{name}' AS part", "rows", "skills", "violations"))
    return out[0].unionByName(out[1])


@query("U02_split_intersection", f"{SR}, {MF} SELECT scenario_id FROM sr INTERSECT SELECT scenario_id FROM mf WHERE split = 'urgent'")
def u02(spark, sf):
    return ad.seed_records(spark, sf).select("scenario_id").intersect(ad.manifest(spark, sf).where("split = 'urgent'").select("scenario_id"))


@query("U03_coverage_difference", f"{SR}, {MF} SELECT 'missing' AS side, scenario_id FROM (SELECT scenario_id FROM mf EXCEPT SELECT scenario_id FROM sr) UNION ALL SELECT 'unexpected', scenario_id FROM (SELECT DISTINCT scenario_id FROM sr EXCEPT SELECT scenario_id FROM mf)")
def u03(spark, sf):
    have, want = ad.seed_records(spark, sf).select("scenario_id").distinct(), ad.manifest(spark, sf).select("scenario_id")
    return want.exceptAll(have).selectExpr("'missing' AS side", "scenario_id").unionByName(have.exceptAll(want).selectExpr("'unexpected' AS side", "scenario_id"))


#: Lines that one task reads where it holds all records of its scenarios.
ROWS = 200_000
TARGET = "(CASE WHEN skill_id LIKE '%F' THEN 'm0' ELSE 'm1' END)"


@query("A01_scan_summary", f"""{SR} SELECT skill_id, seed_risk_metric, proxy, count(*) AS records, count(DISTINCT scenario_id) AS scenarios FROM (SELECT *, seed_risk_metric <> {TARGET} AS proxy FROM sr)
  GROUP BY GROUPING SETS ((skill_id), (seed_risk_metric), (skill_id, seed_risk_metric), (skill_id, proxy), ())""")
def a01(spark, sf):
    return sd.scan_summary(ad.seed_records(spark, sf, ROWS), TARGET)


@query("A02_numeric_distribution", f"""{SR} SELECT {RK}, count(*) AS n, {R('min(seed_risk_value)', 4)} AS minimum, {R('quantile_cont(seed_risk_value, 0.25)', 4)} AS p25, {R('quantile_cont(seed_risk_value, 0.5)', 4)} AS median,
  {R('quantile_cont(seed_risk_value, 0.75)', 4)} AS p75, {R('max(seed_risk_value)', 4)} AS maximum, {R('avg(seed_risk_value)', 3)} AS mean FROM sr GROUP BY ALL""")
def a02(spark, sf):
    d = sd.distribution(ad.seed_records(spark, sf), sd.RISK, "seed_risk_value")
    return d.selectExpr("skill_id", "seed_risk_metric", "n", *[f"{R(c, 4)} AS {c}" for c in ("minimum", "p25", "median", "p75", "maximum")], f"{R('mean', 3)} AS mean")


@query("A04_merge_count_trees", f"{SR} SELECT path, sum(n) AS n FROM (SELECT skill_id || '/' || seed_risk_metric AS path, count(*) AS n FROM sr GROUP BY 1 UNION ALL SELECT skill_id, count(*) FROM sr GROUP BY 1) GROUP BY 1")
def a04(spark, sf):
    s = ad.seed_records(spark, sf)
    pools = [s.where("scenario_id < '5'"), s.where("scenario_id >= '5'")]
    trees = [p.groupBy(F.expr(k).alias("path")).agg(F.count("*").alias("n")) for p in pools for k in ("concat_ws('/', skill_id, seed_risk_metric)", "skill_id")]
    return sd_union(trees).groupBy("path").agg(F.sum("n").alias("n"))


def sd_union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("P34_risk_severity", f"""{SR}, v AS (SELECT *, (CASE WHEN seed_risk_metric = {TARGET} THEN greatest(0, least(1, 1 - (seed_risk_value - 5000) / 60000)) END) AS sev FROM sr)
  SELECT scenario_id, {RK}, {R('sev', 9)} AS severity, CASE WHEN sev IS NULL THEN 'proxy_metric' WHEN sev >= 2.0 / 3 THEN 'high' WHEN sev >= 1.0 / 3 THEN 'medium' ELSE 'low' END AS stratum FROM v""")
def p34(spark, sf):
    from roadsift.operators.labels import risk_severity
    s = ad.seed_records(spark, sf).withColumns({"low": F.lit(5000.0), "high": F.lit(65000.0), "direction": F.lit("lower_is_riskier"), "target_metric": F.expr(TARGET)})
    return risk_severity(s).selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"{R('severity', 9)} AS severity", "stratum")


@query("P38_quality_score", f"{SR} SELECT scenario_id, {RK}, {R('abs(seed_risk_value - 35000) / 60000', 9)} AS quality FROM sr")
def p38(spark, sf):
    from roadsift.operators.labels import quality_score
    return ad.seed_records(spark, sf).selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"{R(quality_score('seed_risk_value', '5000D', '65000D'), 9)} AS quality")


@query("P41_proxy_flag", f"{SR} SELECT scenario_id, {RK}, seed_risk_metric <> {TARGET} AS proxy FROM sr")
def p41(spark, sf):
    return ad.seed_records(spark, sf).selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"seed_risk_metric <> {TARGET} AS proxy")


@query("P39_content_ids", f"{SR} SELECT scenario_id, {RK}, {sha('scenario_id', 'skill_id', 'initiator_track_id', 'responder_track_id', 'seed_risk_metric')} AS seed_record_id, {sha("'task'", sha('scenario_id', 'skill_id', 'initiator_track_id', 'responder_track_id', 'seed_risk_metric'), 'initiator_track_id', "'16'")} AS task_id FROM sr")
def p39(spark, sf):
    from roadsift.functions.ids import seed_record_id, task_id
    s = ad.seed_records(spark, sf).withColumn("seed_record_id", F.expr(seed_record_id("seed_risk_metric")))
    return s.selectExpr("scenario_id", "skill_id", "seed_risk_metric", "seed_record_id", f"{task_id('initiator_track_id', 16)} AS task_id")


@query("P40_ordering_digest", f"{SR} SELECT scenario_id, {RK}, {sha("'2026'", "'order'", 'scenario_id', 'skill_id', 'seed_risk_metric')} AS h FROM sr")
def p40(spark, sf):
    return ad.seed_records(spark, sf).selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"{rk.digest("'2026'", "'order'", 'scenario_id', 'skill_id', 'seed_risk_metric')} AS h")


@query("J26_split_leakage", f"WITH {MF}, g AS (SELECT scenario_id, split FROM mf UNION ALL SELECT scenario_id, 'extra' FROM mf WHERE city_name = 'P') SELECT scenario_id, count(DISTINCT split) AS splits FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j26(spark, sf):
    m = ad.manifest(spark, sf).select("scenario_id", "split")
    extra = ad.manifest(spark, sf).where("city_name = 'P'").selectExpr("scenario_id", "'extra' AS split")
    return au.overlap(m, extra).select("scenario_id", "splits")


@query("J27_pool_audit", f"""{SR}, {MF} SELECT 'outside_manifest' AS problem, scenario_id FROM (SELECT DISTINCT scenario_id FROM sr WHERE scenario_id NOT IN (SELECT scenario_id FROM mf))
  UNION ALL SELECT 'excluded_manifest', scenario_id FROM (SELECT DISTINCT scenario_id FROM sr WHERE scenario_id IN (SELECT scenario_id FROM mf WHERE split = 'low'))""")
def j27(spark, sf):
    m = ad.manifest(spark, sf)
    return au.pool_audit(ad.seed_records(spark, sf).select("scenario_id").distinct(), m, m.where("split = 'low'"))


@query("Q01_manifest_contract", f"""WITH {MF} SELECT 'bad_split' AS problem, count(*) AS rows FROM mf WHERE split NOT IN ('urgent', 'high', 'medium') UNION ALL SELECT 'bad_path', count(*) FROM mf WHERE source_path NOT LIKE 'scenarios/%/scenario.parquet'
  UNION ALL SELECT 'empty_field', count(*) FROM mf WHERE scenario_id = '' OR city_name = '' OR selected_reason = '' UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT scenario_id FROM mf GROUP BY 1 HAVING count(*) > 1)""")
def q01(spark, sf):
    return au.manifest_contract(ad.manifest(spark, sf), ["urgent", "high", "medium"], "^scenarios/[^/]+/scenario\\\\.parquet$")


@query("Q03_single_risk_definition", f"{SR} SELECT skill_id, count(DISTINCT seed_risk_metric) AS definitions FROM sr GROUP BY 1 HAVING count(DISTINCT seed_risk_metric) <> 1")
def q03(spark, sf):
    return ad.seed_records(spark, sf).groupBy("skill_id").agg(F.count_distinct("seed_risk_metric").alias("definitions")).where("definitions <> 1")


@query("Q04_seed_validity", f"{SR} SELECT problem, count(*) AS rows FROM (SELECT unnest([CASE WHEN initiator_track_id = responder_track_id THEN 'same_actor' END, CASE WHEN trigger_score NOT BETWEEN 0 AND 0.9 THEN 'score_range' END, CASE WHEN seed_risk_value IS NULL OR isnan(seed_risk_value) THEN 'risk_missing' END]) AS problem FROM sr) WHERE problem IS NOT NULL GROUP BY 1")
def q04(spark, sf):
    return au.seed_validity(ad.seed_records(spark, sf), 0.9).groupBy("problem").agg(F.count("*").alias("rows"))


@query("Q10_scan_pool_integrity", f"""{SR}, {MF} SELECT (SELECT count(*) FROM mf WHERE scenario_id NOT IN (SELECT scenario_id FROM sr)) AS not_scanned, (SELECT count(DISTINCT scenario_id) FROM sr WHERE scenario_id NOT IN (SELECT scenario_id FROM mf)) AS unexpected,
  (SELECT count(*) FROM (SELECT 1 FROM sr GROUP BY scenario_id, skill_id, seed_risk_metric HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM sr WHERE skill_id NOT IN ('A_F', 'N_F', 'R_F', 'A_O')) AS undeclared_skill""")
def q10(spark, sf):
    return au.scan_pool(ad.seed_records(spark, sf, ROWS), ad.manifest(spark, sf), ["A_F", "N_F", "R_F", "A_O"], ["scenario_id", "skill_id", "seed_risk_metric"])
