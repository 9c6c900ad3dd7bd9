"""S and X operators: files are written from the driver tables, then read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadsift import adapters as ad
from roadsift.functions import formulas as fm
from roadsift.oracles import rules_sql as rs
from roadsift.plans import scene
from roadsift.plans.geometry_queries import BEST_SQL
from roadsift.plans.registry import query
from roadsift.plans.seeds_queries import DC, MF, SR
from roadsift.plans.tracks_queries import BASE, r, show
from roadsift.rules.catalog import RULES
from roadsift.session import materialize, shared_dir
from roadsift.sources import scenarios as sn, tables as tb
from roadsift.streaming import scan

R = fm.rounded
_PATHS: dict[tuple, str] = {}


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(spark, sf: str, name: str, write) -> str:
    """Path of a file set derived once per session and driver folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS:
        path = folder(spark, name)
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


#: Scenario folders that one task writes.
FOLDERS = 32


def spread(df):
    """Rows by folder, in as many tasks as the folders need: the bytes of a few folders say nothing of the time that files take."""
    folders = df.select("folder").distinct().count()
    return df.repartition(max(1, -(-folders // FOLDERS)), "folder")


def raw_files(spark, sf: str) -> str:
    """One folder per scenario with its track Parquet."""
    def write(path):
        s = scene.states(spark, sf)
        raw = s.selectExpr("scenario_id", "'city' AS city_name", "CAST(NULL AS STRING) AS focal_track_id", "observed", "track_id", "upper(object_type) AS object_type", "timestep", "x AS position_x",
                           "y AS position_y", "heading", "vx AS velocity_x", "vy AS velocity_y", "0L AS start_timestamp", "scenario_id AS folder")
        spread(raw).write.partitionBy("folder").parquet(path)
    return kept(spark, sf, "raw", write)


def map_files(spark, sf: str) -> str:
    """One JSON map per scenario: two lanes from the road table, one crossing, one area."""
    def write(path):
        b = lambda y: f"transform(sequence(0, 4), i -> struct(CAST(i * 10 AS DOUBLE) AS x, CAST({y} + i AS DOUBLE) AS y, 0D AS z))"
        seg = lambda i, y, l, r, p, n: (f"named_struct('id', {i}L, 'is_intersection', false, 'lane_type', 'VEHICLE', 'left_lane_boundary', {b(y + 2)}, 'right_lane_boundary', {b(y)}, 'left_lane_mark_type', 'NONE', "
                                        f"'right_lane_mark_type', 'NONE', 'left_neighbor_id', CAST({l} AS BIGINT), 'right_neighbor_id', CAST({r} AS BIGINT), 'predecessors', CAST(array({p}) AS ARRAY<BIGINT>), 'successors', CAST(array({n}) AS ARRAY<BIGINT>))")
        m = ad.scenario_ids(spark, sf).selectExpr(
            "scenario_id AS folder", f"map('1', {seg(1, 0, 2, 'NULL', '', '2')}, '2', {seg(2, 4, 'NULL', 1, '1', '')}) AS lane_segments",
            f"map('7', named_struct('id', 7L, 'edge1', {b(20)}, 'edge2', {b(24)})) AS pedestrian_crossings", f"map('9', named_struct('id', 9L, 'area_boundary', {b(30)})) AS drivable_areas")
        spread(m).write.partitionBy("folder").json(path)
    return kept(spark, sf, "maps", write)


@query("S01_read_scenarios", f"""{BASE}, t AS (SELECT scenario_id, track_id, max(timestep) AS last_t FROM st GROUP BY ALL) SELECT t.scenario_id, t.track_id, CAST(g.timestep AS INT) AS timestep, coalesce(st.observed, false) AS observed, {R('st.x')} AS x, {R('st.vx')} AS vx
  FROM t CROSS JOIN range(110) AS g(timestep) LEFT JOIN st ON st.scenario_id = t.scenario_id AND st.track_id = t.track_id AND st.timestep = g.timestep""")
def s01(spark, sf):
    d = sn.densify(sn.to_states(sn.read_raw(spark, raw_files(spark, sf)), 110), 110)
    return d.selectExpr("scenario_id", "track_id", "timestep", "observed", *r("x", "vx"))


@query("S02_history_prefix", f"{BASE} SELECT scenario_id, track_id, timestep, {show('x', 'y')} FROM st WHERE timestep < 50")
def s02(spark, sf):
    return sn.to_states(sn.read_raw(spark, raw_files(spark, sf)), 110, 50).selectExpr("scenario_id", "track_id", "timestep", *r("x", "y"))


@query("S03_pruned_scan", f"{BASE} SELECT scenario_id, track_id, object_type, count(*) AS frames, min(timestep) AS first_t, max(timestep) AS last_t, CAST(1 AS BIGINT) AS starts FROM st GROUP BY 1, 2, 3")
def s03(spark, sf):
    return sn.scan_statistics(spark, raw_files(spark, sf))


IDS = "WITH ids AS (SELECT DISTINCT CAST(CAST(floor(user_id / 10.0) AS BIGINT) AS VARCHAR) AS scenario_id FROM events)"


@query("S04_map_polylines", f"""{IDS}, k AS (SELECT unnest(range(40)) AS k), ln AS (SELECT * FROM (VALUES ('1', 0), ('2', 4)) AS l(lane, y0)), tp AS (SELECT * FROM (VALUES ('lane_centerline', 1), ('lane_boundary_left', 2), ('lane_boundary_right', 0)) AS t(polyline_type, dy))
  SELECT scenario_id, CASE WHEN polyline_type = 'lane_centerline' THEN lane ELSE lane || ':' || polyline_type END AS polyline_id, polyline_type, k, {R('k * 40 / 39::DOUBLE')} AS x, {R('y0 + dy + k * 4 / 39::DOUBLE')} AS y FROM ids, k, ln, tp
  UNION ALL SELECT scenario_id, 'crossing:7', 'pedestrian_crossing', k, {R('CASE WHEN k < 5 THEN k * 10 WHEN k < 10 THEN (9 - k) * 10 ELSE 0 END::DOUBLE')}, {R('CASE WHEN k < 5 THEN 20 + k WHEN k < 10 THEN 24 + 9 - k ELSE 20 END::DOUBLE')} FROM ids, k WHERE k < 11
  UNION ALL SELECT scenario_id, 'area:9', 'drivable_area', k, {R('CASE WHEN k < 5 THEN k * 10 ELSE 0 END::DOUBLE')}, {R('CASE WHEN k < 5 THEN 30 + k ELSE 30 END::DOUBLE')} FROM ids, k WHERE k < 6""")
def s04(spark, sf):
    p = sn.map_polylines(sn.read_maps(spark, map_files(spark, sf))).selectExpr("scenario_id", "polyline_id", "polyline_type", "posexplode(points) AS (k, p)")
    return p.selectExpr("scenario_id", "polyline_id", "polyline_type", "CAST(k AS BIGINT) AS k", f"{R('p.x')} AS x", f"{R('p.y')} AS y")


@query("S05_pair_files", f"{IDS} SELECT scenario_id, true AS has_map, CAST(NULL AS VARCHAR) AS problem FROM ids")
def s05(spark, sf):
    paths = lambda root, glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    p = sn.pair_files(paths(raw_files(spark, sf), "*.parquet"), paths(map_files(spark, sf), "*.json"))
    return p.withColumn("scenario_id", F.expr("regexp_replace(scenario_id, '^folder=', '')")).selectExpr("scenario_id", "map_path IS NOT NULL AS has_map", "problem")


@query("S06_manifest_csv", f"WITH {MF} SELECT * FROM mf")
def s06(spark, sf):
    path = kept(spark, sf, "manifest", lambda p: tb.write_manifest(ad.manifest(spark, sf), p))
    return tb.read_manifest(spark, path)


def seed_csv(spark, sf):
    def write(path):
        s = ad.seed_records(spark, sf).withColumns({"role_track_ids": F.expr("map('first', initiator_track_id, 'second', responder_track_id, 'metric', seed_risk_metric)"), "source_path": F.expr("concat('s/', scenario_id)")})
        tb.write_seed_records(s, path)
    return kept(spark, sf, "seeds", write)


@query("S07_seed_csv_sink", f"{SR} SELECT count(*) AS rows, count(DISTINCT scenario_id) AS scenarios FROM sr")
def s07(spark, sf):
    return tb.read_seed_records(spark, seed_csv(spark, sf))[0].agg(F.count("*").alias("rows"), F.count_distinct("scenario_id").alias("scenarios"))


@query("S08_seed_csv_source", f"{SR} SELECT scenario_id, skill_id, seed_risk_metric, {R('seed_risk_value', 4)} AS seed_risk_value, initiator_track_id AS first_role, {R('trigger_score', 4)} AS trigger_score FROM sr")
def s08(spark, sf):
    good, _ = tb.read_seed_records(spark, seed_csv(spark, sf))
    return good.selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"{R('seed_risk_value', 4)} AS seed_risk_value", "role_track_ids['first'] AS first_role", f"{R('trigger_score', 4)} AS trigger_score")


@query("S09_candidate_store", f"WITH {DC} SELECT skill_id, count(*) AS candidates, count(DISTINCT task_id) AS tasks FROM dc GROUP BY 1")
def s09(spark, sf):
    path = kept(spark, sf, "candidates", lambda p: tb.write_candidates(ad.filter_decisions(spark, sf).select("candidate_id", "task_id", "skill_id", "candidate_index", "target_track_id"), p))
    return spark.read.parquet(path).groupBy("skill_id").agg(F.count("*").alias("candidates"), F.count_distinct("task_id").alias("tasks"))


def decision_index(spark, sf):
    def write(path):
        # written once: the candidates, the check and the index read it, none of them numbers the rows anew
        d = materialize(ad.filter_decisions(spark, sf).select("candidate_id", "task_id", "skill_id", "first_failed_stage", "reason", "quality_score"), "decision-rows")
        tb.write_decisions(d.select("candidate_id"), d, path)
    return kept(spark, sf, "decisions", write)


@query("S10_decision_index", f"WITH {DC} SELECT candidate_id, skill_id, CASE WHEN first_failed_stage IS NULL THEN 'accepted' ELSE 'rejected' END AS disposition FROM dc")
def s10(spark, sf):
    return spark.read.parquet(decision_index(spark, sf)).select("candidate_id", "skill_id", "disposition")


@query("S11_skill_decision_index", f"WITH {DC} SELECT CASE WHEN first_failed_stage IS NULL THEN 'accepted' ELSE 'rejected' END AS disposition, count(*) AS rows FROM dc WHERE skill_id = 's3' GROUP BY 1")
def s11(spark, sf):
    return spark.read.parquet(decision_index(spark, sf)).where("skill_id = 's3'").groupBy("disposition").agg(F.count("*").alias("rows"))


@query("S12_corpus_check", f"WITH {MF}, ids AS (SELECT DISTINCT CAST(CAST(floor(user_id / 10.0) AS BIGINT) AS VARCHAR) AS scenario_id FROM events) SELECT scenario_id, 'missing' AS problem FROM mf WHERE scenario_id NOT IN (SELECT scenario_id FROM ids)")
def s12(spark, sf):
    return sn.corpus_check(spark, ad.manifest(spark, sf), raw_files(spark, sf), "*.parquet")


@query("X01_incremental_scan", rs.finish(rs.build()["slow_lead_blockage"], "slow_lead_blockage", "vehicle", True))
def x01(spark, sf):
    out = scan.run(spark, raw_files(spark, sf), scene.roads(spark, sf), folder(spark, "scan"), [RULES["slow_lead_blockage"]], files_per_batch=1000)
    return spark.read.parquet(out).selectExpr("scenario_id", "skill_id", "initiator", "responder", "extra", f"{R('score')} AS score", "risk_metric", f"{R('risk_value')} AS risk_value")


@query("X01b_incremental_scan_of_all_rules", BEST_SQL)
def x01b(spark, sf):
    out = scan.run(spark, raw_files(spark, sf), scene.roads(spark, sf), folder(spark, "scan"), list(RULES.values()), files_per_batch=1000)
    return spark.read.parquet(out).selectExpr("scenario_id", "skill_id", "initiator", "responder", "extra", f"{R('score')} AS score", "risk_metric", f"{R('risk_value')} AS risk_value")
