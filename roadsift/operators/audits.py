"""Contracts as queries: every audit returns violating rows or per-key violation counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from roadsift.rules.catalog import RULES


def role_contract(seeds: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per record: number of roles, required roles missing or unexpected, role tracks not in the scenario."""
    need = "CASE " + " ".join("WHEN skill_id = '{}' THEN array({})".format(r.skill_id, ", ".join(f"'{x}'" for x in r.roles)) for r in RULES.values()) + " END"
    flat = seeds.selectExpr("scenario_id", "skill_id", f"{need} AS need", "role_track_ids").selectExpr(
        "scenario_id", "skill_id", "size(role_track_ids) AS roles",
        "size(array_except(need, map_keys(role_track_ids))) + size(array_except(map_keys(role_track_ids), need)) AS missing", "explode(map_values(role_track_ids)) AS track_id")
    known = tracks.withColumn("known", F.lit(1))
    return flat.join(known, ["scenario_id", "track_id"], "left").groupBy("scenario_id", "skill_id").agg(
        F.max("roles").cast("long").alias("roles"), F.max("missing").cast("long").alias("missing"), F.expr("count_if(known IS NULL)").alias("unknown_tracks"))


def overlap(*groups: DataFrame) -> DataFrame:
    """Scenarios that occur in more than one of the named splits (columns scenario_id, split)."""
    rows = reduce(DataFrame.unionByName, groups)
    return rows.groupBy("scenario_id").agg(F.count_distinct("split").alias("splits"), F.sort_array(F.collect_set("split")).alias("names")).where("splits > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count of NaN and infinite values per numeric column in one pass."""
    bad = [F.expr(f"count_if(isnan({c}) OR abs({c}) = double('infinity'))").alias(c) for c in columns]
    return df.agg(*bad).selectExpr("stack({}, {}) AS (column_name, bad)".format(len(columns), ", ".join(f"'{c}', {c}" for c in columns)))


def pool_audit(pool: DataFrame, manifest: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scenarios of a pool outside the allowed manifest or inside an excluded one."""
    outside = pool.join(manifest, "scenario_id", "left_anti").selectExpr("'outside_manifest' AS problem", "scenario_id")
    return outside.unionByName(pool.join(excluded, "scenario_id", "left_semi").selectExpr("'excluded_manifest' AS problem", "scenario_id"))


def manifest_contract(manifest: DataFrame, splits: list[str], path: str) -> DataFrame:
    """Violations per rule: unexpected split, non-canonical path, empty field, repeated id."""
    allowed = ", ".join(f"'{s}'" for s in splits)
    one = manifest.agg(F.expr(f"count_if(split NOT IN ({allowed}))").alias("bad_split"), F.expr(f"count_if(NOT source_path RLIKE '{path}')").alias("bad_path"),
                       F.expr("count_if(scenario_id = '' OR city_name = '' OR selected_reason = '')").alias("empty_field"))
    rows = one.selectExpr("stack(3, 'bad_split', bad_split, 'bad_path', bad_path, 'empty_field', empty_field) AS (problem, rows)")
    return rows.unionByName(duplicate_keys(manifest, ["scenario_id"]).agg(F.count("*").alias("rows")).selectExpr("'duplicate_id' AS problem", "rows"))


def seed_validity(seeds: DataFrame, top: float = 1.0) -> DataFrame:
    return seeds.withColumn("problem", F.expr(
        "explode(array_compact(array(IF(initiator_track_id = responder_track_id, 'same_actor', NULL), "
        f"IF(trigger_score NOT BETWEEN 0 AND {top}, 'score_range', NULL), IF(seed_risk_value IS NULL OR isnan(seed_risk_value), 'risk_missing', NULL))))"))


def scan_pool(pool: DataFrame, manifest: DataFrame, skills: list[str], keys: list[str]) -> DataFrame:
    """Completeness of a scan: manifest scenarios without a scan, unexpected ones, repeated keys, undeclared skills."""
    # one pass: whatever the number of checks, each scenario of either side is one row of one join
    once = pool.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(F.when(~F.col("skill_id").isin(skills), 1)).alias("odd"))
    ids = once.groupBy("scenario_id").agg(F.expr("count_if(rows > 1)").alias("repeated"), F.sum("odd").alias("odd"))
    wanted = manifest.groupBy("scenario_id").agg(F.count("*").alias("listed"))
    both = ids.join(wanted, "scenario_id", "full_outer")
    total = lambda e: f"coalesce(sum({e}), 0L)"
    return both.agg(F.expr(total("CASE WHEN repeated IS NULL THEN listed END")).alias("not_scanned"), F.expr("count_if(listed IS NULL)").alias("unexpected"),
                    F.expr(total("repeated")).alias("duplicates"), F.expr(total("odd")).alias("undeclared_skill"))
