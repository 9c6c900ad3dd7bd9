"""CSV and Parquet sinks and sources of manifests, seed records, candidates and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.session import materialize

MANIFEST = "scenario_id STRING, split STRING, source_path STRING, city_name STRING, selected_reason STRING"
SEED_CSV = ("scenario_id STRING, skill_id STRING, initiator_track_id STRING, responder_track_id STRING, role_track_ids STRING, trigger_score DOUBLE, seed_risk_metric STRING, "
            "seed_risk_value DOUBLE, source_path STRING, bad STRING")
SEED_KEY = ["scenario_id", "skill_id", "initiator_track_id", "responder_track_id", "role_track_ids"]
CSV = {"header": "true", "escape": '"'}


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Header names must match the schema exactly."""
    return spark.read.schema(MANIFEST).options(**CSV).option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def repeats(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key occurs twice: hashes are counted first, the keys themselves only where hashes meet."""
    hashed = df.select(F.xxhash64(*keys).alias("h"), *keys)
    met = hashed.groupBy("h").count().where("count > 1").select("h")
    return not met.isEmpty() and not hashed.join(met, "h", "left_semi").groupBy(*keys).count().where("count > 1").isEmpty()


def write_seed_records(df: DataFrame, path: str) -> None:
    """JSON text columns, sorted by the unique key; repeated keys are an error."""
    flat = materialize(df.withColumn("role_track_ids", F.expr("to_json(role_track_ids)")), "seed-records")   # read by the check, the ranges of the sort, and the sort
    if repeats(flat, SEED_KEY):
        raise ValueError("seed records repeat a key")
    names = [c.split()[0] for c in SEED_CSV.split(", ") if not c.startswith("bad")]
    flat.select(*names).orderBy(*SEED_KEY, "seed_risk_metric").write.mode("overwrite").options(**CSV).csv(path)


def read_seed_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid records and the quarantine of unreadable ones with their file."""
    raw = spark.read.schema(SEED_CSV).options(**CSV).option("columnNameOfCorruptRecord", "bad").csv(path).withColumn("file", F.col("_metadata.file_path"))
    raw = raw.withColumn("roles", F.from_json("role_track_ids", "MAP<STRING, STRING>", {"mode": "PERMISSIVE"}))
    broken = "bad IS NOT NULL OR roles IS NULL OR scenario_id IS NULL OR trigger_score IS NULL OR trigger_score NOT BETWEEN 0 AND 1 OR seed_risk_value IS NULL"
    good = raw.where(f"NOT ({broken})").drop("bad", "file", "role_track_ids").withColumnRenamed("roles", "role_track_ids")
    return good, raw.where(broken).select("scenario_id", "skill_id", "file")


def write_candidates(df: DataFrame, path: str) -> None:
    """Raw candidates by skill; a repeated id is an error."""
    if not df.groupBy("candidate_id").count().where("count > 1").isEmpty():
        raise ValueError("candidate ids repeat")
    df.write.mode("overwrite").partitionBy("skill_id").parquet(path)


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without decision and decisions without candidate."""
    c, d = (x.select("candidate_id").withColumn(n, F.lit(True)) for x, n in ((candidates, "c"), (decisions, "d")))
    return c.join(d, "candidate_id", "full_outer").where("c IS NULL OR d IS NULL")


def write_decisions(candidates: DataFrame, decisions: DataFrame, path: str) -> None:
    """Index of exactly one decision per candidate, by skill and disposition, without trajectories."""
    if not undecided(candidates, decisions).isEmpty():
        raise ValueError("candidates and decisions do not match")
    slim = decisions.withColumn("disposition", F.expr("IF(first_failed_stage IS NULL, 'accepted', 'rejected')"))
    slim.write.mode("overwrite").partitionBy("skill_id", "disposition").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "scenario_id") -> None:
    """Co-located storage: joins and windows on the bucket key then need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
