"""Scenario files: raw track Parquet, map JSON, pairing and completeness of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.operators import polylines as pl

RAW_SCHEMA = ("scenario_id STRING, city_name STRING, focal_track_id STRING, observed BOOLEAN, track_id STRING, object_type STRING, timestep INT, position_x DOUBLE, position_y DOUBLE, "
              "heading DOUBLE, velocity_x DOUBLE, velocity_y DOUBLE, start_timestamp BIGINT")
SCAN_COLUMNS = ["scenario_id", "track_id", "object_type", "timestep", "position_x", "position_y", "heading", "velocity_x", "velocity_y", "start_timestamp"]
PERIOD_NS = 100_000_000


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All scenario files of a folder in one scan, with the file each row came from."""
    return spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(root).withColumn("source_path", F.col("_metadata.file_path"))


def to_states(raw: DataFrame, total: int, history: int | None = None) -> DataFrame:
    """`track_states` with NULL for missing values; the frame filter reaches the Parquet scan."""
    raw = raw.where((F.col("timestep") >= 0) & (F.col("timestep") < (total if history is None else history)))
    num = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
    return raw.selectExpr("scenario_id", "track_id", "lower(object_type) AS object_type", "timestep", "observed", "timestep * 0.1D AS time_s", f"{num('position_x')} AS x", f"{num('position_y')} AS y",
                          f"{num('velocity_x')} AS vx", f"{num('velocity_y')} AS vy", f"{num('heading')} AS heading")


def densify(states: DataFrame, total: int) -> DataFrame:
    """Every track on every frame 0..total-1; absent frames have NULL state and are not observed."""
    tracks = states.groupBy("scenario_id", "track_id", "object_type").agg(F.max("timestep").alias("last_t"))
    grid = tracks.selectExpr("scenario_id", "track_id", "object_type", f"explode(sequence(0, {total - 1})) AS timestep")
    s = states.drop("object_type")
    return grid.join(s, ["scenario_id", "track_id", "timestep"], "left").withColumn("observed", F.expr("coalesce(observed, false)"))


def scan_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Pruned scan of the needed columns: frames, span and start-stamp consistency per track."""
    raw = spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(root).select(*SCAN_COLUMNS)
    return raw.groupBy("scenario_id", "track_id", F.lower("object_type").alias("object_type")).agg(
        F.count("*").alias("frames"), F.min("timestep").alias("first_t"), F.max("timestep").alias("last_t"), F.count_distinct("start_timestamp").alias("starts"))


_POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>>"
MAP_SCHEMA = (f"lane_segments MAP<STRING, STRUCT<id: BIGINT, is_intersection: BOOLEAN, lane_type: STRING, left_lane_boundary: {_POINTS}, right_lane_boundary: {_POINTS}, "
              f"left_lane_mark_type: STRING, right_lane_mark_type: STRING, left_neighbor_id: BIGINT, right_neighbor_id: BIGINT, predecessors: ARRAY<BIGINT>, successors: ARRAY<BIGINT>>>, "
              f"pedestrian_crossings MAP<STRING, STRUCT<id: BIGINT, edge1: {_POINTS}, edge2: {_POINTS}>>, drivable_areas MAP<STRING, STRUCT<id: BIGINT, area_boundary: {_POINTS}>>")
BOUNDARY_POINTS = 40
COLUMNS = ["scenario_id", "polyline_id", "polyline_type", "direction", "lane_id", "left_neighbor_id", "right_neighbor_id", "is_intersection", "predecessor_ids", "successor_ids", "points"]


def read_maps(spark: SparkSession, root: str) -> DataFrame:
    maps = spark.read.schema(MAP_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    return maps.withColumn("scenario_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]*$", 1))


def map_polylines(maps: DataFrame) -> DataFrame:
    """Per lane left and right boundary and centerline (mean of both at 40 points); crossings and areas as closed outlines."""
    xy = "transform({}, p -> struct(p.x AS x, p.y AS y))"
    lane = maps.selectExpr("scenario_id", "explode(lane_segments) AS (key, s)").selectExpr(
        "scenario_id", "CAST(s.id AS STRING) AS lane_id", "lower(s.lane_type) AS direction", "s.is_intersection AS is_intersection", "CAST(s.left_neighbor_id AS STRING) AS left_neighbor_id",
        "CAST(s.right_neighbor_id AS STRING) AS right_neighbor_id", "transform(s.predecessors, v -> CAST(v AS STRING)) AS predecessor_ids", "transform(s.successors, v -> CAST(v AS STRING)) AS successor_ids",
        f"{xy.format('s.left_lane_boundary')} AS l", f"{xy.format('s.right_lane_boundary')} AS r")
    lane = pl.resample(pl.resample(lane, "l", BOUNDARY_POINTS, "l"), "r", BOUNDARY_POINTS, "r").withColumn("c", F.expr(pl.centerline("l", "r")))
    parts = "inline(array(struct('lane_centerline' AS polyline_type, c AS points), struct('lane_boundary_left' AS polyline_type, l AS points), struct('lane_boundary_right' AS polyline_type, r AS points)))"
    lanes = lane.selectExpr("scenario_id", "lane_id", "direction", "is_intersection", "left_neighbor_id", "right_neighbor_id", "predecessor_ids", "successor_ids", parts).withColumn(
        "polyline_id", F.expr("IF(polyline_type = 'lane_centerline', lane_id, concat_ws(':', lane_id, polyline_type))"))
    bare = "CAST(NULL AS STRING) AS lane_id, CAST(NULL AS STRING) AS direction, false AS is_intersection, CAST(NULL AS STRING) AS left_neighbor_id, CAST(NULL AS STRING) AS right_neighbor_id, " \
           "CAST(array() AS ARRAY<STRING>) AS predecessor_ids, CAST(array() AS ARRAY<STRING>) AS successor_ids".split(", ")
    cross = maps.selectExpr("scenario_id", "explode(pedestrian_crossings) AS (key, s)").selectExpr("scenario_id", "key", f"{xy.format('s.edge1')} AS e1", f"{xy.format('s.edge2')} AS e2").selectExpr(
        "scenario_id", "concat('crossing:', key) AS polyline_id", "'pedestrian_crossing' AS polyline_type", *bare, f"{pl.crosswalk_outline('e1', 'e2')} AS points")
    area = maps.selectExpr("scenario_id", "explode(drivable_areas) AS (key, s)").selectExpr("scenario_id", "key", f"{xy.format('s.area_boundary')} AS b").selectExpr(
        "scenario_id", "concat('area:', key) AS polyline_id", "'drivable_area' AS polyline_type", *bare, f"{pl.close_outline('b')} AS points")
    return lanes.select(*COLUMNS).unionByName(cross.select(*COLUMNS)).unionByName(area.select(*COLUMNS))


def pair_files(scenario_files: DataFrame, map_files: DataFrame) -> DataFrame:
    """Scenario file with its map file; anything but exactly one map is an audit row."""
    key = lambda d, name: d.select(F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1).alias("scenario_id"), F.col("path").alias(name))
    m = key(map_files, "map_path").groupBy("scenario_id").agg(F.count("*").alias("maps"), F.min("map_path").alias("map_path"))
    return key(scenario_files, "scenario_path").distinct().join(m, "scenario_id", "left").selectExpr(
        "scenario_id", "scenario_path", "IF(maps = 1, map_path, NULL) AS map_path", "CASE WHEN maps IS NULL THEN 'map_missing' WHEN maps > 1 THEN 'map_ambiguous' END AS problem")


def corpus_check(spark: SparkSession, manifest: DataFrame, root: str, glob: str) -> DataFrame:
    """Manifest scenarios without file or with an empty file; only paths and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    have = files.groupBy(F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1).alias("scenario_id")).agg(F.max("length").alias("bytes"))
    return manifest.select("scenario_id").join(have, "scenario_id", "left").selectExpr(
        "scenario_id", "CASE WHEN bytes IS NULL THEN 'missing' WHEN bytes = 0 THEN 'empty' END AS problem").where("problem IS NOT NULL")
