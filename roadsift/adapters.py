"""Scenario-shaped tables derived from the generic driver tables.

Every track follows the real event stream of one user: the speed of each frame is
that user's event value, the number of frames is the user's event count.  A small
layout table places ten users per scenario on a fixed road map, so that following,
lane changes, crossings, merges and blockages all occur.  The SQL is plain enough
to run unchanged on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOTAL_STEPS = 110
HISTORY_STEPS = 35

# layout (scene kind, seat): object type, axis (0 +x, 1 +y, 2 -x, 3 -y), start x, start y,
# speed percent in frames 0-34 / 35-44 / 45-, lateral shift in cm (left +) over 20 frames,
# distance after which the path turns (m), turn side (+1 left, -1 right, 0 none)
SEATS = [
    (0, 0, "vehicle", 0, 20, 0, 60, 20, 2, 0, 0, 0),
    (0, 1, "vehicle", 0, -3, 0, 100, 100, 60, 0, 0, 0),
    (0, 2, "vehicle", 0, -13, 0, 100, 100, 60, 0, 0, 0),
    (0, 3, "vehicle", 0, 40, 3.5, 10, 10, 10, 0, 0, 0),
    (0, 4, "vehicle", 0, 0, 3.5, 80, 60, 40, 150, 0, 0),
    (0, 5, "vehicle", 0, -10, 3.5, 80, 70, 40, 0, 0, 0),
    (0, 6, "vehicle", 0, 10, 7, 100, 100, 100, 0, 0, 0),
    (0, 7, "bus", 0, -5, 7, 110, 110, 110, 0, 0, 0),
    (0, 8, "cyclist", 0, 0, -3.5, 50, 50, 50, 0, 0, 0),
    (0, 9, "pedestrian", 0, 5, -8, 15, 15, 15, 0, 0, 0),
    (1, 0, "vehicle", 0, 0, 3.5, 100, 95, 95, -350, 0, 0),
    (1, 1, "vehicle", 0, -8, 0, 100, 100, 105, 0, 0, 0),
    (1, 2, "vehicle", 0, 12, 0, 100, 85, 80, 0, 0, 0),
    (1, 3, "vehicle", 0, 5, 7, 100, 100, 100, 0, 0, 0),
    (1, 4, "cyclist", 0, 20, -3.5, 30, 40, 40, 350, 0, 0),
    (1, 5, "vehicle", 0, 25, 3.5, 100, 100, 100, 0, 0, 0),
    (1, 6, "motorcyclist", 0, 5, 5.25, 100, 105, 105, 0, 0, 0),
    (1, 7, "vehicle", 0, 5, 3.5, 100, 100, 100, 0, 0, 0),
    (1, 8, "vehicle", 0, 60, 0, 100, 100, 100, 150, 0, 0),
    (1, 9, "vehicle", 0, 55, 3.5, 100, 100, 100, 0, 0, 0),
    (2, 0, "vehicle", 1, 50, -45, 100, 100, 100, 0, 0, 0),
    (2, 1, "vehicle", 0, 0, 0, 100, 100, 100, 0, 0, 0),
    (2, 2, "vehicle", 0, 8, 3.5, 100, 100, 100, 0, 42, 1),
    (2, 3, "vehicle", 2, 95, 7, 100, 100, 100, 0, 0, 0),
    (2, 4, "vehicle", 0, 2, 0, 100, 100, 100, 0, 44, -1),
    (2, 5, "vehicle", 2, 80, -3.5, 100, 100, 100, 0, 0, 0),
    (2, 6, "vehicle", 1, 50, -8, 10, 40, 40, 0, 0, 0),
    (2, 7, "vehicle", 1, 50, -1, 1, 5, 5, 0, 0, 0),
    (2, 8, "vehicle", 0, 45, 0, 10, 10, 10, 0, 0, 0),
    (2, 9, "bus", 0, 30, 7, 50, 50, 50, 0, 0, 0),
    (3, 0, "pedestrian", 1, 72, -6.2, 15, 15, 15, 0, 0, 0),
    (3, 1, "vehicle", 0, 20, 0, 100, 100, 100, 0, 0, 0),
    (3, 2, "pedestrian", 1, 73, -6.5, 15, 15, 15, 0, 0, 0),
    (3, 3, "pedestrian", 1, 30, -5, 15, 15, 15, 0, 0, 0),
    (3, 4, "vehicle", 0, -5, 0, 100, 100, 100, 0, 0, 0),
    (3, 5, "pedestrian", 1, 60, -5.5, 1, 3, 3, 0, 0, 0),
    (3, 6, "cyclist", 1, 90, -15, 45, 45, 45, 0, 0, 0),
    (3, 7, "vehicle", 0, 30, 3.5, 100, 100, 100, 0, 42, 1),
    (3, 8, "pedestrian", 0, 65, 8, 15, 15, 15, 0, 0, 0),
    (3, 9, "vehicle", 0, 55, 0, 100, 100, 100, 0, 0, 0),
    (4, 0, "vehicle", 0, 29, -12.5, 100, 100, 100, 1000, 0, 0),
    (4, 1, "vehicle", 0, 29, 0, 100, 100, 100, 0, 0, 0),
    (4, 2, "vehicle", 0, 10, 0, 100, 100, 100, 0, 0, 0),
    (4, 3, "vehicle", 0, 50, 7, 100, 100, 100, 0, 0, 0),
    (4, 4, "cyclist", 0, 40, -3.5, 50, 50, 50, 0, 0, 0),
    (4, 5, "vehicle", 0, 15, 0, 100, 100, 100, 0, 50, -1),
    (4, 6, "vehicle", 0, 60, 0, 100, 100, 100, 150, 0, 0),
    (4, 7, "vehicle", 0, 58, 3.5, 100, 100, 100, 0, 0, 0),
    (4, 8, "bus", 0, -10, 0, 100, 100, 100, 0, 0, 0),
    (4, 9, "vehicle", 0, 20, 7, 100, 100, 100, 0, 0, 0),
    (5, 0, "static", 0, 60, 1, 0, 0, 0, 0, 0, 0),
    (5, 1, "vehicle", 0, 5, 0, 100, 100, 100, 0, 0, 0),
    (5, 2, "construction", 0, 55, -1, 0, 0, 0, 0, 0, 0),
    (5, 3, "vehicle", 2, 95, 7, 100, 100, 100, 0, 0, 0),
    (5, 4, "vehicle", 0, 0, 7, 100, 100, 100, 0, 0, 0),
    (5, 5, "vehicle", 0, 40, 3.5, 0, 0, 30, -350, 0, 0),
    (5, 6, "vehicle", 0, 25, 0, 100, 100, 100, 0, 0, 0),
    (5, 7, "vehicle", 0, -10, 3.5, 100, 80, 40, 350, 0, 0),
    (5, 8, "pedestrian", 0, 5, -20, 15, 15, 15, 0, 0, 0),
    (5, 9, "bus", 0, 40, 7, 60, 60, 60, 0, 0, 0),
]

# polyline id: (type, direction, is intersection, left, right, predecessors, successors, points)
ROADS = {
    "A0": ("lane_centerline", "vehicle", False, "A1", "K0", [], ["B0", "D0"], [(-60, 0), (20, 0), (100, 0)]),
    "A1": ("lane_centerline", "vehicle", False, "A2", "A0", [], ["B1"], [(-60, 3.5), (100, 3.5)]),
    "A2": ("lane_centerline", "vehicle", False, None, "A1", [], ["B2"], [(-60, 7), (100, 7)]),
    "B0": ("lane_centerline", "vehicle", False, "B1", None, ["A0", "M0"], [], [(100, 0), (200, 0)]),
    "B1": ("lane_centerline", "vehicle", False, "B2", "B0", ["A1"], [], [(100, 3.5), (200, 3.5)]),
    "B2": ("lane_centerline", "vehicle", False, None, "B1", ["A2"], [], [(100, 7), (200, 7)]),
    "D0": ("lane_centerline", "vehicle", False, None, None, ["A0"], [], [(100, 0), (140, -6), (180, -20)]),
    "M0": ("lane_centerline", "vehicle", False, None, None, [], ["B0"], [(20, -25), (60, -12.5), (100, 0)]),
    "K0": ("lane_centerline", "bike", False, "A0", None, [], [], [(-60, -3.5), (100, -3.5)]),
    "I0": ("lane_centerline", "vehicle", True, None, None, [], [], [(50, -45), (50, 45)]),
    "X0": ("pedestrian_crossing", None, False, None, None, [], [], [(70, -6), (74, -6), (74, 12), (70, 12), (70, -6)]),
    "S0": ("drivable_area", None, False, None, None, [], [], [(-80, -5), (220, -5), (220, 10), (-80, 10), (-80, -5)]),
    "S1": ("drivable_area", None, False, None, None, [], [], [(44, -46), (56, -46), (56, 46), (44, 46), (44, -46)]),
}


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR(8))"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return f"'{value}'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)


def _rows(rows) -> str:
    return ",\n".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def seats_sql() -> str:
    rows = [(g, k, t, ax, float(x), float(y), p1, p2, p3, lat, float(td), ts)
            for g, k, t, ax, x, y, p1, p2, p3, lat, td, ts in SEATS]
    return (f"SELECT * FROM (VALUES {_rows(rows)}) AS seats"
            "(g, k, object_type, axis, ox, oy, p1, p2, p3, lat_cm, turn_d, turn_s)")


def track_states_sql(events: str = "events") -> str:
    """`track_states` over the events table; identical text for Spark and DuckDB."""
    return f"""
    SELECT CAST(scenario_no AS VARCHAR(20)) AS scenario_id, CAST(user_id AS VARCHAR(20)) AS track_id, object_type,
           CAST(timestep AS INT) AS timestep, timestep < {HISTORY_STEPS} AS observed,
           CAST(timestep AS DOUBLE) / 10 AS time_s,
           CASE axis WHEN 0 THEN ox + f WHEN 1 THEN ox - s WHEN 2 THEN ox - f ELSE ox + s END AS x,
           CASE axis WHEN 0 THEN oy + s WHEN 1 THEN oy + f WHEN 2 THEN oy - s ELSE oy - f END AS y,
           CASE dir WHEN 0 THEN v WHEN 2 THEN 0 - v ELSE CAST(0 AS DOUBLE) END AS vx,
           CASE dir WHEN 1 THEN v WHEN 3 THEN 0 - v ELSE CAST(0 AS DOUBLE) END AS vy,
           CASE dir WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN pi() / 2 WHEN 2 THEN pi() ELSE 0 - pi() / 2 END AS heading
    FROM (
      SELECT *, CASE WHEN turned THEN turn_d ELSE d END AS f,
             (CASE WHEN turned THEN turn_s * (d - turn_d) ELSE CAST(0 AS DOUBLE) END)
               + CAST(lat_cm AS DOUBLE) / 100
                 * greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(timestep - 36 AS DOUBLE) / 20)) AS s,
             (axis + (CASE WHEN turned THEN turn_s ELSE 0 END) + 4) % 4 AS dir
      FROM (
        SELECT *, CAST(cum AS DOUBLE) / 25000000 AS d, CAST(c * pct AS DOUBLE) / 2500000 AS v,
               turn_s <> 0 AND CAST(cum AS DOUBLE) / 25000000 > turn_d AS turned
        FROM (
          SELECT *, CAST(sum(c * pct) OVER (PARTITION BY user_id ORDER BY timestep
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
          FROM (
            SELECT e.*, p.*, CASE WHEN timestep < 35 THEN p1 WHEN timestep < 45 THEN p2 ELSE p3 END AS pct
            FROM (SELECT user_id, CAST(floor(user_id / 10.0) AS BIGINT) AS scenario_no, user_id % 10 AS seat,
                         CAST(floor(user_id / 10.0) AS BIGINT) % 6 AS kind,
                         200000 + CAST(round(value * 100) AS BIGINT) AS c,
                         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS timestep
                  FROM {events}) e
            JOIN ({seats_sql()}) p ON e.kind = p.g AND e.seat = p.k
            WHERE timestep < {TOTAL_STEPS}) a) b) c) d
    """


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for table in tables:
        read(spark, sf_dir, table).createOrReplaceTempView(table)


def track_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(track_states_sql("{events}"), events=read(spark, sf_dir, "events"))


def scenario_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read(spark, sf_dir, "events")
            .selectExpr("CAST(CAST(floor(user_id / 10.0) AS BIGINT) AS STRING) AS scenario_id").distinct())


def map_polylines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The fixed road map repeated for every scenario (map rows are few; scenarios stay distributed, over ``tasks`` if given).
    Never broadcast: the planner takes the repeated map for little more than the ids."""
    items = []
    for pid, (kind, direction, cross, left, right, pred, succ, points) in ROADS.items():
        text = {"polyline_id": pid, "polyline_type": kind, "direction": direction,
                "lane_id": pid if kind == "lane_centerline" else None,
                "left_neighbor_id": left, "right_neighbor_id": right}
        fields = [f"'{k}', CAST({'NULL' if v is None else repr(v)} AS STRING)" for k, v in text.items()]
        fields.append(f"'is_intersection', {str(cross).lower()}")
        for name, ids in (("predecessor_ids", pred), ("successor_ids", succ)):
            fields.append(f"'{name}', CAST(array({', '.join(map(repr, ids))}) AS ARRAY<STRING>)")
        shape = ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for x, y in points)
        items.append(f"named_struct({', '.join(fields)}, 'points', array({shape}))")
    ids = scenario_ids(spark, sf_dir)
    return (ids if tasks is None else ids.repartition(tasks, "scenario_id")).selectExpr("scenario_id", f"inline(array({', '.join(items)}))").hint("merge")


SEED_RECORDS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS scenario_id, concat(l_returnflag, '_', l_linestatus) AS skill_id,
       concat('m', CAST(l_linenumber % 2 AS VARCHAR(2))) AS seed_risk_metric,
       min(l_extendedprice) AS seed_risk_value, max(l_quantity) / 50 AS trigger_score,
       CAST(min(l_partkey) AS VARCHAR(20)) AS initiator_track_id,
       CAST(max(l_suppkey) AS VARCHAR(20)) AS responder_track_id
FROM {lineitem} GROUP BY 1, 2, 3
"""

DECISIONS_SQL = """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4)), '-', CAST(l_partkey AS VARCHAR(20)),
              '-', CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey
                                           ORDER BY l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount, l_quantity)
                        AS VARCHAR(9))) AS candidate_id,
       concat('t', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_suppkey % 5 AS VARCHAR(2))) AS task_id,
       CAST(floor(l_orderkey / 4.0) AS BIGINT) AS scenario_no,
       CAST(CAST(floor(l_orderkey / 4.0) AS BIGINT) AS VARCHAR(20)) AS scenario_id,
       concat('s', CAST(l_suppkey % 5 AS VARCHAR(2))) AS skill_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'skill_condition' ELSE 'null_condition' END AS arm,
       CASE WHEN l_discount >= 0.08 THEN 'map' WHEN l_tax >= 0.07 THEN 'kinematics'
            WHEN l_quantity >= 40 THEN 'collision' WHEN l_quantity <= 3 THEN 'target_risk' END AS first_failed_stage,
       CASE WHEN l_discount >= 0.08 THEN (CASE WHEN l_quantity >= 25 THEN 'off_road' ELSE 'wrong_lane' END)
            WHEN l_tax >= 0.07 THEN 'acceleration_limit' WHEN l_quantity >= 40 THEN 'vehicle_contact'
            WHEN l_quantity <= 3 THEN 'risk_out_of_range' END AS reason,
       abs(l_extendedprice - 50000) / 100000 AS quality_score, l_quantity / 10 AS risk_value,
       CAST(l_linenumber AS INT) AS candidate_index, CAST(l_partkey AS VARCHAR(20)) AS target_track_id,
       l_returnflag AS detection_mode, CAST(round(l_tax * 100) AS BIGINT) AS parameter_bin
FROM {lineitem}
"""

PREDICTIONS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS scenario_id, concat(l_returnflag, '_', l_linestatus) AS skill_id,
       concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4)), '-', CAST(l_partkey AS VARCHAR(20)),
              '-', CAST(l_suppkey AS VARCHAR(20)), '-',
              CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey
                   ORDER BY l_extendedprice, l_shipdate, l_tax, l_discount, l_quantity) AS VARCHAR(9))) AS sample_id,
       l_linenumber % 3 = 0 AS is_long_tail,
       CASE CAST(round(l_tax * 100) AS BIGINT) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high'
            WHEN 3 THEN 'proxy' ELSE 'degenerate' END AS risk_stratum,
       CAST(l_linenumber % 3 AS INT) AS train_seed,
       CAST(round(l_quantity * l_discount * 10000) AS BIGINT) AS base_ade_u,
       CAST(round(l_quantity * l_tax * 10000) AS BIGINT) AS cand_ade_u
FROM {lineitem}
"""

MANIFEST_SQL = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS scenario_id, lower(substr(o_orderpriority, 3)) AS split,
       concat('scenarios/', CAST(o_orderkey AS VARCHAR(20)), '/scenario.parquet') AS source_path,
       o_orderstatus AS city_name, concat('c', CAST(o_custkey % 7 AS VARCHAR(2))) AS selected_reason
FROM {orders}
"""

# 32 steps per vector; six vectors form one task, the sixth is its target
STEPS_SQL = """
SELECT CAST(floor(vec_id / 6.0) AS BIGINT) AS task_no, CAST(vec_id % 6 AS INT) AS mode, CAST(step AS INT) AS step,
       CAST(sum(CAST(round(dx * 1000) AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY step
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000 AS x,
       CAST(sum(CAST(round(dy * 1000) AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY step
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000 AS y
FROM {steps}
"""


def seed_records(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """Seed records; with ``rows``, a scenario's records lie in one task and a task reads about so many rows, however large the table."""
    lines = read(spark, sf_dir, "lineitem")
    if rows is not None:
        lines = lines.repartition(max(1, -(-lines.count() // rows)), F.expr("CAST(l_orderkey AS VARCHAR(20))"))
    return spark.sql(SEED_RECORDS_SQL, lineitem=lines)


def filter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DECISIONS_SQL, lineitem=read(spark, sf_dir, "lineitem"))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS_SQL, lineitem=read(spark, sf_dir, "lineitem"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST_SQL, orders=read(spark, sf_dir, "orders"))


def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate futures: (task, mode, step, x, y) from the embedding vectors."""
    raw = read(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(slice(embedding, 1, 32)) AS (p, dx)", "embedding")
    steps = raw.selectExpr("vec_id", "p + 1 AS step", "CAST(dx AS DOUBLE) AS dx",
                           "CAST(element_at(embedding, p + 33) AS DOUBLE) AS dy")
    return spark.sql(STEPS_SQL, steps=steps)


ANCHOR = 34
LAST = 48

# four candidate futures per track: the recorded one and three shifted along or across; roles b and c are the next two tracks
CANDIDATES_SQL = """
SELECT concat(s.track_id, '-', CAST(idx AS VARCHAR(2))) AS candidate_id, s.scenario_id, s.track_id AS a, p.track_id AS b, q.track_id AS c, object_type,
       CAST(idx AS INT) AS candidate_index, timestep,
       CAST(CAST(x + CAST(idx * 5 * (timestep - 34) AS DOUBLE) / 100 AS FLOAT) AS DOUBLE) AS x,
       CAST(CAST(y + CAST(CASE idx WHEN 1 THEN 2 WHEN 2 THEN -25 WHEN 3 THEN 10 ELSE 0 END * (timestep - 34) AS DOUBLE) / 100 AS FLOAT) AS DOUBLE) AS y
FROM {states} s JOIN (SELECT DISTINCT scenario_id, track_id FROM {states}) p ON p.scenario_id = s.scenario_id AND CAST(p.track_id AS BIGINT) = CAST(s.track_id AS BIGINT) + 1
JOIN (SELECT DISTINCT scenario_id, track_id FROM {states}) q ON q.scenario_id = s.scenario_id AND CAST(q.track_id AS BIGINT) = CAST(s.track_id AS BIGINT) + 2
JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(idx)) i ON true
WHERE timestep BETWEEN 35 AND 48
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANDIDATES_SQL, states=track_states(spark, sf_dir))
