"""No caps: many neighbours, related lanes far apart, classes with their own limits, anchors without velocity."""

import math

import pytest

from roadsift import session
from roadsift.funnel import stages
from roadsift.operators import frames, lanes, pairs


def test_related_pairs_at_any_distance(spark):
    rows = [("s", "1", "vehicle", 0.0, 0.0, "L1", None, "L9", ["L2"], None), ("s", "2", "vehicle", 4000.0, 0.0, "L2", None, None, None, ["L1"]),
            ("s", "3", "vehicle", 9000.0, 0.0, "L9", "L1", None, None, None), ("s", "4", "vehicle", 1.0, 0.0, "L5", None, None, None, None), ("t", "5", "vehicle", 0.0, 0.0, "L1", None, None, None, None),
            ("s", "6", "vehicle", 2.0, 0.0, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "scenario_id string, track_id string, object_type string, x double, y double, lane string, left_id string, right_id string, succ array<string>, pred array<string>")
    found = {(r.a, r.b): r.dist for r in pairs.related_pairs(d, d).collect()}
    assert found == {("1", "2"): 4000.0, ("2", "1"): 4000.0, ("1", "3"): 9000.0, ("3", "1"): 9000.0}


def test_filtering_sees_more_than_twelve_neighbours(spark, monkeypatch):
    from roadsift.rules import triple_rules
    cars = [(f"c{k:02d}", 0.05 * k * (-1) ** k, (2.0 + 0.25 * k) * (1 if k % 2 else -1)) for k in range(16)]
    near = spark.createDataFrame([("s", "m", c, math.hypot(x, y), 0.0, 0.0, x, y, 5.0, [1], [1], "L", "L") for c, x, y in cars],
                                 "scenario_id string, a string, b string, dist double, a_x double, a_y double, b_x double, b_y double, a_speed double, a_hist_frames array<int>, b_hist_frames array<int>, a_lane string, b_lane string")

    class Scene:
        full_actors = staticmethod(lambda: None)
        pairs = staticmethod(lambda *args: near)

    found = {(r.responder, r.extra) for r in triple_rules.filtering(Scene).collect()}
    want = set()
    for i, x1, y1 in cars:
        for j, x2, y2 in cars:
            d1, d2, gap = math.hypot(x1, y1), math.hypot(x2, y2), math.hypot(x2 - x1, y2 - y1)
            if (d1, i) >= (d2, j) or not (1 <= gap <= 10 and d1 <= 7 and d2 <= 7):
                continue
            at = (-x1 * (x2 - x1) - y1 * (y2 - y1)) / gap ** 2
            if 0.1 <= at <= 0.9 and math.hypot(x1 + at * (x2 - x1), y1 + at * (y2 - y1)) <= 3:
                want.add((i, j))
    assert found == want and any("c15" in x for x in found)


def test_nearest_line_has_no_limit(spark):
    p = spark.createDataFrame([("s", 1, 0.0, 5000.0), ("s", 2, 0.0, 1.0)], "scenario_id string, k int, px double, py double")
    s = spark.createDataFrame([("s", "L", 0, 0.0, -1.0, 0.0, 1.0, 0.0)], "scenario_id string, polyline_id string, seq int, arc_start double, x1 double, y1 double, x2 double, y2 double")
    assert {r.k: r.m.distance for r in lanes.nearest_line(p, s, ["k"], 60.0).collect()} == {1: 5000.0, 2: 1.0}


def test_slow_classes_turn_at_their_own_speed(spark):
    rows = []
    for c in ("cyclist", "pedestrian", "vehicle"):
        for t in range(8):  # 0.4 m/s, one right turn in the middle
            x, y = 0.04 * min(t, 4), 0.04 * max(0, t - 4)
            rows.append((c, t, t / 10, t >= 2, x, y, 0.4, 0.0, 0.0 if t < 2 else None))
    d = spark.createDataFrame(rows, "candidate_id string, timestep int, time_s double, is_future boolean, x double, y double, vx double, vy double, heading double")
    k = spark.createDataFrame([(c, c) for c in ("cyclist", "pedestrian", "vehicle")], "candidate_id string, object_type string")
    rate = {r.candidate_id: r.heading_rate for r in stages.kinematics(d, k).collect()}
    assert rate["vehicle"] == 0 and rate["cyclist"] == pytest.approx(5 * math.pi) and rate["pedestrian"] == pytest.approx(5 * math.pi)


def test_direction_is_waived_by_skill(spark):
    points = spark.createDataFrame([("s", c, t, float(t), 0.0, math.pi) for c in "xy" for t in range(5)], "scenario_id string, candidate_id string, timestep int, px double, py double, heading double")
    road = spark.createDataFrame([("s", "L", "L", "lane_centerline", [(-5.0, 0.0), (50.0, 0.0)], "vehicle", False, None, None, None, None)],
                                 "scenario_id string, polyline_id string, lane_id string, polyline_type string, points array<struct<x:double,y:double>>, direction string, is_intersection boolean, predecessor_ids array<string>, successor_ids array<string>, left_neighbor_id string, right_neighbor_id string")
    kinds = spark.createDataFrame([("x", "vehicle", "wrong_way_vehicle"), ("y", "vehicle", "lead_hard_brake")], "candidate_id string, object_type string, skill_id string")
    assert {r.candidate_id: r.reason for r in stages.lane_compliance(points, road, kinds).collect()} == {"x": None, "y": "lane_direction_violation"}


def test_target_without_velocity_at_the_anchor(spark):
    rows = [("s", k, t, True, float(t), 0.0, None if k == "b" and t == 34 else 1.0, 0.0, 0.0) for k in "ab" for t in range(35)]
    d = spark.createDataFrame(rows, "scenario_id string, track_id string, timestep int, observed boolean, x double, y double, vx double, vy double, heading double")
    assert {r.track_id: r.reason for r in frames.resolve_targets(d, 34, 30).collect()} == {"a": None, "b": "anchor_velocity_missing"}


def test_no_silent_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Spark:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        session.shared_dir(Spark)
