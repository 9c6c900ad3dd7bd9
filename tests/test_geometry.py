"""Analytic cases: crossings, gaps, headings, projections, headways."""

import math
import random

from pyspark.sql import functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import lanes as ln, pairs as pr, polylines as pl, tracks as tr


def one(spark, expr):
    return spark.sql(f"SELECT {expr} AS v").first().v


def track(spark, rows):
    """rows: (track, t, x, y)"""
    df = spark.createDataFrame([("s", k, "vehicle", t, True, float(t), x, y) for k, t, x, y in rows],
                               "scenario_id string, track_id string, object_type string, timestep int, observed boolean, time_s double, x double, y double")
    return df.withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0), "heading": F.lit(0.0)})


def paths(spark, rows):
    s = track(spark, rows)
    g = s.groupBy("scenario_id", "track_id").agg(F.expr("map_from_entries(collect_list(struct(timestep, struct(observed, time_s, x, y, vx, vy, heading) AS s)))").alias("f"), F.max("timestep").alias("n"))
    return g.selectExpr("scenario_id", "track_id", "0 AS ref_t", "transform(sequence(0, n), t -> f[t]) AS future")


def test_straight_crossing(spark):
    rows = [("a", 0, -1.0, 0.0), ("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), ("b", 0, 0.0, -1.0), ("b", 1, 0.0, -1 / 3), ("b", 2, 0.0, 1 / 3), ("b", 3, 0.0, 1.0)]
    got = pr.conflicts(paths(spark, rows)).where("a = 'a'").first()
    assert (round(got.cx, 9), round(got.cy, 9)) == (0, 0)
    assert math.isclose(got.ta, 1.0) and math.isclose(got.tb, 1.5) and math.isclose(got.time_gap, 0.5)


def test_gap_is_not_bridged(spark):
    rows = [("a", 0, -1.0, 0.0), ("a", 2, 1.0, 0.0), ("b", 0, 0.0, -1.0), ("b", 1, 0.0, 1.0)]
    assert pr.conflicts(paths(spark, rows)).count() == 0


def test_heading_wrap(spark):
    assert math.isclose(one(spark, f"degrees({fm.heading_gap('radians(179)', 'radians(-179)')})"), 2.0, abs_tol=1e-9)
    assert math.isclose(one(spark, f"degrees({fm.heading_gap('0', 'pi()')})"), 180.0)
    assert one(spark, fm.heading_gap("CAST(NULL AS DOUBLE)", "0")) is None


def test_ttc_and_headway(spark):
    d = lambda v: f"CAST({v} AS DOUBLE)"
    assert math.isclose(one(spark, fm.ttc(d(10), d(0), d(-2), d(0))), 5.0)
    assert one(spark, fm.ttc(d(10), d(0), d(2), d(0))) is None
    assert one(spark, fm.ttc(d(1), d(0), d(2), d(0), 2.0)) == 0.0
    assert one(spark, fm.headway(d(-1), d(3))) == 0.0
    assert one(spark, fm.headway(d(5), d(0))) is None


def test_speed_is_missing_after_a_gap(spark):
    s = track(spark, [("a", 0, 0.0, 0.0), ("a", 1, 2.0, 0.0), ("a", 3, 8.0, 0.0), ("a", 4, 9.0, 0.0)])
    got = {r.timestep: r.speed for r in tr.speeds(s).collect()}
    assert got == {0: None, 1: 2.0, 3: None, 4: 1.0}


def naive(px, py, pts):
    best, arc = None, 0.0
    for i, (p, q) in enumerate(zip(pts, pts[1:])):
        if None in p or None in q:
            continue
        dx, dy = q[0] - p[0], q[1] - p[1]
        length = math.hypot(dx, dy)
        f = max(0.0, min(1.0, ((px - p[0]) * dx + (py - p[1]) * dy) / length ** 2)) if length > 1e-9 else 0.0
        d = math.hypot(px - p[0] - f * dx, py - p[1] - f * dy)
        if best is None or (d, i, f) < best[:3]:
            best = (d, i, f, arc + f * length)
        arc += length
    return best


def test_random_polylines(spark):
    rng = random.Random(7)
    lines, expected = [], {}
    for k in range(60):
        pts = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(rng.randint(2, 7))]
        if len(pts) > 4:
            pts[2] = (None, None)
            pts[1] = pts[0]
        lines.append((f"s{k}", f"l{k}", pts))
        expected[f"s{k}"] = naive(1.0, 2.0, pts)
    df = spark.createDataFrame([(s, l, [dict(x=x, y=y) for x, y in p]) for s, l, p in lines], "scenario_id string, polyline_id string, points array<struct<x: double, y: double>>")
    df = df.selectExpr("*", "'lane_centerline' AS polyline_type", "polyline_id AS lane_id", "'vehicle' AS direction", "false AS is_intersection")
    pts = df.selectExpr("scenario_id", "1D AS px", "2D AS py", "'p' AS k")
    got = {r.scenario_id: r for r in ln.nearest_per_line(pts, ln.segments(df), ["k"], 100.0).collect()}
    for s, best in expected.items():
        if best is not None:
            assert math.isclose(got[s].distance, best[0], abs_tol=1e-9) and got[s].seq == best[1] and math.isclose(got[s].arc, best[3], abs_tol=1e-9)


def test_outlines_and_resampling(spark):
    df = spark.createDataFrame([([dict(x=0.0, y=0.0), dict(x=3.0, y=0.0), dict(x=3.0, y=1.0)],)], "points array<struct<x: double, y: double>>")
    got = pl.resample(df, "points", 5, "p").first().p
    assert [(p.x, p.y) for p in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]
    assert len(df.selectExpr(f"{pl.close_outline('points')} AS p").first().p) == 4


def test_longest_run_counts_consecutive_frames(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 4, 5)], "k string, timestep int")
    r = tr.longest_run(df, ["k"], "true").first()
    assert (r.frames, r.span) == (3, 2)
