"""Target risk and trigger conditions where every candidate has a rule of its own: against SQL, and both sides of each bound."""

import glob
import os

import duckdb
import pytest

from roadsift.funnel import ruled
from roadsift.plans import registry
from roadsift.rules.catalog import RULES

registry.load()
STATE = "x double, y double, vx double, vy double, heading double"


@pytest.mark.parametrize("name", ["M14b_conflict_point_chain", "K08b_target_risk_by_rule", "K09b_conditions_by_rule"])
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = c.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    theirs = sorted(repr(tuple(row[names.index(x)] for x in cols)) for row in rel.fetchall())
    assert theirs and sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == theirs and cols == sorted(names)


def test_rules_are_whole(spark):
    rows = {r.skill_id: r for r in ruled.rules_table(spark).collect()}
    assert set(rows) == {r.skill_id for r in RULES.values() if r.status == "formal"} and len(rows) == 34
    assert all(p.p != p.q and max(p.p, p.q) < len(r.roles) for r in rows.values() for p in r.pairs)
    needed = {r.skill_id for r in RULES.values() if r.status == "formal" and r.mode == "compatible_seed"}
    conditions = ruled.conditions_table(spark).collect()
    assert {c.skill_id for c in conditions} == needed == set(ruled.CONDITIONS) and len(needed) == 20
    assert {c.evaluator for c in conditions} - {"structural"} == set(ruled.EVALUATORS)


#: A candidate's roles in 15 frames: position and speed at the anchor, evenly moving; frame 34 is the anchor, 35 to 48 the future.
def wide(rows):
    out = []
    for name, skill, roles, point in rows:
        for t in range(34, 49):
            s = (t - 34) / 10
            row = {"candidate_id": name, "skill_id": skill, "timestep": t, "time_s": t / 10, "end_s": 4.8, "px": point and float(point[0]), "py": point and float(point[1])}
            for r in "abc":
                x, y, vx, vy, h = roles.get(r, (None,) * 5)
                row.update({f"{r}_x": None if x is None else x + vx * s, f"{r}_y": None if y is None else y + vy * s, f"{r}_vx": vx, f"{r}_vy": vy, f"{r}_heading": h})
            out.append(row)
    return out


COLUMNS = ["candidate_id string", "skill_id string", "timestep int", "time_s double", "end_s double", "px double", "py double"] + [f"{r}_{c}" for r in "abc" for c in STATE.split(", ")]


def prepared(spark, rows):
    from roadsift.funnel import frames as fr
    full = spark.createDataFrame(wide(rows), ", ".join(COLUMNS)).join(ruled.rules_table(spark).select("skill_id", "calculator", "pairs", "bounds"), "skill_id")
    full = fr.anchored(fr.with_steps(full), 34).selectExpr("*", "timestep > 34 AS fut")
    return ruled.with_events(full)


def test_each_calculator_by_hand(spark):
    fast, slow, side = (0.0, 0.0, 10.0, 0.0, 0.0), (20.0, 0.0, 5.0, 0.0, 0.0), (10.0, -10.0, 0.0, 10.0, 1.5707963267948966)
    rows = [
        ("gap", "slow_lead_blockage", {"a": slow, "b": fast}, None), ("headway", "short_headway_following", {"a": slow, "b": fast}, None), ("margin", "lead_sudden_stop", {"a": slow, "b": fast}, None),
        ("clear", "static_object_avoidance", {"a": (14.0, 3.0, 0.0, 0.0, 0.0), "b": fast}, None), ("path", "crossing_path_conflict", {"a": fast, "b": side}, None), ("apart", "crossing_path_conflict", {"a": fast, "b": (0.0, 50.0, 10.0, 0.0, 0.0)}, None),
        ("along", "crossing_path_conflict", {"a": fast, "b": (5.0, 0.0, 10.0, 0.0, 0.0)}, None), ("margin2", "intersection_creep_conflict", {"a": fast, "b": side}, (20, 0)), ("nowhere", "intersection_creep_conflict", {"a": fast, "b": side}, None),
        ("alone", "late_lane_change_before_diverge", {"a": fast}, None), ("leaving", "late_lane_change_before_diverge", {"a": fast, "b": (-20.0, 0.0, -5.0, 0.0, 0.0)}, None), ("noevent", "cut_in_then_brake", {"a": slow, "b": fast}, None),
        ("meets", "abrupt_u_turn_conflict", {"a": fast, "b": (25.0, 0.0, -10.0, 0.0, 3.141592653589793)}, None),
    ]
    got = {r.candidate_id: r for r in ruled.risk_by_rule(prepared(spark, rows), 34).collect()}
    near = lambda name, value: got[name].status == "computed" and abs(got[name].value - value) < 1e-6
    assert near("gap", 13.0) and near("headway", 1.3) and near("margin", 13.0 - 75 / 12)
    assert near("clear", 3.0) and near("path", 0.0) and near("margin2", 4.0)
    assert near("meets", 0.05)  # 1.2 s on: 1 m apart, closing at 20 m/s
    assert got["path"].pair == "first_vehicle->second_vehicle" and got["margin2"].pair is None
    states = {n: (got[n].status, got[n].reason) for n in ("apart", "along", "nowhere", "alone", "leaving", "noevent")}
    assert states == {"apart": ("no_event", "no_unique_path_conflict"), "along": ("unavailable", "non_unique_path_conflict"), "nowhere": ("unavailable", "required_context_missing"),
                      "alone": ("unavailable", "insufficient_valid_samples"), "leaving": ("no_event", "no_predicted_collision"), "noevent": ("unavailable", "required_context_missing")}
    checked = {r.candidate_id: r.rejection for r in ruled.target_check(ruled.risk_by_rule(prepared(spark, rows), 34), ruled.rules_table(spark)).collect()}
    assert checked["gap"] is None and checked["apart"] == "risk_metric_unavailable" and checked["margin2"] == "risk_out_of_target_range"


def verdict(spark, rows, missing=None, matched=(), fields=()):
    d = prepared(spark, rows)
    names = {n: s for n, s, *_ in rows}
    seeds = spark.createDataFrame([(n, list(missing or ruled.CONDITIONS[s]), list(matched), list(fields)) for n, s in names.items()], "candidate_id string, missing array<string>, matched array<string>, fields array<string>")
    none = spark.createDataFrame([], "candidate_id string, lane_shared boolean, lane_realised boolean")
    past = spark.createDataFrame([], "candidate_id string, past_speed double")
    found = ruled.trigger_check(ruled.verdicts(d, seeds, none, past), ruled.conditions_table(spark)).collect()
    return {r.candidate_id: (r.failed, r.reason) for r in found}


def test_bounds_are_those_of_the_rule(spark):
    ahead = lambda gap: {"a": (0.0, 0.0, 0.0, 0.0, 0.0), "b": (gap, 0.0, -3.0, 0.0, 0.0), "c": (-gap, 0.0, 3.0, 0.0, 0.0)}
    # squeeze: gaps close by 3 m/s each over 1.4 s; the bound of 25 m is met at 29 m, not at 30 m
    got = verdict(spark, [("near", "multi_vehicle_gap_squeeze", ahead(29.0), None), ("far", "multi_vehicle_gap_squeeze", ahead(30.0), None)])
    assert got["near"] == ("", None) and got["far"] == ("front_gap_small,rear_gap_small", "skill_trigger_not_realized")
    # two rules with one evaluator: target gaps of 20 m and 18 m, lateral displacement of 1 m and 0.25 m
    aside = {"a": (0.0, 0.0, 10.0, 0.5, 0.0), "b": (0.0, 19.0, 10.0, 0.0, 0.0)}
    got = verdict(spark, [("late", "late_lane_change_before_diverge", aside, None), ("cross", "diverge_lane_crossing_conflict", aside, None)], matched=["diverging_topology"])
    assert got["late"][0] == "late_lateral_crossing" and got["cross"][0] == "conflicting_vehicle_present"


def test_every_missing_condition_must_hold(spark):
    row = [("x", "construction_object_lane_blockage", {"a": (20.0, 0.0, 0.0, 0.0, 0.0), "b": (0.0, 0.0, 12.0, 0.0, 0.0)}, None)]
    assert verdict(spark, row)["x"] == ("construction_actor_near_path", "skill_trigger_not_realized")
    assert verdict(spark, row, fields=["minimum_object_path_clearance_m"])["x"] == ("", None)
    assert verdict(spark, row, missing=["vehicle_approaching"])["x"] == ("", None)
    assert verdict(spark, row, missing=["vehicle_approaching", "unknown"])["x"] == ("unknown", "skill_trigger_not_realized")
    assert verdict(spark, row, missing=["vehicle_approaching", "vehicle_approaching"])["x"][1] == "skill_trigger_not_realized"


def test_conflict_point_sources_in_order(spark):
    a, b = (0.0, 0.0, 10.0, 0.0, 0.0), (10.0, -10.0, 0.0, 10.0, 1.5)
    rows = {"seed": (a, b), "lane": (a, b), "made": (a, b), "source": (a, (10.0, -10.0, 0.0, -10.0, 1.5)), "near": (a, (0.0, 4.0, 10.0, 0.0, 0.0)), "none": (a, (0.0, 40.0, 10.0, 0.0, 0.0))}
    made = spark.createDataFrame(wide([(n, "crossing_path_conflict", {"a": p, "b": q}, None) for n, (p, q) in rows.items()]), ", ".join(COLUMNS))
    past = spark.createDataFrame(wide([("source", "crossing_path_conflict", {"a": a, "b": b}, None)]), ", ".join(COLUMNS))
    seeds = spark.createDataFrame([(n, "s", 1.0 if n == "seed" else None, 2.0 if n == "seed" else None, "l1" if n == "lane" else None, "l2" if n == "lane" else None) for n in rows], "candidate_id string, scenario_id string, seed_x double, seed_y double, lane_a string, lane_b string")
    line = lambda name, *points: ("s", name, "lane_centerline", [dict(zip("xy", map(float, p))) for p in points])
    roads = spark.createDataFrame([line("l1", (0, 0), (10, 10)), line("l2", (0, 8), (8, 0))], "scenario_id string, polyline_id string, polyline_type string, points array<struct<x:double,y:double>>")
    got = {r.candidate_id: (r.point_source, r.px, r.py) for r in ruled.conflict_points(made, past, seeds, roads).collect()}
    assert got["seed"] == ("frozen_seed_conflict_point", 1.0, 2.0) and got["lane"] == ("frozen_seed_lane_map_intersection", 4.0, 4.0)
    assert got["made"][0] == "generated_path_intersection" and abs(got["made"][1] - 10) < 1e-9 and abs(got["made"][2]) < 1e-9
    assert got["source"][0] == "source_path_intersection" and got["near"][0] == "generated_closest_approach_proxy" and got["near"][2] == 2.0
    assert got["none"] == ("unavailable", None, None)
