"""The history stage of the whole funnel, and the ranking by all limits."""

import glob
import os

import duckdb

from roadsift.funnel import stages
from roadsift.plans import registry

registry.load()
STATE = "scenario_id string, track_id string, timestep int, x double, y double"


def test_changed_history_is_rejected(spark):
    s = spark.createDataFrame([("s", k, t, float(t), 0.0) for k in "ab" for t in range(40)], STATE)
    future = lambda c: [(c, "s", "a", "a", t, t + 5.0, 0.0) for t in range(35, 40)]
    rows = [*future("good"), *future("same"), ("same", "s", "a", "a", 20, 20.0, 0.0), *future("past"), ("past", "s", "a", "a", 20, 20.5, 0.0), *future("other"), ("other", "s", "a", "b", 37, 1.0, 0.0),
            *future("new"), ("new", "s", "a", "z", 37, 1.0, 0.0), *future("two"), ("two", "s", "b", "b", 37, 1.0, 0.0)]
    c = spark.createDataFrame(rows, "candidate_id string, scenario_id string, a string, track_id string, timestep int, x double, y double")
    found = {r.candidate_id: r.reason for r in stages.history_stage(c, s, 34).collect()}
    assert found == {"good": None, "same": None, **dict.fromkeys(["past", "other", "new", "two"], "history_changed")}


def test_ranking_by_all_limits_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine = sorted(map(tuple, registry.QUERIES["T03b_ranking_by_all_limits"](spark, sf_dir).select("candidate_id", "score").collect()))
    assert mine == sorted(c.execute(f"select candidate_id, score from ({registry.SQL['T03b_ranking_by_all_limits']})").fetchall())
    assert mine != sorted(c.execute(f"select candidate_id, score from ({registry.SQL['T03_kinematic_ranking']})").fetchall())
    print(len(mine), c.execute(f"select sum(score), count(*) filter (score > 0) from ({registry.SQL['T03_kinematic_ranking']})").fetchall(), sum(s for _, s in mine), sum(s > 0 for _, s in mine))


def test_history_stage_is_in_the_whole_funnel(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(stages, "run_funnel", lambda ids, names: [n for n, _ in names])
    assert registry.QUERIES["K12_whole_funnel"](spark, sf_dir)[:3] == ["schema_finite", "history_invariants", "kinematics"]
