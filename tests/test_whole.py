"""Queries over the whole input: no fixed frames, all rules, all limits."""

import duckdb
import glob
import os

import pytest

from roadsift.plans import evaluation_queries as eq, registry

registry.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def agree(spark, sf_dir, duck, name, sql=None):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.execute(sql or registry.SQL[name])
    names = [d[0] for d in rel.description]
    theirs = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in rel.fetchall())
    assert mine and cols == sorted(names) and mine == theirs


def track(track, last, kind="vehicle", hole=(), jump=None):
    """Ten metres a second along x; ``jump`` moves the track two metres aside from that frame on."""
    return [("s", track, kind, t, t < 35, t / 10, float(t), 2.0 if jump and t >= jump else 0.0, 10.0, 0.0, 0.0) for t in range(last + 1) if t not in hole]


STATE = "scenario_id string, track_id string, object_type string, timestep int, observed boolean, time_s double, x double, y double, vx double, vy double, heading double"


@pytest.mark.parametrize("name", ["P19b_every_future_frame", "P20b_every_complete_window", "A07b_whole_kinematic_reference"])
def test_whole_kinematics_equal_sql(spark, sf_dir, duck, name):
    agree(spark, sf_dir, duck, name)


def test_peaks_after_frame_44_count(spark):
    s = spark.createDataFrame([*track("far", 98, jump=80), *track("short", 46), *track("hole", 98, hole=(70,)), *track("early", 34), *track("wall", 60, kind="static")], STATE)
    assert eq.whole_kinematics(s).where("key = 's/far'").count() == 64
    peaks = {r.key: r for r in eq.window_peaks(s).collect()}
    assert {k: r.frames for k, r in peaks.items()} == {"s/far": 64, "s/short": 12, "s/wall": 26}
    assert peaks["s/far"].speed > 20 and peaks["s/far"].curvature > 0.5 and peaks["s/short"].speed < 10.001
    rows = {(r.object_type, r.metric, r.kind): r for r in eq.kinematic_reference(s).collect()}
    assert {m for _, m, kind in rows if kind == "window"} == set(eq.METRICS) and rows["vehicle", "jerk", "point"].n == 76
    n = lambda m: rows["vehicle", m, "quality"].n
    assert (n("tracks"), n("incomplete_tracks"), n("window_tracks"), n("invalid_tracks")) == (4, 2, 2, 0) and rows["static", "ignored_rows", "quality"].n == 61


def test_spoiled_windows_are_counted(spark):
    rows = track("bad", 60)
    rows[50] = (*rows[50][:6], None, *rows[50][7:])
    s = spark.createDataFrame([*rows, *track("good", 60)], STATE)
    q = {r.metric: r.n for r in eq.kinematic_reference(s).where("kind = 'quality'").collect()}
    assert (q["invalid_position_rows"], q["invalid_tracks"], q["window_tracks"]) == (1, 1, 1)


RULED = ["F11b_distinct_roles_of_all_rules", "F12b_threshold_evidence_of_all_rules", "A03b_actor_types_of_all_rules", "F14b_observed_supervision_of_all_rules",
         "E05b_training_samples_of_all_rules", "F16b_role_contract_of_all_rules", "V01b_structural_condition_of_all_rules", "X01b_incremental_scan_of_all_rules"]


@pytest.fixture(scope="module")
def ruled(duck):
    """The matches of all rules by SQL, rule by rule: as one text DuckDB plans them for minutes."""
    from roadsift.plans.geometry_queries import rule_sqls
    for table, limit in (("every_match", False), ("best_match", True)):
        for i, sql in enumerate(rule_sqls(limit)):
            duck.execute(f"insert into {table} {sql}" if i else f"create table {table} as {sql}")
    return duck


@pytest.mark.parametrize("name", RULED)
def test_all_rules_equal_sql(spark, sf_dir, ruled, name):
    from roadsift.plans.geometry_queries import BEST_SQL, EVERY_SQL
    text = registry.SQL[name].replace(EVERY_SQL, "SELECT * FROM every_match").replace(BEST_SQL, "SELECT * FROM best_match")
    assert EVERY_SQL not in text and BEST_SQL not in text
    agree(spark, sf_dir, ruled, name, text)


def test_rules_beyond_the_first_four_are_matched(spark, sf_dir):
    from roadsift.plans.geometry_queries import CHECKED, rule_matches
    assert {r.skill_id for r in rule_matches(spark, sf_dir).select("skill_id").distinct().collect()} - set(CHECKED)
