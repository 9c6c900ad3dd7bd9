"""Findings of round 3: queries against their SQL or plain Python."""

import glob
import os

import duckdb
import pytest

from roadsift.plans import registry

from test_whole import agree

registry.load()
DATA = "/root/testdata/sf0.01"      # at sf0.001 no pair converges


def duck_of(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ["J07_pair_convergence", "J08_merge_roles"])
def test_convergence_queries_equal_sql(spark, name):
    agree(spark, DATA, duck_of(DATA), name)


def test_scan_of_all_rules_is_written_in_parts(spark, sf_dir):
    """The plan over the matches reads files only: no join, and so no broadcast, is left to the query that reads them."""
    from roadsift.plans import scene
    from roadsift.rules.catalog import RULES
    from roadsift.rules.detector import PART, Scene
    s = Scene(scene.states(spark, sf_dir), scene.roads(spark, sf_dir), list(RULES.values()), scene.actors(spark, sf_dir))
    found = s.raw_matches()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert len(s.pair) > PART and found.select("skill_id").distinct().count() > 1


def test_decisions_are_numbered_once(spark, sf_dir, monkeypatch):
    """The index reads written rows: the window that numbers them runs once, not once for each reader."""
    from roadsift.plans import sources_queries as sq
    seen = []
    monkeypatch.setattr(sq, "_PATHS", {})
    monkeypatch.setattr(sq.tb, "write_decisions", lambda c, d, path: seen.extend((c, d)))
    sq.decision_index(spark, sf_dir)
    assert len(seen) == 2 and all("Window" not in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)


def test_repeated_seed_keys_are_found(spark, tmp_path):
    from roadsift.sources import tables as tb
    row = lambda s, v: (s, "k", "1", "2", {"a": "1"}, 0.5, "m", v, "p")
    kind = "scenario_id string, skill_id string, initiator_track_id string, responder_track_id string, role_track_ids map<string,string>, trigger_score double, seed_risk_metric string, seed_risk_value double, source_path string"
    good = spark.createDataFrame([row("x", 1.0), row("y", 1.0)], kind)
    tb.write_seed_records(good, str(tmp_path / "good"))
    assert tb.read_seed_records(spark, str(tmp_path / "good"))[0].count() == 2
    with pytest.raises(ValueError):
        tb.write_seed_records(good.unionByName(spark.createDataFrame([row("x", 2.0)], kind)), str(tmp_path / "bad"))
    keys = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")    # equal hashes, different keys
    assert not tb.repeats(keys, ["p", "q"]) and tb.repeats(keys.unionByName(keys), ["p", "q"])


def test_tracks_of_one_future_frame(spark, tmp_path):
    """Half of the users end at frame 34: the SQL of J13 leaves them out, J13b takes them as points."""
    folder = str(tmp_path)
    duckdb.execute(f"""COPY (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM '{DATA}/events.parquet')
      WHERE n <= 35 OR user_id % 2 = 0) TO '{folder}/events.parquet' (FORMAT parquet)""")
    c = duck_of(folder)
    for name in ("J13_trajectory_conflict", "J13b_conflict_with_single_frames"):
        agree(spark, folder, c, name)
    n = lambda name: registry.QUERIES[name](spark, folder).count()
    assert n("J13b_conflict_with_single_frames") > n("J13_trajectory_conflict")
