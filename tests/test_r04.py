"""Findings of round 4: scans of all rules, and what their plans leave in the driver."""

import pytest

from pyspark.sql import functions as F

from roadsift.plans import registry, scene
from roadsift.rules import detector
from roadsift.rules.catalog import RULES

registry.load()


SMALL = "/root/testdata/sf0.01"


def test_one_detector_run_for_all_batches_of_files(spark, monkeypatch):
    """files come in by small batches, the detector's plans run once over them; a later run scans the new files only."""
    from roadsift.plans import sources_queries as sq
    from roadsift.streaming import scan
    source, out, rules = sq.folder(spark, "late"), sq.folder(spark, "scan"), [RULES["slow_lead_blockage"]]
    raw = spark.read.parquet(sq.raw_files(spark, SMALL))
    put = lambda *ids: raw.where(F.col("scenario_id").isin(*ids)).write.mode("append").partitionBy("folder").parquet(source)
    seen, detect = [], scan.detect
    monkeypatch.setattr(scan, "detect", lambda states, *rest: seen.append(sorted(r[0] for r in states.select("scenario_id").distinct().collect())) or detect(states, *rest))
    go = lambda: scan.run(spark, source, scene.roads(spark, SMALL), out, rules, files_per_batch=1)
    put("0", "1", "6")
    go()
    assert seen == [["0", "1", "6"]]
    put("12")
    found = spark.read.parquet(go())
    assert seen[1:] == [["12"]]
    rows = lambda d: sorted(map(repr, d.select("scenario_id", "skill_id", "initiator", "responder", "score").collect()))
    want = detect(scene.states(spark, SMALL).where("scenario_id IN ('0', '1', '6', '12')"), scene.roads(spark, SMALL), rules, 1)
    assert rows(found) == rows(want) and len(rows(want)) > 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark, sf_dir):
    """F2-F7, F9: the planner takes a map cut into segments and cells for the bytes of its scenario ids, and would send it through the driver."""
    from roadsift.operators import lanes as ln, pairs as pr, tracks as tr
    roads = scene.roads(spark, sf_dir)
    bare = spark.read.schema(roads.schema).parquet(scene.materialize(roads, "bare-roads").inputFiles()[0])      # a map without the hint of ours
    actors = tr.actors(scene.states(spark, sf_dir))
    for lines in (roads, bare):
        assert "BroadcastHashJoin" not in plan_of(ln.match_candidates(actors, lines))
        assert "BroadcastHashJoin" not in plan_of(ln.lane_attributes(lines).where("diverges")).split("Window")[0]
    matched = ln.with_lanes(actors, bare)
    assert "BroadcastHashJoin" not in plan_of(pr.near_pairs(actors, actors, 50.0)) and "BroadcastHashJoin" not in plan_of(pr.related_pairs(matched, matched))


def test_written_tables_are_not_broadcast(spark, sf_dir):
    """F5, F8: the files of a table by candidate are a small part of its rows' memory; only the rules' own table is sent to all tasks."""
    from roadsift.plans import ruled_queries as rq
    for df in (rq.evaluated_rows(spark, sf_dir), scene.states(spark, sf_dir).join(scene.candidates(spark, sf_dir), ["scenario_id", "timestep"])):
        assert "BroadcastHashJoin" not in plan_of(df)


def test_rules_are_parsed_in_pieces(spark, sf_dir, monkeypatch):
    """F2-F4, F6, F7, F9: the parser keeps what it has looked ahead over; one nested text of six rules left tens of MB in the driver."""
    s = detector.Scene(scene.states(spark, sf_dir), scene.roads(spark, sf_dir), [RULES[k] for k in list(RULES)[:10]], scene.actors(spark, sf_dir))
    pairs = s.frame_features(s.pairs(list(s.pair), s.full_actors(), {"past"}), s.needs)
    pairs = s.enrich(pairs, s.needs - detector.FRAME_FEATURES)
    texts, expr = [], detector.F.expr
    monkeypatch.setattr(detector.F, "expr", lambda text: texts.append(text) or expr(text))
    found = s._matches_of(pairs, s.pair)
    monkeypatch.undo()
    assert texts and max(map(len, texts)) < 6000 and found.columns == detector.MATCH
