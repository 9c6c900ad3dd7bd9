"""Findings of round 3 on copied maps, late filters and paths that meet cell by cell."""

from roadsift.funnel import risk as rk, stages as sg
from roadsift.operators import pairs as pr
from roadsift.plans import funnel_queries as fq, registry, scene
from roadsift.rules import detector
from roadsift.rules.catalog import RULES
from test_r03_growth import optimized, plan_of

registry.load()
SMALL = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_no_map_is_copied_for_a_candidate(spark, sf_dir, monkeypatch):
    """a rule that reads the history fires on the record's actors, as it does on the copied scenes."""
    assert detector.reads_history_only("short_headway_following") and detector.reads_history_only("rear_vehicle_rapid_approach")
    assert not any(map(detector.reads_history_only, ("lead_hard_brake", "adjacent_vehicle_cut_in", "crossing_path_conflict", "chain_braking")))
    copies, make = [], fq.overlay_scene
    monkeypatch.setattr(fq, "overlay_scene", lambda *a: copies.append(a) or make(*a))
    got = rows_of(fq.fired(spark, SMALL, "short_headway_following", fq.typed(spark, SMALL)))
    assert got and not copies
    monkeypatch.setattr(detector, "reads_history_only", lambda skill: False)
    assert got == rows_of(fq.fired(spark, SMALL, "short_headway_following", fq.typed(spark, SMALL))) and copies


def test_trigger_stage_reads_no_conflict_points(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fq, "rows", None)
    assert fq.triggered(spark, sf_dir).columns == ["candidate_id", "reason"]


def test_stages_of_the_funnel_read_survivors_only(spark, sf_dir, monkeypatch):
    """each stage's input, not its result, is limited to the candidates that are left."""
    names = {}
    monkeypatch.setattr(sg, "run_funnel", lambda ids, stages: names.update(stages))
    registry.QUERIES["K12_whole_funnel"](spark, sf_dir)
    seen = {}
    for fn in ("map_stage", "collision", "kinematics"):
        monkeypatch.setattr(sg, fn, lambda rows, *a, fn=fn, f=getattr(sg, fn): seen.update({fn: rows}) or f(rows, *a))
    one = fq.typed(spark, sf_dir).select("candidate_id").orderBy("candidate_id").limit(1)
    for stage in ("kinematics", "map", "collision"):
        assert names[stage](one).count() == 1
    assert all(d.select("candidate_id").distinct().count() == 1 for d in seen.values()) and len(seen) == 3


def test_path_conflicts_are_made_for_pairs_that_may_match(spark):
    """the paths of actors that no pair of the rule can join aren't compared."""
    s = detector.Scene(scene.states(spark, SMALL), scene.roads(spark, SMALL), [RULES["intersection_blocking_vehicle"]], scene.actors(spark, SMALL))
    pairs = s.pairs(list(s.pair), s.full_actors(), set())
    wanted = pairs.where(s.may_meet(pairs.columns)).select("scenario_id", "a", "b")
    every, some = pr.conflicts(s.actors), pr.conflicts(s.actors, pairs=wanted)
    assert 0 < wanted.count() < pairs.count() / 5
    assert rows_of(some) == rows_of(every.join(wanted, ["scenario_id", "a", "b"], "left_semi").select(*some.columns))
    crossing = detector.Scene(s.states, s.polylines, [RULES["crossing_path_conflict"]], s.actors).may_meet([*pairs.columns, "min_dist"])
    assert "min_dist <= 6.0" in crossing and "time_gap" not in crossing


def test_pairs_carry_only_the_frames_that_rules_read(spark, monkeypatch):
    kept = []
    make = detector.Scene.frame_features
    monkeypatch.setattr(detector.Scene, "frame_features", lambda self, pairs, needs: kept.append(set(pairs.columns)) or make(self, pairs, needs))
    for skill in ("intersection_blocking_vehicle", "short_headway_following"):
        detector.Scene(scene.states(spark, SMALL), scene.roads(spark, SMALL), [RULES[skill]], scene.actors(spark, SMALL)).pair_matches()
    assert not {"a_past", "a_future"} & kept[0] and "a_future" not in kept[1] and "a_past" in kept[1]


def test_paths_of_a_candidate_meet_in_one_shuffle(spark):
    """frames are shuffled by candidate once, not once a role and cell; gaps in a path stay gaps."""
    at = lambda t, a, b: ("k", t, t / 10, *a, *b)
    d = spark.createDataFrame([at(0, (0.0, 0.0), (1.5, -1.0)), at(1, (1.0, 0.0), (1.5, 0.5)), at(2, (2.0, 0.0), (None, None)), at(3, (None, None), (9.0, 9.0)), at(4, (4.0, 0.0), (9.0, 10.0)),
                               ("n", 0, 0.0, 0.0, 0.0, None, None)], "candidate_id string, timestep int, time_s double, a_x double, a_y double, b_x double, b_y double")
    got = {r.candidate_id: (r.status, r.value) for r in rk.path_gap(d, [("a", "b")]).collect()}
    assert got["n"] == ("no_event", None) and got["k"][0] == "computed"
    # a reaches x = 1.5 at 0.15 s, b reaches y = 0 at 2 / 30 s
    assert abs(got["k"][1] - (0.15 - 2 / 30)) < 1e-9
    w = fq.wide(spark, SMALL)
    assert plan_of(rk.path_gap(w, [("a", "b")])).count("hashpartitioning") <= 3
    assert "cell_x" not in optimized(registry.QUERIES["V23_u_turn"](spark, SMALL))
