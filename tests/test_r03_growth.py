"""Findings of round 3 on growth: steps whose largest task, shuffle or time grew faster than the input."""

import pytest

from pyspark.sql import functions as F

from roadsift.operators import ranking as rk, seeds as sd
from roadsift.plans import registry

registry.load()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As with large tables: joins are broadcast only where the code asks for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pilot_records_do_not_meet_by_skill(spark, no_broadcast):
    rows = [(f"c{i}", s, "m", i % 10 / 10) for i in range(60) for s in ("a", "b")] + [("z", "few", "m", 0.9), ("y", "few", "m", 0.1)]
    seeds = spark.createDataFrame(rows, "scenario_id string, skill_id string, seed_risk_metric string, trigger_score double")
    got = sd.pilot_records(seeds, "trigger_score >= 0.6", 5)
    assert "SortMergeJoin" not in plan_of(got)
    h = {(r.scenario_id, r.skill_id): r.h for r in seeds.selectExpr("scenario_id", "skill_id", rk.digest("'2026'", "'pilot'", "skill_id", "scenario_id", "seed_risk_metric") + " AS h").collect()}
    want = set()
    for skill in ("a", "b", "few"):
        found = 0
        for c, s, _, score in sorted((r for r in rows if r[1] == skill), key=lambda r: h[r[0], skill]):
            if found == 5:
                break
            want.add((c, s))
            found += score >= 0.6
    assert {(r.scenario_id, r.skill_id) for r in got.collect()} == want


def test_phases_are_written_once(spark):
    tasks = spark.createDataFrame([(f"t{i}", f"c{i // 5}", f"s{i % 3}") for i in range(100)], "task_id string, scenario_id string, skill_id string")
    got = sd.two_phase_order(tasks)
    assert "sha2" not in optimized(got)      # ranks and sizes read the written hash, not the tasks
    assert sorted(r.position for r in got.where("phase = 'coverage'").collect()) == list(range(1, 21))
    assert sorted(r.position for r in got.where("phase = 'balance'").collect()) == list(range(1, 81))


def test_selection_reads_its_records_once(spark, sf_dir):
    got = registry.QUERIES["Q02_selection_postconditions"](spark, sf_dir)
    assert "l_orderkey" not in optimized(got)


def test_scenario_files_are_written_by_many_tasks(spark, monkeypatch):
    """AQE merges partitions by bytes, and so all folders into one task; a fixed number of folders a task stays."""
    from roadsift.plans import sources_queries as sq
    monkeypatch.setattr(sq, "FOLDERS", 5)
    d = sq.spread(spark.range(60).selectExpr("CAST(id AS STRING) AS folder"))
    assert d.rdd.getNumPartitions() == 12
    assert sum(r.n > 0 for r in d.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) > 6


def test_lines_are_resampled_in_many_tasks(spark):
    d = registry.QUERIES["P29_resample"](spark, "/root/testdata/sf0.01")     # 15 scenarios
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_rows_of_candidates_do_not_carry_their_rule(spark, sf_dir):
    """Pairs and bounds are joined where they are read: no shuffle, sort or table repeats a rule's map in every frame."""
    from roadsift.plans import ruled_queries as rq
    assert not {"pairs", "bounds"} & set(rq.rule_rows(spark, sf_dir).columns)
    some = rq.evaluated_rows(spark, sf_dir, "skill_id = 'chain_braking'")
    assert not {"pairs", "bounds"} & set(some.columns)
    below = optimized(some).split("Window")[-1]
    assert "skill_id" in below and "chain_braking" in below      # other rules' rows are left out before the windows
    assert "Window" not in optimized(rq.recorded_crossings(spark, sf_dir))      # written once for seeds and points


def test_bootstrap_draws_are_those_of_the_hash(spark):
    """Weights drawn in blocks equal those of the built-in hash, for ids of every length; no row is made of a draw."""
    import math
    from roadsift.operators import evaluation as ev
    ids = ["", "7", "123", "1234", "12345", "1234567", "12345678", "123456789", "123456789012", "1234567890123", "ä" * 9, "x" * 31, "y" * 32, "z" * 77, None] + [str(10 ** 6 + i) for i in range(200)]
    d = spark.createDataFrame([(s, math.sin(i)) for i, s in enumerate(ids)], "scenario_id string, delta double")
    total, term, cuts = 0.0, 1.0, []
    for k in range(30):
        term = term / k if k else 1.0
        total += term
        if total / math.e >= 1:
            break
        cuts.append(f"CAST(u > {total / math.e!r} AS INT)")
    w = d.selectExpr("delta", "explode(sequence(0, 299)) AS b", "scenario_id").selectExpr("b", "delta", "((xxhash64(b, scenario_id, 2026) >> 12) + 2251799813685248L) / 4503599627370496D AS u").selectExpr("b", "delta", " + ".join(cuts) + " AS w")
    want = w.groupBy("b").agg(F.expr("sum(w * delta) / sum(w)").alias("m")).agg(F.expr("percentile(m, 0.025)"), F.expr("percentile(m, 0.975)"), F.count("*")).first()
    found = ev.bootstrap(d, 300)
    got = found.first()
    assert got[2] == want[2] == 300 and all(abs(got[i] - want[i]) < 1e-12 for i in (0, 1))
    assert "MapInArrow" in plan_of(found)
    values = [(1 << 51) + (i << 40) for i in range(-2000, 2000)] + [v + e for v in ev._limits() for e in (-1, 0)]
    assert all((v / 2 ** 52 > c) == (v >= limit) for v in values for limit, c in zip(ev._limits(), [eval(t.split("> ")[1].split(" AS")[0]) for t in cuts]))


def test_memory_of_a_task_does_not_grow_with_the_records(spark, sf_dir, monkeypatch):
    """The lines of a task stay the same, and a scenario's records meet nowhere else: level sums are all that is shuffled after them."""
    from roadsift import adapters as ad
    from roadsift.plans import seeds_queries as sq
    assert ad.seed_records(spark, sf_dir, 1000).rdd.getNumPartitions() == 6
    for name in ("A01_scan_summary", "Q10_scan_pool_integrity"):
        monkeypatch.setattr(sq, "ROWS", 1000)
        found = registry.QUERIES[name](spark, sf_dir)
        assert "Expand" not in plan_of(found) and plan_of(found).count("Scan parquet") == (1 if name[0] == "A" else 2)
    assert sorted(sq.sd.scan_summary(ad.seed_records(spark, sf_dir).where("false"), "'m0'").collect()) == [(None, None, None, 0, 0)]


def test_scan_pool_counts_each_side(spark):
    from roadsift.operators import audits as au
    pool = spark.createDataFrame([("a", "s", "m"), ("a", "s", "m"), ("b", "t", "m"), ("x", "s", "m"), ("x", "t", "n"), (None, "s", "m")], "scenario_id string, skill_id string, k string")
    listed = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,)], "scenario_id string")
    assert tuple(au.scan_pool(pool, listed, ["s"], ["scenario_id", "skill_id", "k"]).first()) == (3, 2, 1, 2)
    assert tuple(au.scan_pool(pool.where("false"), listed.where("false"), ["s"], ["scenario_id", "skill_id", "k"]).first()) == (0, 0, 0, 0)


def test_batches_of_a_scan_open_their_files_once(spark, sf_dir, monkeypatch):
    """Each batch hands written states and roads to the detector: neither the files nor the map's source are read by its plans."""
    from roadsift.plans import scene, sources_queries as sq
    from roadsift.rules.catalog import RULES
    from roadsift.streaming import scan
    seen, detect = [], scan.detect
    monkeypatch.setattr(scan, "detect", lambda states, roads, *rest: seen.append((optimized(states), optimized(roads))) or detect(states, roads, *rest))
    scan.run(spark, sq.raw_files(spark, sf_dir), scene.roads(spark, sf_dir), sq.folder(spark, "scan"), [RULES["slow_lead_blockage"]])
    assert seen and all("position_x" not in s and "Join" not in r and "user_id" not in r for s, r in seen)
