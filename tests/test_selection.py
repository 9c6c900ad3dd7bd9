"""Ranks, selection, diversity, bootstrap and representative choice against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from roadsift.operators import delivery as dl, diversity as dv, evaluation as ev, ranking as rk, seeds as sd


def seeds(spark, rows):
    return spark.createDataFrame(rows, "scenario_id string, skill_id string, seed_risk_metric string, seed_risk_value double")


def make(n=120):
    rng = random.Random(3)
    return [(f"c{i}", s, "m", float(rng.randint(0, 9))) for i in range(n) for s in ("a", "b", "c") if rng.random() < {"a": 0.9, "b": 0.4, "c": 0.1}[s]]


def quartiles(rows):
    group = defaultdict(list)
    for c, s, m, v in rows:
        group[(s, m)].append((v, c))
    out = {}
    for key, items in group.items():
        items.sort()
        q, last = 0, None
        for i, (v, c) in enumerate(items):
            if v != last:
                q = min(3, i * 4 // len(items))
            out[(c, *key)] = q
            last = v
    return out


def test_equal_risks_share_a_quartile(spark):
    rows = make()
    got = {(r.scenario_id, r.skill_id, r.seed_risk_metric): r.quartile for r in sd.risk_quartiles(seeds(spark, rows)).collect()}
    assert got == quartiles(rows)


def digest(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def brute_selection(rows, n, seed=2026):
    queue = defaultdict(list)
    for (c, s, m), q in quartiles(rows).items():
        queue[(s, m, q)].append(c)
    order = sorted(queue, key=lambda k: (len(queue[k]), digest(seed, "stratum", *k), k))
    for k in queue:
        queue[k].sort(key=lambda c: (digest(seed, "scenario", *k, c), c))
    taken = []
    while len(taken) < n:
        before = len(taken)
        for k in order:
            nxt = next((c for c in queue[k] if c not in taken), None)
            if nxt is not None and len(taken) < n:
                taken.append(nxt)
        if len(taken) == before:
            break
    return taken


def test_stratified_selection_is_exact_and_order_independent(spark):
    rows = make()
    want = brute_selection(rows, 40)
    for data in (rows, rows[::-1]):
        got = sd.select_scenarios(seeds(spark, data), 40).orderBy("position").collect()
        assert [r.scenario_id for r in got] == want


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("g", f"i{i}") for i in range(500)], "g string, id string")
    h = rk.digest("id")
    one = {r.id: r["rank"] for r in rk.hash_rank(df.repartition(1), ["g"], h, ["id"]).collect()}
    many = {r.id: r["rank"] for r in rk.hash_rank(df.repartition(7), ["g"], h, ["id"]).collect()}
    assert one == many and sorted(one.values()) == list(range(1, 501))


def test_hot_group_quantiles_are_exact(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 2) - 1 for _ in range(2001)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = rk.quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5}).first()
    values.sort()
    assert math.isclose(got.p25, values[500]) and math.isclose(got.p50, values[1000])


def brute_greedy(cands):
    accepted, seen, out = defaultdict(list), set(), {}
    for c in sorted(cands, key=lambda c: (c["skill_id"], c["quality_score"], c["scenario_id"], c["candidate_id"])):
        group = accepted[(c["scenario_id"], c["skill_id"])]
        best = None
        for p in group:
            d = [(a["x"] - b["x"], a["y"] - b["y"]) for a, b in zip(c["future"], p["future"])]
            item = (math.sqrt(sum(x * x + y * y for x, y in d) / len(d)), math.hypot(*d[-1]), p["candidate_id"])
            best = item if best is None or item < best else best
        reason = None
        if best and best[0] < 1.0 and best[1] < 0.5:
            reason = "too_similar"
        elif len(group) >= 3:
            reason = "scenario_skill_limit"
        elif c["signature"] in seen:
            reason = "global_duplicate"
        if reason is None:
            group.append(c)
            seen.add(c["signature"])
        out[c["candidate_id"]] = reason
    return out


def test_greedy_diversity_equals_the_sequential_order(spark):
    rng = random.Random(11)
    cands = []
    for i in range(90):
        end = rng.choice([0.0, 0.2, 2.0, 4.0])
        cands.append({"candidate_id": f"c{i:02d}", "scenario_id": f"s{rng.randint(0, 4)}", "skill_id": rng.choice("ab"), "quality_score": rng.choice([0.1, 0.2, 0.3]),
                      "future": [{"x": end * k / 3, "y": rng.choice([0.0, 0.1])} for k in range(4)], "signature": rng.choice(["u", "v", "w", f"z{i}"])})
    for c in cands:
        c["signature"] = c["skill_id"] + c["signature"]
    df = spark.createDataFrame(cands, "candidate_id string, scenario_id string, skill_id string, quality_score double, future array<struct<x: double, y: double>>, signature string")
    got = {r.candidate_id: r.reason for r in dv.greedy(df).collect()}
    assert got == brute_greedy(cands)


def test_one_signature_shared_by_hundreds_of_groups(spark):
    cands = [{"candidate_id": f"c{i:03d}", "scenario_id": f"s{i}", "skill_id": "a", "quality_score": (i * 7 % 300) / 300, "future": [{"x": float(i), "y": 0.0}], "signature": "same" if i % 3 else f"own{i}"} for i in range(300)]
    df = spark.createDataFrame(cands, "candidate_id string, scenario_id string, skill_id string, quality_score double, future array<struct<x: double, y: double>>, signature string")
    got = {r.candidate_id: r.reason for r in dv.greedy(df).collect()}
    assert got == brute_greedy(cands) and sum(v is None for v in got.values()) == 101


def test_representative_rejects(spark):
    rows = [(f"c{i}", "s", f"n{i % 4}", ["map", "collision", "target_risk"][i % 3], i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "candidate_id string, skill_id string, scenario_id string, first_failed_stage string, quality_score double")
    got = [r.candidate_id for r in dl.representative_rejects(df, 5).orderBy("position").collect()]
    # one per stage with distinct scenarios in stage order, then the best of the rest
    assert got == ["c0", "c1", "c2", "c3", "c4"]


def test_bootstrap_interval_and_grouping(spark):
    rng = random.Random(5)
    base = [(f"s{i}", rng.gauss(3, 1)) for i in range(400) for _ in range(2)]
    a = spark.createDataFrame(base, "scenario_id string, v double")
    b = a.withColumn("v", F.col("v") - 0.5)
    d = ev.scenario_deltas(a, b, "v")
    assert d.count() == 400
    ci = ev.bootstrap(d.withColumn("delta", F.expr("delta + IF(hash(scenario_id) % 2 = 0, 0.1, -0.1)")), 500).first()
    assert ci.low < -0.48 and ci.high > -0.52 and ci.high - ci.low < 0.05


def test_unpaired_scenarios_are_refused(spark):
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "scenario_id string, v double")
    d = ev.scenario_deltas(a, a.where("scenario_id = 's1'"), "v")
    assert [(r.scenario_id, r.missing) for r in ev.unpaired(d).collect()] == [("s2", "candidate")]
    with pytest.raises(Exception, match="scenario without its pair: s2"):
        ev.bootstrap(d, 10).collect()


def test_best_of_k_uses_the_mask(spark):
    p = spark.createDataFrame([(1, m, s, float(m + s), 0.0) for m in range(2) for s in range(3)], "k int, mode int, step int, x double, y double")
    t = spark.createDataFrame([(1, s, 0.0, 0.0, s < 2) for s in range(3)], "k int, step int, tx double, ty double, valid boolean")
    r = ev.best_of_k(p, t, ["k"]).first()
    assert (r.min_ade, r.min_fde, r.miss) == (0.5, 1.0, False)
