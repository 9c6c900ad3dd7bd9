"""Seed-record tables: summaries, strata, selection, splits and pool merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from roadsift.operators.ranking import digest, hash_rank, quantiles, round_robin_index, value_ranks
from roadsift.session import materialize

KEY = ["scenario_id", "skill_id", "initiator_track_id", "responder_track_id"]
RISK = ["skill_id", "seed_risk_metric"]


def best_label(seeds: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("trigger_score").desc(), *ties)
    return seeds.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def risk_quartiles(seeds: DataFrame) -> DataFrame:
    """Quartile of the risk value in (skill, metric); equal values share the quartile of the first of them."""
    ranks = value_ranks(seeds, RISK, "seed_risk_value").withColumn("quartile", F.expr("CAST(least(3, floor(before * 4 / total)) AS INT)"))
    return seeds.join(ranks.select(*RISK, "seed_risk_value", "quartile"), [*RISK, "seed_risk_value"])


def distribution(seeds: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles, maximum and mean per group."""
    base = seeds.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"))
    return base.join(quantiles(seeds, groups, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}), groups)


def scan_summary(seeds: DataFrame, target_metric: str) -> DataFrame:
    """Counts over skill, metric and proxy flag at every level in one aggregation."""
    levels = [("skill_id",), ("seed_risk_metric",), ("skill_id", "seed_risk_metric"), ("skill_id", "proxy"), ()]
    names = ("skill_id", "seed_risk_metric", "proxy")
    level = lambda n, on: f"struct({n} AS level, " + ", ".join(f"{c if c in on else f'IF(true, NULL, {c})'} AS {c}" for c in names) + ")"
    s = seeds.selectExpr("scenario_id", "skill_id", "seed_risk_metric", f"seed_risk_metric <> {target_metric} AS proxy")
    s = s.selectExpr("scenario_id", f"inline(array({', '.join(level(n, on) for n, on in enumerate(levels))}))")
    # by scenario first: where a scenario's records lie in one task, only its level sums are shuffled
    one = s.groupBy("scenario_id", "level", *names).agg(F.count("*").alias("records"))
    # the level of all records has a row even without any
    none = one.sparkSession.range(1).selectExpr("CAST(NULL AS STRING) AS scenario_id", f"{len(levels) - 1} AS level", *[f"CAST(NULL AS {t}) AS {c}" for c, t in zip(names, ("STRING", "STRING", "BOOLEAN"))], "0L AS records")
    return one.unionByName(none).groupBy("level", *names).agg(F.sum("records").alias("records"), F.count("scenario_id").alias("scenarios")).drop("level")


def select_scenarios(seeds: DataFrame, count: int, seed: int = 2026) -> DataFrame:
    """Stratified round-robin over (skill, metric, quartile): rare strata first, hash order inside.

    Taking turns is sequential because a scenario taken for one stratum is skipped by the others, but no
    stratum can advance by more than ``count`` positions.  The first ``count`` keys of every stratum queue
    therefore decide the result: a table of keys bounded by count x strata, handled by one small task;
    all records stay distributed and are semi-joined to the chosen scenarios.
    """
    strata = ["skill_id", "seed_risk_metric", "quartile"]
    tagged = materialize(risk_quartiles(seeds).select("scenario_id", *strata).distinct(), "strata")    # read for the sizes and the queues
    text = [f"'{seed}'", "'{0}'", "skill_id", "seed_risk_metric", "CAST(quartile AS STRING)"]
    size = tagged.groupBy(*strata).agg(F.count("*").alias("size"))
    size = size.withColumn("stratum_hash", F.expr(digest(*[t.format("stratum") for t in text])))
    w = Window.partitionBy(*strata).orderBy("scenario_hash", "scenario_id")
    queue = tagged.withColumn("scenario_hash", F.expr(digest(*[t.format("scenario") for t in text], "scenario_id")))
    queue = queue.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= count).drop("scenario_hash")
    keys = queue.join(size, strata).select("scenario_id", "turn", "size", "stratum_hash", *strata)

    def take_turns(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["size", "stratum_hash", *strata, "turn"], kind="stable")
        queues = [list(g["scenario_id"]) for _, g in order.groupby(["size", "stratum_hash", *strata], sort=True)]
        at, taken = [0] * len(queues), {}
        progress = True
        while progress and len(taken) < count:
            progress = False
            for i, q in enumerate(queues):
                while at[i] < len(q) and q[at[i]] in taken:
                    at[i] += 1
                if at[i] < len(q) and len(taken) < count:
                    taken[q[at[i]]] = len(taken)
                    progress = True
        return pd.DataFrame({"scenario_id": list(taken), "position": list(taken.values())})

    return keys.withColumn("pool", F.lit(1)).groupBy("pool").applyInPandas(take_turns, "scenario_id string, position long")


def selected_records(seeds: DataFrame, chosen: DataFrame) -> DataFrame:
    return seeds.join(chosen.select("scenario_id"), "scenario_id", "left_semi")


def review_sample(seeds: DataFrame, count: int) -> DataFrame:
    """Round-robin over skills by trigger score; no skill can contribute more than ``count``."""
    w = Window.partitionBy("skill_id").orderBy(F.col("trigger_score").desc(), "scenario_id", "seed_risk_metric")
    ranked = seeds.withColumn("round", F.row_number().over(w)).where(F.col("round") <= count)
    return ranked.orderBy("round", "skill_id").limit(count)


def pilot_records(seeds: DataFrame, eligible: str, count: int, seed: int = 2026) -> DataFrame:
    """Per skill the first ``count`` eligible records in hash order, with the ineligible ones passed over on the way."""
    h = digest(f"'{seed}'", "'pilot'", "skill_id", "scenario_id", "seed_risk_metric")
    s = seeds.withColumn("order_hash", F.expr(h)).withColumn("eligible", F.expr(eligible))
    w = Window.partitionBy("skill_id").orderBy("order_hash")
    last = s.where("eligible").withColumn("n", F.row_number().over(w)).where(F.col("n") <= count).groupBy("skill_id").agg(
        F.max("order_hash").alias("last_hash"), F.count("*").alias("found"))
    # a skill with too few eligible records passes over all of its records; one row a skill is broadcast, so records don't meet by skill
    return s.join(F.broadcast(last), "skill_id", "left").where(f"last_hash IS NULL OR found < {count} OR order_hash <= last_hash").drop("last_hash", "found")


def hash_subset(ids: DataFrame, column: str, count: int, seed: int) -> DataFrame:
    return ids.select(column).distinct().withColumn("h", F.expr(digest(f"'{seed}'", "'subset'", column))).orderBy("h", column).limit(count).drop("h")


def hash_split(ids: DataFrame, column: str, sizes: dict[str, int], rest: str, seed: int) -> DataFrame:
    """Disjoint parts of fixed sizes by hash rank; everything else goes to ``rest``."""
    ranked = hash_rank(ids.select(column).distinct(), [], digest(f"'{seed}'", "'split'", column), [column])
    case, upto = "CASE", 0
    for name, n in sizes.items():
        upto += n
        case += f" WHEN rank <= {upto} THEN '{name}'"
    return ranked.withColumn("part", F.expr(f"{case} ELSE '{rest}' END"))


def two_phase_order(tasks: DataFrame, seed: int = 2026) -> DataFrame:
    """Coverage: one hash-chosen task per scenario.  Balance: the others round-robin over skills in hash order."""
    h = digest(f"'{seed}'", "'task'", "task_id")
    hashed = tasks.withColumn("h", F.expr(h))
    first = hashed.groupBy("scenario_id").agg(F.min(F.struct("h", "task_id")).alias("first")).select("scenario_id", F.col("first.task_id").alias("first_id"))
    t = hashed.join(first, "scenario_id").withColumn("phase", F.expr("IF(task_id = first_id, 'coverage', 'balance')")).drop("first_id")
    # both phases count and rank their tasks: written once, with the hash
    t = materialize(t, "phases")
    balance = t.where("phase = 'balance' AND skill_id IS NOT NULL")
    cover = hash_rank(t.where("phase = 'coverage'"), [], "h", ["task_id"]).withColumn("position", F.col("rank")).drop("rank", "total")
    rest = round_robin_index(hash_rank(balance, ["skill_id"], "h", ["task_id"]), "skill_id", "rank", balance).drop("rank", "total")
    return cover.unionByName(rest).drop("h")


def balanced_exposure(samples: DataFrame, maximum: int = 8) -> DataFrame:
    """Repeat the samples of rare skills toward the most frequent skill: full repeats plus a hash-ranked remainder."""
    size = samples.groupBy("skill_id").agg(F.count("*").alias("size"))
    top = size.agg(F.max("size").alias("top"))
    want = size.join(F.broadcast(top)).withColumn("want", F.expr(f"least(top, size * {maximum})"))
    ranked = hash_rank(samples, ["skill_id"], digest("'exposure'", "sample_id"), ["sample_id"]).drop("total")
    n = "CAST(floor(want / size) AS INT) + IF(rank <= want % size, 1, 0)"
    return ranked.join(want, "skill_id").withColumn("repeats", F.expr(n)).drop("top", "rank")


def move_candidates(plan: DataFrame, seed: int = 2026) -> DataFrame:
    """Skills whose development part holds more than half of the positives, and what moving each development
    scenario to training would relieve (its positives of such skills) and lose (its other positives)."""
    cells = plan.groupBy("scenario_id", "part", "skill_id").agg(F.count("*").alias("positives"))
    per = cells.groupBy("skill_id").agg(F.sum("positives").alias("total"), F.expr("coalesce(sum(positives) FILTER (WHERE part = 'dev'), 0)").alias("dev"))
    over = per.withColumn("excess", F.expr("dev > floor(total / 2)"))
    dev = cells.where("part = 'dev'").join(over, "skill_id")
    scored = dev.groupBy("scenario_id").agg(F.expr("coalesce(sum(positives) FILTER (WHERE excess), 0)").alias("relief"),
                                            F.expr("coalesce(sum(positives) FILTER (WHERE NOT excess), 0)").alias("loss"))
    return scored.where("relief > 0").withColumn("order_hash", F.expr(digest(f"'{seed}'", "'move'", "scenario_id")))


def merge_pools(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two seed pools and the violations that would forbid it: shared skills, repeated keys."""
    merged = first.unionByName(second)
    shared = first.select("skill_id").distinct().intersect(second.select("skill_id").distinct()).selectExpr("'shared_skill' AS problem", "skill_id AS key", "1L AS rows")
    twice = merged.groupBy("scenario_id", "skill_id", "seed_risk_metric").count().where("count > 1").selectExpr(
        "'duplicate_key' AS problem", "concat_ws('/', scenario_id, skill_id, seed_risk_metric) AS key", "count AS rows")
    return merged, shared.unionByName(twice)
