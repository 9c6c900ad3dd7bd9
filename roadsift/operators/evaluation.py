"""Prediction errors, summaries, deltas and bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm

MISS_M = 2.0


def best_of_k(predictions: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Per sample: least mean error, least final error (taken independently) and miss flag.

    ``predictions``: keys, mode, step, x, y.  ``targets``: keys, step, tx, ty, valid.
    """
    d = predictions.join(targets.where("valid"), [*keys, "step"]).withColumn("d", F.expr(fm.norm("x - tx", "y - ty")))
    per_mode = d.groupBy(*keys, "mode").agg(F.avg("d").alias("ade"), F.max_by("d", "step").alias("fde"))
    best = per_mode.groupBy(*keys).agg(F.min("ade").alias("min_ade"), F.min("fde").alias("min_fde"))
    return best.withColumn("miss", F.expr(f"min_fde > {MISS_M}"))


def metric_sums(errors: DataFrame) -> DataFrame:
    """Additive totals of single-mode errors."""
    return errors.agg(F.sum("min_ade").alias("ade_sum"), F.sum("min_fde").alias("fde_sum"), F.count("*").alias("samples"), F.expr("count_if(miss)").alias("misses"))


def constant_velocity(states: DataFrame, history: int) -> DataFrame:
    """Baseline path of every track from its last valid history velocity."""
    last = states.where(f"timestep < {history} AND observed AND vx IS NOT NULL AND vy IS NOT NULL AND x IS NOT NULL").groupBy("scenario_id", "track_id").agg(
        F.max_by(F.struct("x", "y", "vx", "vy", "timestep"), "timestep").alias("r"))
    future = states.where(f"timestep >= {history} AND x IS NOT NULL").select("scenario_id", "track_id", "timestep", "x", "y")
    joined = future.join(last, ["scenario_id", "track_id"])
    t = "(timestep - r.timestep) * 0.1D"
    return joined.selectExpr("scenario_id", "track_id", "0 AS mode", "timestep AS step", f"r.x + r.vx * {t} AS x", f"r.y + r.vy * {t} AS y", "x AS tx", "y AS ty")


def summaries(rows: DataFrame, skills: DataFrame) -> DataFrame:
    """Overall, long tail, per skill and per risk stratum; skills without rows stay with zero."""
    m = [F.count("*").alias("n"), F.avg("min_ade").alias("min_ade"), F.avg("min_fde").alias("min_fde"), F.avg(F.col("miss").cast("double")).alias("miss")]
    tail = rows.where("is_long_tail")
    part = lambda df, view, key: df.groupBy(F.expr(key).alias("key")).agg(*m).selectExpr(f"'{view}' AS view", "key", "n", "min_ade", "min_fde", "miss")
    per_skill = skills.join(part(tail, "skill", "skill_id"), F.col("key") == F.col("skill_id"), "left").selectExpr(
        "'skill' AS view", "skill_id AS key", "coalesce(n, 0) AS n", "min_ade", "min_fde", "miss")
    return (part(rows, "overall", "'all'").unionByName(part(tail, "long_tail", "'all'")).unionByName(per_skill)
            .unionByName(part(tail, "risk", "risk_stratum")))


def over_seeds(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over training seeds first per seed, then mean and sample deviation of the seed means."""
    per = rows.groupBy(*keys, "train_seed").agg(F.avg(value).alias("m"))
    return per.groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def seed_id_sets(rows: DataFrame) -> DataFrame:
    """Samples missing in at least one training seed."""
    seeds = rows.agg(F.count_distinct("train_seed").alias("all_seeds"))
    per = rows.groupBy("sample_id").agg(F.count_distinct("train_seed").alias("seeds"))
    return per.join(F.broadcast(seeds)).where("seeds < all_seeds")


def delta(candidate: str, base: str) -> tuple[str, str]:
    return f"{candidate} - {base}", f"CASE WHEN {base} <> 0 THEN ({candidate} - {base}) / {base} END"


def scenario_deltas(base: DataFrame, candidate: DataFrame, value: str) -> DataFrame:
    """Repeated labels averaged per scenario on both arms, then the paired difference; unpaired scenarios have a NULL side."""
    b = base.groupBy("scenario_id").agg(F.avg(value).alias("base"))
    c = candidate.groupBy("scenario_id").agg(F.avg(value).alias("cand"))
    return b.join(c, "scenario_id", "full_outer").withColumn("delta", F.expr("cand - base"))


def unpaired(deltas: DataFrame) -> DataFrame:
    """Audit: scenarios that one of the arms lacks; a bootstrap over them is an error."""
    return deltas.where("delta IS NULL").selectExpr("scenario_id", "IF(base IS NULL, 'base', 'candidate') AS missing")


#: Cells of a block of scenarios by resamples: its arrays stay in a core's cache.
CELLS = 1 << 15
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(h: np.ndarray, bits: int, t: np.ndarray) -> None:
    np.left_shift(h, np.uint64(bits), out=t)
    np.right_shift(h, np.uint64(64 - bits), out=h)
    np.bitwise_or(h, t, out=h)


def _word(h: np.ndarray, value, t: np.ndarray) -> None:
    """Step of four bytes."""
    np.bitwise_xor(h, value * _P1, out=h)
    _turn(h, 23, t)
    np.multiply(h, _P2, out=h)
    np.add(h, _P3, out=h)


def _finish(h: np.ndarray, t: np.ndarray) -> None:
    for bits, prime in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(h, np.uint64(bits), out=t)
        np.bitwise_xor(h, t, out=h)
        if prime is not None:
            np.multiply(h, prime, out=h)


def _hash_int(h: np.ndarray, value, t: np.ndarray) -> None:
    """xxhash64 of 32-bit integers; h: seeds, changed in place, t: scratch of its shape."""
    np.add(h, _P5 + np.uint64(4), out=h)
    _word(h, np.asarray(value).astype(np.uint32).astype(np.uint64), t)
    _finish(h, t)


def _stripes(seeds: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """State after the whole stripes of 32 bytes of longer texts."""
    t = np.empty_like(seeds)
    lanes = [seeds + (_P1 + _P2), seeds + _P2, seeds.copy(), seeds - _P1]
    for at in range(0, texts.shape[1] - 31, 32):
        for i, v in enumerate(lanes):
            v += np.ascontiguousarray(texts[:, at + 8 * i:at + 8 * i + 8]).view("<u8") * _P2
            _turn(v, 31, t)
            v *= _P1
    h = np.zeros_like(seeds)
    for v, bits in zip(lanes, (1, 7, 12, 18)):
        part = v.copy()
        _turn(part, bits, t)
        h += part
    for v in lanes:
        v *= _P2
        _turn(v, 31, t)
        v *= _P1
        h ^= v
        h *= _P1
        h += _P4
    return h


def _hash_text(h: np.ndarray, texts: np.ndarray, t: np.ndarray) -> None:
    """xxhash64 of texts of one size (rows of a byte matrix); h: seeds by text and resample, changed in place."""
    size, at = texts.shape[1], 0
    if size < 32:
        np.add(h, _P5, out=h)
    else:
        h[:] = _stripes(h, texts)
        at = size // 32 * 32
    np.add(h, np.uint64(size), out=h)
    while at + 8 <= size:
        k = np.ascontiguousarray(texts[:, at:at + 8]).view("<u8")[:, 0] * _P2
        _turn(k, 31, np.empty_like(k))
        np.bitwise_xor(h, (k * _P1)[:, None], out=h)
        _turn(h, 27, t)
        np.multiply(h, _P1, out=h)
        np.add(h, _P4, out=h)
        at += 8
    if at + 4 <= size:
        _word(h, np.ascontiguousarray(texts[:, at:at + 4]).view("<u4").astype(np.uint64), t)
        at += 4
    for i in range(at, size):
        np.bitwise_xor(h, texts[:, i:i + 1].astype(np.uint64) * _P5, out=h)
        _turn(h, 11, t)
        np.multiply(h, _P1, out=h)
    _finish(h, t)


def _limits() -> list[int]:
    """Least value of the hash's upper 52 bits whose uniform is above each cumulative Poisson(1) probability: 1/e * (1, 2, 2.5, 2 2/3, ...)."""
    out, total, term = [], 0.0, 1.0
    for k in range(30):
        term = term / k if k else 1.0
        total += term
        if total / math.e >= 1:  # no draw is above it in double precision
            break
        cut = int(total / math.e * 2 ** 52)  # exact: a product with a power of two; the uniform is value / 2**52
        out.append(cut + 1)
    return out


def bootstrap(deltas: DataFrame, resamples: int = 2000, seed: int = 2026) -> DataFrame:
    """Paired bootstrap over scenarios with Poisson(1) weights, a function of (resample, scenario) only: of
    ``xxhash64(resample, scenario_id, seed)``, for the uniform (hash >> 12 + 2**51) / 2**52.

    Each task draws the weights of its scenarios block by block and returns one sum a resample, so ``resamples`` rows a task are
    shuffled, whatever the number of scenarios.
    """
    spark = deltas.sparkSession
    paired = "CASE WHEN delta IS NULL THEN CAST(raise_error(concat('scenario without its pair: ', scenario_id)) AS DOUBLE) ELSE delta END AS delta"
    # a fixed number of tasks: the bytes of ids and deltas say nothing of the work
    d = deltas.selectExpr("scenario_id", paired).repartition(4 * spark.sparkContext.defaultParallelism, "scenario_id")

    def draw(batches):
        limits = [(limit - (1 << 51)) << 12 for limit in _limits()]      # of the whole hash: its lower bits don't count
        rows = max(1, CELLS // resamples)
        first, t = np.full(resamples, 42, dtype=np.uint64), np.empty((rows, resamples), dtype=np.uint64)
        _hash_int(first, np.arange(resamples), t[0])
        hashes, above, counts, w = (np.empty((rows, resamples), dtype=k) for k in (np.uint64, bool, np.uint8, float))
        weighted, weights = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            ids = np.array([x if x is None else x.encode() for x in batch.column(0).to_pylist()], dtype=object)
            values, sizes = batch.column(1).to_numpy(zero_copy_only=False), np.array([-1 if x is None else len(x) for x in ids])
            for size in np.unique(sizes):
                pick = np.flatnonzero(sizes == size)
                texts = np.frombuffer(b"".join(ids[pick]) if size > 0 else b"", dtype=np.uint8).reshape(len(pick), max(size, 0))
                for i in range(0, len(pick), rows):
                    some = slice(0, len(texts[i:i + rows]))
                    h, n, draws = hashes[some], counts[some], w[some]
                    np.copyto(h, first)
                    if size >= 0:      # a missing id leaves the seed
                        _hash_text(h, texts[i:i + rows], t[some])
                    _hash_int(h, seed, t[some])
                    signed, top = h.view(np.int64), int(h.view(np.int64).max())
                    n.fill(0)
                    for limit in limits:
                        if limit > top:
                            break
                        np.greater_equal(signed, limit, out=above[some])
                        np.add(n, above[some].view(np.uint8), out=n)
                    np.copyto(draws, n)
                    weights += draws.sum(0)
                    np.multiply(draws, values[pick[i:i + rows], None], out=draws)
                    weighted += draws.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weighted), pa.array(weights)], ["b", "wd", "w"])

    sums = d.mapInArrow(draw, "b long, wd double, w double")
    means = sums.groupBy("b").agg((F.sum("wd") / F.sum("w")).alias("m"))
    return means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"), F.count("*").alias("resamples"))
