"""Mergeable log histogram per (type, metric) and its quantile upper bounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

BINS, LOW, HIGH = 2048, 1e-6, 1e4
WIDTH = math.log(HIGH / LOW) / BINS
KEY = ["object_type", "metric"]


def log_histogram(values: DataFrame) -> DataFrame:
    """Counts per bin; zero, underflow and overflow are the bins -2, -1 and BINS.  Merging is a plain sum."""
    bin_ = (f"CASE WHEN value = 0 THEN -2 WHEN value < {LOW} THEN -1 WHEN value > {HIGH} THEN {BINS} "
            f"ELSE CAST(least({BINS - 1}, greatest(0, floor(ln(value / {LOW}) / {WIDTH!r}))) AS INT) END")
    return values.where("value >= 0").withColumn("bin", F.expr(bin_)).groupBy(*KEY, "bin").agg(
        F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum("value").alias("total"), F.expr("sum(value * value)").alias("squares"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).groupBy(*KEY, "bin").agg(
        F.sum("n").alias("n"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def upper_bounds(histogram: DataFrame, probabilities: list[float]) -> DataFrame:
    """Upper edge of the bin holding rank ceil(p * n); NULL when that is the overflow bin.

    A group has at most 2051 bins, so the running sum is a small window.
    """
    w = Window.partitionBy(*KEY).orderBy("bin")
    h = histogram.withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*KEY)))
    edge = (f"CASE WHEN bin = -2 THEN CAST(0 AS DOUBLE) WHEN bin = -1 THEN {LOW}D WHEN bin < {BINS} THEN least({LOW}D * exp((bin + 1) * {WIDTH!r}), {HIGH}D) END")
    h = h.withColumn("p", F.explode(F.array(*[F.lit(p) for p in probabilities]))).where("cum >= greatest(1, ceil(p * all)) AND cum - n < greatest(1, ceil(p * all))")
    return h.select(*KEY, "p", F.expr(edge).alias("upper_bound"))
