"""Exactly one decision per candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def one_decision_each(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per skill: candidates, decided ones, and violations on either side."""
    d = decisions.groupBy("candidate_id").agg(F.count("*").alias("n"))
    c = candidates.join(d, "candidate_id", "left")
    return c.groupBy("skill_id").agg(F.count("*").alias("candidates"), F.count("n").alias("decided"), F.expr("count_if(n IS NULL)").alias("undecided"), F.expr("count_if(n > 1)").alias("decided_twice"))
