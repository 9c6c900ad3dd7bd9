"""Risk labels of seed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions.formulas import clamp01


def risk_severity(seeds: DataFrame) -> DataFrame:
    """Severity in [0, 1] and its stratum; needs columns low, high, direction and target_metric."""
    part = "(seed_risk_value - low) / (high - low)"
    value = clamp01(f"CASE WHEN direction = 'lower_is_riskier' THEN 1 - {part} ELSE {part} END")
    s = seeds.withColumn("severity", F.expr(f"CASE WHEN seed_risk_metric = target_metric AND high > low THEN {value} END"))
    return s.withColumn("stratum", F.expr("CASE WHEN seed_risk_metric <> target_metric THEN 'proxy_metric' WHEN severity IS NULL THEN 'degenerate_target_range' "
                                          "WHEN severity >= 2.0D / 3 THEN 'high' WHEN severity >= 1.0D / 3 THEN 'medium' ELSE 'low' END"))


def quality_score(value: str, low: str, high: str) -> str:
    """Distance from the middle of the target range in range widths; lower is better."""
    return f"abs({value} - ({low} + {high}) / 2) / ({high} - {low})"
