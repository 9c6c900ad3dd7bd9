"""Range joins through a uniform grid, so that no join is quadratic in a scenario.

A point falls in one cell; a box is repeated for every cell it touches after padding.
Joining on (scenario, cell) leaves only true neighbours, splits a large scenario over
many tasks, and lets AQE split the rare hot cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def exploded(df: DataFrame) -> DataFrame:
    """Rows made by explode: the planner takes them for as many bytes as they were made of, so it must not be left to broadcast them."""
    return df.hint("merge")


def point_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.selectExpr("*", f"CAST(floor({x} / {size}) AS BIGINT) AS cell_x", f"CAST(floor({y} / {size}) AS BIGINT) AS cell_y")


def box_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float, pad: float = 0.0) -> DataFrame:
    lo = lambda v: f"CAST(floor(({v} - {pad}) / {size}) AS BIGINT)"
    hi = lambda v: f"CAST(floor(({v} + {pad}) / {size}) AS BIGINT)"
    wide = df.selectExpr("*", f"explode(sequence({lo(x1)}, {hi(x2)})) AS cell_x")
    return exploded(wide.selectExpr("*", f"explode(sequence({lo(y1)}, {hi(y2)})) AS cell_y"))


CELL = ["scenario_id", "cell_x", "cell_y"]
