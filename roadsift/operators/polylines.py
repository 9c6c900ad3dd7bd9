"""Polyline shapes as row-local array expressions (a map polyline is one bounded row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm

POINT = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def close_outline(points: str) -> str:
    return f"CASE WHEN {points}[0] = element_at({points}, -1) THEN {points} ELSE concat({points}, array({points}[0])) END"


def crosswalk_outline(edge1: str, edge2: str) -> str:
    """First edge, then the second one backwards, closed."""
    return close_outline(f"concat({edge1}, reverse({edge2}))")


def resample(df: DataFrame, points: str, count: int, out: str) -> DataFrame:
    """``count`` points uniform in arc length; a line without length keeps its first point."""
    length = fm.norm(f"{points}[i].x - {points}[i - 1].x", f"{points}[i].y - {points}[i - 1].y")
    df = df.withColumn("_arc", F.expr(f"aggregate(IF(size({points}) > 1, sequence(1, size({points}) - 1), CAST(array() AS ARRAY<INT>)), array(CAST(0 AS DOUBLE)), (a, i) -> concat(a, array(element_at(a, -1) + {length})))"))
    # index of the last vertex at or before the target, not beyond the last segment
    at = "greatest(1, least(size(_arc) - 1, size(filter(_arc, v -> v <= element_at(_arc, -1) * k / {n})))) - 1".format(n=count - 1)
    part = "CASE WHEN _arc[s + 1] > _arc[s] THEN (element_at(_arc, -1) * k / {n} - _arc[s]) / (_arc[s + 1] - _arc[s]) ELSE CAST(0 AS DOUBLE) END".format(n=count - 1)
    walk = f"transform(sequence(0, {count - 1}), k -> struct(k, {at} AS s))"
    df = df.withColumn("_walk", F.expr(walk)).withColumn("_walk", F.expr(f"transform(_walk, w -> struct(w.s AS s, {part.replace('k /', 'w.k /').replace('[s', '[w.s')} AS f))"))
    pick = f"struct({points}[w.s].x + w.f * ({points}[w.s + 1].x - {points}[w.s].x) AS x, {points}[w.s].y + w.f * ({points}[w.s + 1].y - {points}[w.s].y) AS y)"
    return df.withColumn(out, F.expr(f"CASE WHEN size({points}) < 2 OR element_at(_arc, -1) <= 1e-9 THEN slice({points}, 1, 1) ELSE transform(_walk, w -> {pick}) END")).drop("_arc", "_walk")


def fit(df: DataFrame, points: str, limit: int, out: str) -> DataFrame:
    """Resample only lines with more points than the limit."""
    return resample(df, points, limit, "_fit").withColumn(out, F.expr(f"CASE WHEN size({points}) <= {limit} THEN {points} ELSE _fit END")).drop("_fit")


def centerline(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (l, r) -> struct((l.x + r.x) / 2 AS x, (l.y + r.y) / 2 AS y))"


def tangents(points: str) -> str:
    """Unit central differences (one-sided at the ends), zero where the line does not move."""
    i = f"transform(sequence(0, size({points}) - 1), i -> struct(greatest(i - 1, 0) AS p, least(i + 1, size({points}) - 1) AS q))"
    d = f"transform({i}, j -> struct({points}[j.q].x - {points}[j.p].x AS x, {points}[j.q].y - {points}[j.p].y AS y))"
    n = fm.norm("d.x", "d.y")
    # central differences halve the step, which the unit length cancels
    return f"transform({d}, d -> CASE WHEN {n} > 1e-9 THEN struct(d.x / {n} AS x, d.y / {n} AS y) ELSE struct(CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y) END)"
