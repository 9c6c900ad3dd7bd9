"""Scalar formulas as SQL text (usable in ``F.expr``, lambdas and plain SQL)."""

from __future__ import annotations

EPS = "1e-9"


def wrap(a: str) -> str:
    """Angle in [-pi, pi)."""
    return f"(({a}) - 2 * pi() * floor((({a}) + pi()) / (2 * pi())))"


def heading_gap(a: str, b: str) -> str:
    """Smallest absolute heading difference in [0, pi]."""
    return f"abs({wrap(f'({a}) - ({b})')})"


def norm(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def forward(dx: str, dy: str, h: str) -> str:
    return f"(({dx}) * cos({h}) + ({dy}) * sin({h}))"


def left(dx: str, dy: str, h: str) -> str:
    return f"(({dy}) * cos({h}) - ({dx}) * sin({h}))"


def clamp01(v: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {v}))"


def score_small(v: str, bound: str) -> str:
    """1 at zero, 0 at the bound and beyond; missing scores 0."""
    return f"CASE WHEN ({v}) IS NULL THEN CAST(0 AS DOUBLE) ELSE {clamp01(f'1 - ({v}) / greatest({bound}, 1e-6)')} END"


def score_large(v: str, bound: str) -> str:
    return f"CASE WHEN ({v}) IS NULL THEN CAST(0 AS DOUBLE) ELSE {clamp01(f'({v}) / greatest({bound}, 1e-6)')} END"


def risk_score(v: str, low: float, high: float, higher_is_riskier: bool = False) -> str:
    """0.75 to 1 inside the target range, decaying outside."""
    pos = f"(({v}) - {low}) / {high - low}"
    inside = f"0.75 + 0.25 * ({pos if higher_is_riskier else '1 - ' + pos})" if high > low else "1.0"
    below = f"0.75 * ({score_large(v, str(low))})" if low > 0 else "0.0"
    above = f"0.75 * ({score_small(f'(({v}) - {high})', str(max(high - low, 1.0)))})"
    return (f"(CASE WHEN ({v}) IS NULL THEN CAST(0 AS DOUBLE) WHEN ({v}) BETWEEN {low} AND {high} THEN {inside} "
            f"WHEN ({v}) < {low} THEN {below} ELSE {above} END)")


def ttc(px: str, py: str, vx: str, vy: str, radius: float = 0.0) -> str:
    """Constant-velocity disc time to collision; NULL when there is none or an input is missing."""
    margin = f"(({px}) * ({px}) + ({py}) * ({py}) - {radius * radius})"
    speed2 = f"(({vx}) * ({vx}) + ({vy}) * ({vy}))"
    lin = f"(2 * (({px}) * ({vx}) + ({py}) * ({vy})))"
    disc = f"({lin} * {lin} - 4 * {speed2} * {margin})"
    root = f"sqrt(greatest({disc}, CAST(0 AS DOUBLE)))"
    early, late = f"((0 - {lin} - {root}) / (2 * {speed2}))", f"((0 - {lin} + {root}) / (2 * {speed2}))"
    return (f"(CASE WHEN {margin} IS NULL OR {speed2} IS NULL THEN NULL WHEN {margin} <= 0 THEN CAST(0 AS DOUBLE) "
            f"WHEN {speed2} <= {EPS} OR {disc} < -{EPS} THEN NULL "
            f"WHEN {early} >= -{EPS} THEN greatest(CAST(0 AS DOUBLE), {early}) "
            f"WHEN {late} >= -{EPS} THEN greatest(CAST(0 AS DOUBLE), {late}) END)")


def headway(gap: str, speed: str) -> str:
    """Seconds to cover the gap: 0 for no gap, NULL (infinite) when standing."""
    return (f"(CASE WHEN ({gap}) <= 0 THEN CAST(0 AS DOUBLE) WHEN ({speed}) <= {EPS} THEN NULL "
            f"ELSE ({gap}) / ({speed}) END)")


def seg_fraction(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """Clamped projection of a point on a segment, 0 on a degenerate one."""
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    dot = f"(({px} - {x1}) * {dx} + ({py} - {y1}) * {dy})"
    return f"(CASE WHEN sqrt({len2}) > {EPS} THEN {clamp01(f'{dot} / {len2}')} ELSE CAST(0 AS DOUBLE) END)"


def interval_distance(rx: str, ry: str, nx: str, ny: str) -> str:
    """Closest approach while a relative position moves linearly from (rx, ry) to (nx, ny)."""
    dx, dy = f"({nx} - {rx})", f"({ny} - {ry})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    fr = f"(CASE WHEN {len2} <= {EPS} THEN CAST(0 AS DOUBLE) ELSE {clamp01(f'(0 - ({rx} * {dx} + {ry} * {dy})) / {len2}')} END)"
    return norm(f"{rx} + {fr} * {dx}", f"{ry} + {fr} * {dy}")


def rounded(expr: str, digits: int = 6) -> str:
    """Stable output value: rounded, without a negative zero."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE)"
