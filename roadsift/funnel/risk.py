"""Risk metrics of a candidate over the wide frame rows (first role = overlay target).

Every metric is a least value per candidate with a status: computed, no_event, unavailable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import pairs as pr

E = fm.EPS
DECELERATION = 6.0          # fixed value: equal braking of both vehicles in m/s2
HALF = 2.0                  # fixed value: half side of the conflict square in m


def gap(lead: str, follow: str) -> str:
    return fm.forward(f"{lead}_x - {follow}_x", f"{lead}_y - {follow}_y", f"{follow}_heading")


def along(actor: str, follow: str) -> str:
    return fm.forward(f"{actor}_vx", f"{actor}_vy", f"{follow}_heading")


def headway(lead: str, follow: str) -> str:
    v = along(follow, follow)
    return f"CASE WHEN {gap(lead, follow)} <= 0 THEN CAST(0 AS DOUBLE) WHEN {v} > {E} THEN {gap(lead, follow)} / {v} END"


def stopping_margin(lead: str, follow: str) -> str:
    lv, fv = (f"greatest(CAST(0 AS DOUBLE), {along(s, follow)})" for s in (lead, follow))
    return f"{gap(lead, follow)} - greatest(CAST(0 AS DOUBLE), ({fv} * {fv} - {lv} * {lv}) / {2 * DECELERATION})"


def limited(value: str) -> str:
    """Drop times beyond the rest of the evaluated window."""
    return f"CASE WHEN ({value}) <= end_s - time_s + {E} THEN {value} END"


def longitudinal_ttc(lead: str, follow: str) -> str:
    closing = f"({along(follow, follow)} - {along(lead, follow)})"
    return limited(f"(CASE WHEN {gap(lead, follow)} <= 0 THEN CAST(0 AS DOUBLE) WHEN {closing} > {E} THEN {gap(lead, follow)} / {closing} END)")


def point_ttc(p: str, q: str) -> str:
    return limited(fm.ttc(f"({q}_x - {p}_x)", f"({q}_y - {p}_y)", f"({q}_vx - {p}_vx)", f"({q}_vy - {p}_vy)"))


def radial_ttc(p: str, q: str) -> str:
    d = fm.norm(f"{q}_x - {p}_x", f"{q}_y - {p}_y")
    closing = f"(0 - (({q}_vx - {p}_vx) * ({q}_x - {p}_x) + ({q}_vy - {p}_vy) * ({q}_y - {p}_y)) / {d})"
    return limited(f"(CASE WHEN {d} <= {E} THEN CAST(0 AS DOUBLE) WHEN {closing} > {E} THEN {d} / {closing} END)")


def lateral_ttc(p: str, q: str) -> str:
    """Separation over closing speed on the normal of the mean heading."""
    ax, ay = f"(cos({p}_heading) + cos({q}_heading))", f"(sin({p}_heading) + sin({q}_heading))"
    n = f"sqrt({ax} * {ax} + {ay} * {ay})"
    ux, uy = f"(CASE WHEN {n} <= {E} THEN cos({p}_heading) ELSE {ax} / {n} END)", f"(CASE WHEN {n} <= {E} THEN sin({p}_heading) ELSE {ay} / {n} END)"
    sep = f"(({q}_y - {p}_y) * {ux} - ({q}_x - {p}_x) * {uy})"
    vel = f"(({q}_vy - {p}_vy) * {ux} - ({q}_vx - {p}_vx) * {uy})"
    raw = f"(CASE WHEN abs({sep}) <= {E} THEN CAST(0 AS DOUBLE) WHEN abs({vel}) > {E} AND 0 - {sep} / {vel} >= 0 THEN 0 - {sep} / {vel} END)"
    return limited(raw)


def square_distance(p: str, half: float = HALF) -> str:
    """Distance of an actor to the axis-aligned conflict square around (px, py); zero inside, NULL without a point or a position."""
    dx, dy = (f"greatest(abs({p}_{c} - p{c}) - {half}, CAST(0 AS DOUBLE))" for c in "xy")
    return f"(CASE WHEN {p}_x IS NOT NULL AND px IS NOT NULL THEN {fm.norm(dx, dy)} END)"


def inside_square(p: str, half: float = HALF) -> str:
    return f"({p}_x BETWEEN px - {half} AND px + {half} AND {p}_y BETWEEN py - {half} AND py + {half})"


def least(wide: DataFrame, anchor: int, pairs: list[tuple[str, str]], formula, had: str = "true", start: str = "true") -> DataFrame:
    """Least value over future frames and role pairs, with the pair and frame that gave it (ties by pair, then frame)."""
    rows = wide.where(f"timestep > {anchor}").where(start)
    items = ", ".join(f"struct({formula(*p)} AS value, '{p[0]}->{p[1]}' AS pair)" for p in pairs)
    flat = rows.selectExpr("candidate_id", "timestep", f"({had}) AS had", f"inline(array({items}))")
    g = flat.groupBy("candidate_id").agg(F.expr("min(struct(value, pair, timestep)) FILTER (WHERE value IS NOT NULL)").alias("m"), F.expr("coalesce(bool_or(had), false)").alias("had"))
    return g.selectExpr("candidate_id", "m.value AS value", "m.pair AS pair", "m.timestep AS frame",
                        "CASE WHEN m IS NOT NULL THEN 'computed' WHEN had THEN 'no_event' ELSE 'unavailable' END AS status")


def with_end(wide: DataFrame, end_s: float) -> DataFrame:
    return wide.withColumn("end_s", F.lit(end_s))


def clearance(wide: DataFrame, anchor: int, pairs: list[tuple[str, str]]) -> DataFrame:
    """Closest synchronised centre distance with linear motion between consecutive frames."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    rel = {f"{p}{q}_{c}": f"{p}_{c} - {q}_{c}" for p, q in pairs for c in "xy"}
    rows = wide.where(f"timestep > {anchor}").selectExpr("candidate_id", "timestep", *[f"{e} AS {n}" for n, e in rel.items()])
    nxt = rows.selectExpr("*", *[f"lead({n}) {w} AS n_{n}" for n in rel], f"lead(timestep) {w} AS n_t")
    item = lambda p, q: (f"struct(CASE WHEN n_t = timestep + 1 AND n_{p}{q}_x IS NOT NULL THEN {fm.interval_distance(f'{p}{q}_x', f'{p}{q}_y', f'n_{p}{q}_x', f'n_{p}{q}_y')} "
                         f"ELSE {fm.norm(f'{p}{q}_x', f'{p}{q}_y')} END AS value, '{p}->{q}' AS pair)")
    flat = nxt.selectExpr("candidate_id", f"inline(array({', '.join(item(*p) for p in pairs)}))").where("value IS NOT NULL")
    return flat.groupBy("candidate_id").agg(F.expr("min(struct(value, pair))").alias("m")).selectExpr("candidate_id", "m.value AS value", "m.pair AS pair", "'computed' AS status")


def path_segments(wide: DataFrame, role: str) -> DataFrame:
    """Consecutive frames of one role as segments keyed like a scenario."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    s = wide.where(f"{role}_x IS NOT NULL").selectExpr("candidate_id AS scenario_id", f"'{role}' AS track_id", "timestep AS t", f"{role}_x AS x1", f"{role}_y AS y1", "time_s AS s1",
                                                      f"lead({role}_x) {w} AS x2", f"lead({role}_y) {w} AS y2", f"lead(time_s) {w} AS s2", f"lead(timestep) {w} AS nt")
    return s.where("nt = t + 1").drop("nt")


def collinear(a: str = "a", b: str = "b") -> str:
    """Do two segments run along the same line with a common part?"""
    la, lb = fm.norm(f"{a}_x2 - {a}_x1", f"{a}_y2 - {a}_y1"), fm.norm(f"{b}_x2 - {b}_x1", f"{b}_y2 - {b}_y1")
    ux, uy = f"(({a}_x2 - {a}_x1) / {la})", f"(({a}_y2 - {a}_y1) / {la})"
    cross = f"abs({ux} * ({b}_y2 - {b}_y1) - {uy} * ({b}_x2 - {b}_x1)) / {lb} <= 1e-7"
    off = f"abs({ux} * ({b}_y1 - {a}_y1) - {uy} * ({b}_x1 - {a}_x1)) <= 1e-7"
    p, q = (f"(({b}_x{i} - {a}_x1) * {ux} + ({b}_y{i} - {a}_y1) * {uy})" for i in (1, 2))
    common = f"least({la}, greatest({p}, {q})) - greatest(CAST(0 AS DOUBLE), least({p}, {q})) > {E}"
    return f"({la} > {E} AND {lb} > {E} AND {cross} AND {off} AND {common})"


def path_gap(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Arrival gap at the crossing of two paths, anchor included; a shared straight path has no unique crossing.

    The frames of a candidate (at most 61) are shuffled once by candidate; segments with overlapping boxes meet inside its row.
    """
    roles = sorted({r for pair in pairs for r in pair})
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    nxt = [f"lead({r}_{c}) {w} AS n_{r}_{c}" for r in roles for c in "xy"]
    rows = wide.selectExpr("candidate_id", "timestep", "time_s", *[f"{r}_{c}" for r in roles for c in "xy"], f"lead(time_s) {w} AS n_s", f"lead(timestep) {w} AS n_t", *nxt)
    seg = lambda r: f"struct(timestep AS t, {r}_x AS x1, {r}_y AS y1, time_s AS s1, n_{r}_x AS x2, n_{r}_y AS y2, n_s AS s2)"
    paths = rows.where("n_t = timestep + 1").groupBy("candidate_id").agg(*[F.expr(f"collect_list({seg(r)}) FILTER (WHERE {r}_x IS NOT NULL AND n_{r}_x IS NOT NULL)").alias(r) for r in roles])
    met = paths.selectExpr("candidate_id", "inline(array(" + ", ".join(f"struct('{p}->{q}' AS pair, {p} AS ps, {q} AS qs)" for p, q in pairs) + "))")
    side = lambda p: [f"{p}_{c}" for c in ("t", "x1", "y1", "s1", "x2", "y2", "s2")]
    met = met.selectExpr("candidate_id", "pair", "qs", f"inline(ps) AS ({', '.join(side('a'))})")
    met = met.selectExpr("candidate_id", "pair", *side("a"), f"inline(qs) AS ({', '.join(side('b'))})").where(pr.boxes_meet())
    cut = pr.crossing()
    met = met.withColumns({"u": F.expr(cut["u"]), "v": F.expr(cut["v"]), "line": F.expr(collinear())})
    met = met.selectExpr("candidate_id", "pair", "line", "a_t", "b_t", "a_s1 + u * (a_s2 - a_s1) AS ta", "b_s1 + v * (b_s2 - b_s1) AS tb",
                         "a_x1 + u * (a_x2 - a_x1) AS cx", "a_y1 + u * (a_y2 - a_y1) AS cy")
    per = met.groupBy("candidate_id", "pair").agg(
        F.expr("min(struct(abs(ta - tb) AS value, greatest(ta, tb) AS late, a_t, b_t, ta, tb, cx, cy)) FILTER (WHERE ta IS NOT NULL AND tb IS NOT NULL)").alias("m"), F.expr("bool_or(line)").alias("line"))
    best = per.groupBy("candidate_id").agg(F.expr("min(struct(m.value AS value, pair, m.cx AS cx, m.cy AS cy)) FILTER (WHERE m IS NOT NULL)").alias("m"), F.expr("bool_or(line AND m IS NULL)").alias("line"))
    ids = wide.select("candidate_id").distinct()
    return ids.join(best, "candidate_id", "left").selectExpr(
        "candidate_id", "m.value AS value", "m.pair AS pair", "m.cx AS cx", "m.cy AS cy",
        "CASE WHEN m IS NOT NULL THEN 'computed' WHEN coalesce(line, false) THEN 'unavailable' ELSE 'no_event' END AS status")


def intrusion_margin(wide: DataFrame, anchor: int) -> DataFrame:
    return least(wide, anchor, [("a", "a")], lambda p, _: square_distance(p))


def occupancy_overlap(wide: DataFrame, anchor: int) -> DataFrame:
    """Time both actors are inside the square, each frame held until the next one."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    rows = wide.where(f"timestep > {anchor}").selectExpr("candidate_id", "timestep", f"lead(time_s) {w} - time_s AS hold", f"{inside_square('a')} AND {inside_square('b')} AS both")
    g = rows.where("hold IS NOT NULL AND both IS NOT NULL").groupBy("candidate_id").agg(F.expr("coalesce(sum(hold) FILTER (WHERE both), CAST(0 AS DOUBLE))").alias("value"))
    return g.withColumn("status", F.lit("computed"))


def first_intrusion(wide: DataFrame, anchor: int) -> DataFrame:
    """TTC at the first frame where the target steps into the square."""
    w = "OVER (PARTITION BY candidate_id ORDER BY timestep)"
    ttc = point_ttc("b", "a")
    rows = wide.selectExpr("*", f"{inside_square('a')} AND NOT lag({inside_square('a')}) {w} AS enters").where(f"timestep > {anchor}")
    g = rows.where("enters").groupBy("candidate_id").agg(F.expr(f"min_by(struct(timestep AS frame, {ttc} AS value, b_x IS NOT NULL AND b_vx IS NOT NULL AS seen), timestep)").alias("m"))
    ids = wide.select("candidate_id").distinct().join(g, "candidate_id", "left")
    return ids.selectExpr("candidate_id", "m.frame AS frame", "m.value AS value",
                          "CASE WHEN m IS NULL THEN 'no_event' WHEN NOT m.seen THEN 'unavailable' WHEN m.value IS NULL THEN 'no_event' ELSE 'computed' END AS status")
