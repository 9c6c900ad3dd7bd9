"""Actor pairs, pair relations and pairwise safety metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators.grid import CELL, box_cells, exploded, point_cell

RADIUS = 70.0
SEGMENT_CELL = 10.0
HORIZON = 6.0


def near_pairs(left: DataFrame, right: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Ordered pairs within the radius, found through neighbouring grid cells only."""
    slim = lambda d, p: d.selectExpr("scenario_id", f"track_id AS {p}", f"object_type AS {p}_type", f"x AS {p}_px", f"y AS {p}_py")
    a = point_cell(slim(left, "a"), "a_px", "a_py", radius)
    b = box_cells(slim(right, "b"), "b_px", "b_py", "b_px", "b_py", radius, radius)
    dist = fm.norm("a_px - b_px", "a_py - b_py")
    return (a.join(b, CELL).where(f"a <> b AND {dist} <= {radius}")
            .selectExpr("scenario_id", "a", "b", "a_type", "b_type", f"{dist} AS dist"))


def related_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ordered pairs on the same lane or on lanes that are successors, predecessors or neighbours of each other, at any distance."""
    beside = "array_compact(array_distinct(concat(array(lane, left_id, right_id), coalesce(succ, array()), coalesce(pred, array()))))"
    slim = lambda d, p: d.where("lane IS NOT NULL").selectExpr("scenario_id", f"track_id AS {p}", f"object_type AS {p}_type", f"x AS {p}_px", f"y AS {p}_py", f"lane AS {p}_lane", f"{beside} AS {p}_beside")
    a, b = slim(left, "a"), slim(right, "b")
    spread = lambda d, p: exploded(d.withColumn("meet", F.explode(f"{p}_beside")))
    at = lambda d, p: d.withColumn("meet", F.col(f"{p}_lane"))
    both = spread(a, "a").join(at(b, "b"), ["scenario_id", "meet"]).unionByName(at(a, "a").join(spread(b, "b"), ["scenario_id", "meet"]))
    dist = fm.norm("a_px - b_px", "a_py - b_py")
    return both.where("a <> b").selectExpr("scenario_id", "a", "b", "a_type", "b_type", f"{dist} AS dist").distinct()


def attach(pairs: DataFrame, features: DataFrame, side: str, how: str = "inner") -> DataFrame:
    """Join per-actor features to one side of a pair under a prefix."""
    renamed = features.select("scenario_id", F.col("track_id").alias(side),
                              *[F.col(c).alias(f"{side}_{c}") for c in features.columns if c not in ("scenario_id", "track_id")])
    return pairs.join(renamed, ["scenario_id", side], how)


# --- expressions on a pair row ------------------------------------------------------------------
def fwd(o: str, r: str) -> str:
    return fm.forward(f"{o}_x - {r}_x", f"{o}_y - {r}_y", f"{r}_heading")


def lat(o: str, r: str) -> str:
    return fm.left(f"{o}_x - {r}_x", f"{o}_y - {r}_y", f"{r}_heading")


def gap(leader: str, follower: str) -> str:
    return f"(CASE WHEN {leader}_lane = {follower}_lane THEN {leader}_lane_arc - {follower}_lane_arc ELSE {fwd(leader, follower)} END)"


def same_or_successor(a: str, b: str) -> str:
    return (f"(CASE WHEN {a}_lane IS NULL OR {b}_lane IS NULL THEN abs({lat(a, b)}) <= 3.5 ELSE {a}_lane = {b}_lane "
            f"OR array_contains({b}_succ, {a}_lane) OR array_contains({a}_succ, {b}_lane) "
            f"OR array_contains({b}_pred, {a}_lane) OR array_contains({a}_pred, {b}_lane) END)")


def adjacent(a: str, b: str) -> str:
    eq = lambda p, q: f"coalesce({p} = {q}, false)"
    return (f"(CASE WHEN {a}_lane IS NULL OR {b}_lane IS NULL THEN abs({lat(a, b)}) > 3.5 AND abs({lat(a, b)}) < 10 ELSE "
            f"{eq(f'{b}_lane', f'{a}_left_id')} OR {eq(f'{b}_lane', f'{a}_right_id')} "
            f"OR {eq(f'{a}_lane', f'{b}_left_id')} OR {eq(f'{a}_lane', f'{b}_right_id')} END)")


def pair_ttc(a: str, b: str) -> str:
    return fm.ttc(f"({b}_x - {a}_x)", f"({b}_y - {a}_y)", f"({b}_vx - {a}_vx)", f"({b}_vy - {a}_vy)")


def angle(a: str, b: str) -> str:
    return fm.heading_gap(f"{a}_heading", f"{b}_heading")


def shared_future(a: str = "a", b: str = "b") -> tuple[str, str]:
    """Both future arrays cut to start at the later reference frame."""
    cut = lambda s, o: f"slice({s}_future, greatest({o}_ref_t - {s}_ref_t, 0) + 1, size({s}_future))"
    return cut(a, b), cut(b, a)


def with_min_ttc(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "min_ttc") -> DataFrame:
    """Least constant-velocity TTC over the shared future frames (NULL when there is none)."""
    pa, pb = shared_future(a, b)
    value = fm.ttc("(q.x - p.x)", "(q.y - p.y)", "(q.vx - p.vx)", "(q.vy - p.vy)")
    return pairs.withColumn(name, F.expr(f"array_min(zip_with({pa}, {pb}, (p, q) -> {value}))"))


def with_min_distance(pairs: DataFrame) -> DataFrame:
    """Closest synchronised distance with linear motion inside consecutive shared frames."""
    pa, pb = shared_future()
    rel = f"zip_with({pa}, {pb}, (p, q) -> struct(p.x - q.x AS x, p.y - q.y AS y))"
    move = fm.interval_distance("r.x", "r.y", "n.x", "n.y")
    still = fm.norm("r.x", "r.y")
    near = (f"array_min(zip_with(rel, slice(rel, 2, size(rel)), (r, n) -> CASE WHEN r.x IS NULL OR r.y IS NULL THEN NULL "
            f"WHEN n.x IS NULL OR n.y IS NULL THEN {still} ELSE {move} END))")
    return (pairs.withColumn("rel", F.expr(rel))
            .withColumn("min_dist", F.expr(f"CASE WHEN size(rel) > 0 THEN {near} END")).drop("rel"))


def with_path_distance(pairs: DataFrame) -> DataFrame:
    """Distance from actor a to the future path of actor b (the path bridges missing frames)."""
    fr = fm.seg_fraction("a_x", "a_y", "p.x", "p.y", "q.x", "q.y")
    seg = fm.norm(f"a_x - (p.x + {fr} * (q.x - p.x))", f"a_y - (p.y + {fr} * (q.y - p.y))")
    return (pairs.withColumn("path", F.expr("filter(b_future, p -> p.x IS NOT NULL AND p.y IS NOT NULL)"))
            .withColumn("path_dist", F.expr(
                f"CASE WHEN size(path) = 1 THEN {fm.norm('a_x - path[0].x', 'a_y - path[0].y')} WHEN size(path) > 1 THEN "
                f"array_min(zip_with(slice(path, 1, size(path) - 1), slice(path, 2, size(path)), (p, q) -> {seg})) END"))
            .drop("path"))


def headway_flags(limit: float, minimum_speed: float) -> str:
    """Per shared history frame: does b follow a within the headway limit?"""
    g = fm.forward("p.x - q.x", "p.y - q.y", "q.heading")
    v = fm.norm("q.vx", "q.vy")
    h = fm.headway(g, v)
    return (f"zip_with(slice(a_past, 1, least(size(a_past), size(b_past))), slice(b_past, 1, least(size(a_past), size(b_past))), "
            f"(p, q) -> coalesce(p.observed AND q.observed AND {v} >= {minimum_speed} AND {h} > 0 AND {h} <= {limit}, false))")


def path_segments(actors: DataFrame, isolated: bool = True) -> DataFrame:
    """Future motion primitives: consecutive valid frames, and isolated valid frames as zero-length ones (unless left out)."""
    ok = lambda p: f"({p}.x IS NOT NULL AND {p}.y IS NOT NULL)"
    body = ("transform(sequence(0, size(future) - 1), i -> struct(ref_t + i AS t, IF(i > 0, future[i - 1], NULL) AS o, "
            "future[i] AS p, IF(i + 1 < size(future), future[i + 1], NULL) AS q))")
    raw = actors.where("size(future) > 0").selectExpr("scenario_id", "track_id", f"inline({body})")
    alone = f"NOT coalesce({ok('o')}, false)" if isolated else "false"
    raw = raw.where(f"{ok('p')} AND (coalesce({ok('q')}, false) OR {alone})")
    linked = f"coalesce({ok('q')}, false)"
    return raw.selectExpr("scenario_id", "track_id", "t", "p.x AS x1", "p.y AS y1",
                          f"IF({linked}, q.x, p.x) AS x2", f"IF({linked}, q.y, p.y) AS y2",
                          "p.time_s AS s1", f"IF({linked}, q.time_s, p.time_s) AS s2")


def crossing(a: str = "a", b: str = "b") -> dict[str, str]:
    """Closed-form intersection of two primitives: fractions u and v (NULL when they do not meet)."""
    ax, ay = f"({a}_x2 - {a}_x1)", f"({a}_y2 - {a}_y1)"
    bx, by = f"({b}_x2 - {b}_x1)", f"({b}_y2 - {b}_y1)"
    ox, oy = f"({b}_x1 - {a}_x1)", f"({b}_y1 - {a}_y1)"
    la, lb = f"({ax} * {ax} + {ay} * {ay})", f"({bx} * {bx} + {by} * {by})"
    den = f"({ax} * {by} - {ay} * {bx})"
    u, v = f"(({ox} * {by} - {oy} * {bx}) / {den})", f"(({ox} * {ay} - {oy} * {ax}) / {den})"
    fa, fb = f"(({ox} * {ax} + {oy} * {ay}) / {la})", f"(0 - ({ox} * {bx} + {oy} * {by})) / {lb}"
    on_a = fm.norm(f"{b}_x1 - ({a}_x1 + {fm.clamp01(fa)} * {ax})", f"{b}_y1 - ({a}_y1 + {fm.clamp01(fa)} * {ay})")
    on_b = fm.norm(f"{a}_x1 - ({b}_x1 + {fm.clamp01(fb)} * {bx})", f"{a}_y1 - ({b}_y1 + {fm.clamp01(fb)} * {by})")
    unit = lambda e: f"({e}) BETWEEN -{fm.EPS} AND 1 + {fm.EPS}"
    zero = "CAST(0 AS DOUBLE)"
    case = lambda both, a0, b0, reg: (f"CASE WHEN {la} <= {fm.EPS} AND {lb} <= {fm.EPS} THEN {both} WHEN {la} <= {fm.EPS} THEN {a0} "
                                      f"WHEN {lb} <= {fm.EPS} THEN {b0} WHEN abs({den}) <= {fm.EPS} THEN NULL ELSE {reg} END")
    meet = f"CASE WHEN {fm.norm(ox, oy)} <= {fm.EPS} THEN {zero} END"
    hit_b = f"CASE WHEN {unit(fb)} AND {on_b} <= {fm.EPS} THEN {{}} END"
    hit_a = f"CASE WHEN {unit(fa)} AND {on_a} <= {fm.EPS} THEN {{}} END"
    reg = f"CASE WHEN {unit(u)} AND {unit(v)} THEN {{}} END"
    return {"u": case(meet, hit_b.format(zero), hit_a.format(fm.clamp01(fa)), reg.format(fm.clamp01(u))),
            "v": case(meet, hit_b.format(fm.clamp01(fb)), hit_a.format(zero), reg.format(fm.clamp01(v)))}


def boxes_meet() -> str:
    """Do the boxes of two primitives (prefixes a and b) overlap?"""
    return " AND ".join(f"least(a_{c}1, a_{c}2) <= greatest(b_{c}1, b_{c}2) + {fm.EPS} AND least(b_{c}1, b_{c}2) <= greatest(a_{c}1, a_{c}2) + {fm.EPS}" for c in "xy")


def close_segments(segs_a: DataFrame, segs_b: DataFrame) -> DataFrame:
    """Primitive pairs of different tracks with overlapping boxes (one grid cell reports each pair)."""
    pre = lambda d, p: d.select("scenario_id", F.col("track_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c not in ("scenario_id", "track_id")])
    cells = lambda d, p: box_cells(pre(d, p), f"least({p}_x1, {p}_x2)", f"least({p}_y1, {p}_y2)", f"greatest({p}_x1, {p}_x2)",
                                   f"greatest({p}_y1, {p}_y2)", SEGMENT_CELL, 1e-6)
    own = " AND ".join(f"cell_{c} = CAST(floor((greatest(least(a_{c}1, a_{c}2), least(b_{c}1, b_{c}2)) - 1e-6) / {SEGMENT_CELL}) AS BIGINT)" for c in "xy")
    return cells(segs_a, "a").join(cells(segs_b, "b"), CELL).where(f"a <> b AND {boxes_meet()} AND {own}").drop("cell_x", "cell_y")


def conflicts(actors: DataFrame, others: DataFrame | None = None, isolated: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """Per ordered pair the crossing of the two future paths with the least time gap (of ``pairs`` only, if given: scenario_id, a, b)."""
    others = actors if others is None else others
    if pairs is not None:  # actors without a partner on their side leave before their paths are cut into segments
        side = lambda p: pairs.select("scenario_id", F.col(p).alias("track_id")).distinct()
        actors, others = (d.join(side(p), ["scenario_id", "track_id"], "left_semi") for d, p in ((actors, "a"), (others, "b")))
    met = close_segments(path_segments(actors, isolated), path_segments(others, isolated))
    if pairs is not None:
        met = met.join(pairs.select("scenario_id", "a", "b").distinct(), ["scenario_id", "a", "b"], "left_semi")
    cut = crossing()
    met = met.withColumns({"u": F.expr(cut["u"]), "v": F.expr(cut["v"])}).where("u IS NOT NULL AND v IS NOT NULL")
    met = met.selectExpr("scenario_id", "a", "b", "a_t", "b_t", "a_x1 + u * (a_x2 - a_x1) AS cx", "a_y1 + u * (a_y2 - a_y1) AS cy",
                         "a_s1 + u * (a_s2 - a_s1) AS ta", "b_s1 + v * (b_s2 - b_s1) AS tb")
    best = met.groupBy("scenario_id", "a", "b").agg(
        F.expr("min(struct(abs(ta - tb) AS time_gap, greatest(ta, tb) AS last, a_t, b_t, ta, tb, cx, cy))").alias("c"))
    return best.selectExpr("scenario_id", "a", "b", "c.time_gap AS time_gap", "c.ta AS ta", "c.tb AS tb", "c.cx AS cx", "c.cy AS cy",
                           "c.a_t AS a_seg", "c.b_t AS b_seg")
