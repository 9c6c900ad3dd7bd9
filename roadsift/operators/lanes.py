"""Map tables and point-to-lane operators (grid range joins, never lane x actor products)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators.grid import CELL, box_cells, exploded, point_cell

LANE_CELL = 20.0
LANE_RADIUS = 5.0
HEADING_TOLERANCE = "radians(60)"


def segments(polylines: DataFrame) -> DataFrame:
    """Consecutive finite vertex pairs with arc start; a missing vertex breaks the line.

    The arc start sums the lengths of the kept segments only.  A line without any
    segment gives zero-length ones, so that its nearest vertex can still be found.
    """
    pair = ("filter(transform(sequence(1, size(points) - 1), i -> struct(i - 1 AS seq, points[i - 1].x AS x1, "
            "points[i - 1].y AS y1, points[i].x AS x2, points[i].y AS y2)), "
            "s -> s.x1 IS NOT NULL AND s.y1 IS NOT NULL AND s.x2 IS NOT NULL AND s.y2 IS NOT NULL)")
    dots = ("transform(filter(points, p -> p.x IS NOT NULL AND p.y IS NOT NULL), "
            "p -> struct(-1 AS seq, p.x AS x1, p.y AS y1, p.x AS x2, p.y AS y2))")
    s = polylines.withColumn("pairs", F.expr(f"CASE WHEN size(points) > 1 THEN {pair} ELSE filter({dots}, s -> false) END"))
    s = s.withColumn("pairs", F.expr(f"CASE WHEN size(pairs) > 0 THEN pairs ELSE {dots} END"))
    length = fm.norm("s.x2 - s.x1", "s.y2 - s.y1")
    s = s.withColumn("sums", F.expr(f"aggregate(pairs, array(CAST(0 AS DOUBLE)), (acc, s) -> "
                                    f"concat(acc, array(element_at(acc, -1) + {length})))"))
    s = s.selectExpr("scenario_id", "polyline_id", "polyline_type", "lane_id", "direction", "is_intersection",
                     "exists(points, p -> p.x IS NULL OR p.y IS NULL) AS broken",
                     "inline(arrays_zip(pairs, sums))")
    s = s.selectExpr("scenario_id", "polyline_id", "polyline_type", "lane_id", "direction", "is_intersection", "broken",
                     "pairs.seq AS seq", "pairs.x1 AS x1", "pairs.y1 AS y1", "pairs.x2 AS x2", "pairs.y2 AS y2",
                     "sums AS arc_start").where("seq IS NOT NULL")
    return exploded(s)


def lanes(polylines: DataFrame) -> DataFrame:
    """Lane attributes with length, first point and the headings of both ends."""
    step = "filter(transform(sequence(1, size(points) - 1), i -> struct(points[i].x - points[i - 1].x AS dx, " \
           "points[i].y - points[i - 1].y AS dy)), d -> d.dx IS NOT NULL AND d.dy IS NOT NULL)"
    d = polylines.where("polyline_type = 'lane_centerline' AND size(points) > 1").withColumn("steps", F.expr(step))
    long = f"filter(steps, d -> {fm.norm('d.dx', 'd.dy')} > 1e-6)"
    return d.selectExpr(
        "scenario_id", "polyline_id", "lane_id", "direction", "is_intersection", "predecessor_ids AS pred", "successor_ids AS succ",
        "left_neighbor_id AS left_id", "right_neighbor_id AS right_id",
        f"aggregate(steps, CAST(0 AS DOUBLE), (a, d) -> a + {fm.norm('d.dx', 'd.dy')}) AS lane_length",
        "points[0].x AS first_x", "points[0].y AS first_y",
        f"element_at({long}, 1) AS head", f"element_at({long}, -1) AS tail").selectExpr(
        "*", "atan2(head.dy, head.dx) AS start_heading", "atan2(tail.dy, tail.dx) AS end_heading").drop("head", "tail")


def lane_edges(polylines: DataFrame) -> DataFrame:
    """Successor, predecessor and neighbour relations as (src, dst, rel)."""
    lane = polylines.where("polyline_type = 'lane_centerline' AND lane_id IS NOT NULL")
    return exploded(lane.selectExpr(
        "scenario_id", "lane_id AS src",
        "inline(concat(transform(successor_ids, d -> struct(d AS dst, 'successor' AS rel)), "
        "transform(predecessor_ids, d -> struct(d AS dst, 'predecessor' AS rel)), "
        "transform(array_compact(array(left_neighbor_id)), d -> struct(d AS dst, 'left' AS rel)), "
        "transform(array_compact(array(right_neighbor_id)), d -> struct(d AS dst, 'right' AS rel))))"))


def project(df: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """Clamped projection of (px, py) on the row's segment: distance, fraction, arc, heading, signed lateral."""
    df = df.withColumn("fraction", F.expr(fm.seg_fraction(px, py, "x1", "y1", "x2", "y2")))
    dx, dy = f"({px} - (x1 + fraction * (x2 - x1)))", f"({py} - (y1 + fraction * (y2 - y1)))"
    length = fm.norm("x2 - x1", "y2 - y1")
    df = df.withColumns({"distance": F.expr(fm.norm(dx, dy)), "arc": F.expr(f"arc_start + fraction * {length}"),
                         "lane_heading": F.expr(f"CASE WHEN {length} > {fm.EPS} THEN atan2(y2 - y1, x2 - x1) END")})
    return df.withColumn("lateral_m", F.expr(f"cos(lane_heading) * {dy} - sin(lane_heading) * {dx}"))


def nearby_segments(points: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """Points (scenario_id, px, py, ...) joined to the segments whose box is within the radius."""
    size = max(radius, LANE_CELL)
    boxed = box_cells(segs, "least(x1, x2)", "least(y1, y2)", "greatest(x1, x2)", "greatest(y1, y2)", size, radius)
    near = (f"px BETWEEN least(x1, x2) - {radius} AND greatest(x1, x2) + {radius} AND "
            f"py BETWEEN least(y1, y2) - {radius} AND greatest(y1, y2) + {radius}")
    return project(point_cell(points, "px", "py", size).join(boxed, CELL).where(near)).drop("cell_x", "cell_y")


PROJECTION = ("distance", "seq", "fraction", "arc", "lane_heading", "lateral_m")


def nearest_per_line(points: DataFrame, segs: DataFrame, keys: list[str], radius: float | None = None) -> DataFrame:
    """Best projection per (point, polyline), ties by segment then fraction; within the radius, or on every polyline of the scenario."""
    hit = project(points.join(segs, "scenario_id")) if radius is None else nearby_segments(points, segs, radius).where(f"distance <= {radius}")
    return (hit.groupBy("scenario_id", *keys, "polyline_id").agg(F.min(F.struct(*PROJECTION)).alias("m"))
            .select("scenario_id", *keys, "polyline_id", "m.*"))


def nearest_line(points: DataFrame, segs: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Nearest polyline of each point (m: distance, polyline_id), at any distance.

    The radius only divides the work: a point with nothing inside it is compared with every polyline of its scenario.
    """
    best = lambda hits: hits.groupBy("scenario_id", *keys).agg(F.min(F.struct("distance", "polyline_id")).alias("m"))
    near = best(nearby_segments(points, segs, radius).where(f"distance <= {radius}"))
    far = points.join(near, ["scenario_id", *keys], "left_anti")
    return near.unionByName(best(project(far.join(segs, "scenario_id"))))


def nearest_distance(points: DataFrame, segs: DataFrame, keys: list[str], radius: float = 60.0, far: bool = True) -> DataFrame:
    """Distance to the nearest of all segments: near ones by grid, the rest by a second exact pass.

    The second pass joins on the scenario alone, but only for points without anything inside the
    radius; its minimum aggregates before the shuffle.  Callers that only compare with a bound
    below the radius skip it (``far=False``) and read a missing distance as "beyond the radius".
    """
    hit = nearby_segments(points, segs, radius).where(f"distance <= {radius}")
    near = hit.groupBy("scenario_id", *keys).agg(F.min("distance").alias("distance"))
    if not far:
        return near
    far = points.join(near, ["scenario_id", *keys], "left_anti")
    rest = (project(far.join(segs, "scenario_id")).groupBy("scenario_id", *keys).agg(F.min("distance").alias("distance")))
    return near.unionByName(rest)


def match_candidates(actors: DataFrame, polylines: DataFrame, radius: float = LANE_RADIUS) -> DataFrame:
    """Every allowed lane within the radius of an actor, with its projection and heading error."""
    pts = (actors.where("object_type NOT IN ('static', 'construction', 'pedestrian')")
           .selectExpr("scenario_id", "track_id", "object_type", "x AS px", "y AS py", "heading"))
    line = segments(polylines.where("polyline_type = 'lane_centerline'")).where("NOT broken")
    hit = nearby_segments(pts, line, radius).where(
        f"distance <= {radius} AND (direction = 'unknown' OR CASE WHEN object_type = 'cyclist' "
        "THEN direction = 'bike' ELSE direction IN ('vehicle', 'bus') END)")
    best = (hit.groupBy("scenario_id", "track_id", "heading", "polyline_id", "is_intersection")
            .agg(F.min(F.struct(*PROJECTION)).alias("m")).selectExpr(
                "scenario_id", "track_id", "polyline_id", "is_intersection", "heading", "m.*"))
    return best.withColumn("heading_error", F.expr(fm.heading_gap("heading", "lane_heading")))


def lane_matches(actors: DataFrame, polylines: DataFrame, radius: float = LANE_RADIUS) -> DataFrame:
    """Aligned (heading within 60 degrees) and geometric lane match per actor."""
    order = "struct(distance, heading_error, polyline_id, arc, lateral_m, lane_heading)"
    best = match_candidates(actors, polylines, radius).groupBy("scenario_id", "track_id").agg(
        F.expr(f"min({order}) FILTER (WHERE heading_error <= {HEADING_TOLERANCE})").alias("a"),
        F.expr(f"min({order})").alias("g"))
    return best.selectExpr(
        "scenario_id", "track_id", "a.polyline_id AS lane", "a.distance AS lane_dist", "a.heading_error AS lane_error",
        "a.arc AS lane_arc", "a.lateral_m AS lane_lateral", "g.polyline_id AS any_lane", "g.distance AS any_dist",
        "g.heading_error AS any_error", "g.lane_heading AS any_heading")


def points_in_areas(points: DataFrame, polylines: DataFrame, keys: list[str], include_boundary: bool = False,
                    minimum_vertices: int = 4) -> DataFrame:
    """Keys of the points inside any of the areas (ray cast on edges met by the point's row of cells)."""
    ring = "filter(points, p -> p.x IS NOT NULL AND p.y IS NOT NULL)"
    areas = polylines.selectExpr("scenario_id", "polyline_id", f"{ring} AS ring").where(f"size(ring) >= {minimum_vertices}")
    edges = areas.selectExpr(
        "scenario_id", "polyline_id", "array_min(transform(ring, p -> p.x)) AS lo_x", "array_max(transform(ring, p -> p.x)) AS hi_x",
        "array_min(transform(ring, p -> p.y)) AS lo_y", "array_max(transform(ring, p -> p.y)) AS hi_y",
        "inline(transform(sequence(0, size(ring) - 1), i -> struct(ring[i].x AS x2, ring[i].y AS y2, "
        "ring[(i + size(ring) - 1) % size(ring)].x AS x1, ring[(i + size(ring) - 1) % size(ring)].y AS y1)))")
    # only edges crossing the point's horizontal strip matter to the ray; the area box limits it to the x cells of the area
    strip = box_cells(edges, "lo_x", "least(y1, y2)", "hi_x", "greatest(y1, y2)", 50.0, 1e-6)
    hit = (point_cell(points, "px", "py", 50.0).join(strip, CELL)
           .where("px BETWEEN lo_x - 1e-8 AND hi_x + 1e-8 AND py BETWEEN lo_y - 1e-8 AND hi_y + 1e-8"))
    crosses = "CASE WHEN (y2 > py) <> (y1 > py) AND px < (x1 - x2) * (py - y2) / (y1 - y2) + x2 THEN 1 ELSE 0 END"
    cut = fm.seg_fraction("px", "py", "x1", "y1", "x2", "y2")
    edge = f"{fm.norm(f'px - (x1 + {cut} * (x2 - x1))', f'py - (y1 + {cut} * (y2 - y1))')} <= 1e-8"
    per = hit.groupBy("scenario_id", *keys, "polyline_id").agg(
        F.expr(f"sum({crosses}) % 2 = 1").alias("inside"), F.expr(f"bool_or({edge})").alias("on_edge"))
    inside = per.where("inside OR on_edge" if include_boundary else "inside")
    return inside.select("scenario_id", *keys).distinct()


def actor_places(actors: DataFrame, polylines: DataFrame, far: bool = True) -> DataFrame:
    """Crosswalk distance (0 inside), drivable-area membership and boundary distance per actor."""
    pts = actors.selectExpr("scenario_id", "track_id", "x AS px", "y AS py")
    cross, area = (polylines.where(F.col("polyline_type") == t) for t in ("pedestrian_crossing", "drivable_area"))
    zero = points_in_areas(pts, cross, ["track_id"]).withColumn("in_cross", F.lit(True))
    near = nearest_distance(pts, segments(cross), ["track_id"], 20.0 if not far else 60.0, far).withColumnRenamed("distance", "cross_edge")
    inside = points_in_areas(pts, area, ["track_id"]).withColumn("in_area", F.lit(True))
    edge = nearest_distance(pts, segments(area), ["track_id"], 20.0 if not far else 60.0, far).withColumnRenamed("distance", "boundary_dist")
    key = ["scenario_id", "track_id"]
    return (actors.select(*key).join(zero, key, "left").join(near, key, "left").join(inside, key, "left")
            .join(edge, key, "left").selectExpr(*key, "CASE WHEN in_cross THEN CAST(0 AS DOUBLE) ELSE cross_edge END AS cross_dist",
                                                "coalesce(in_area, false) AS inside_area", "boundary_dist"))


def intersection_distance(actors: DataFrame, polylines: DataFrame, radius: float = 70.0) -> DataFrame:
    """Nearest intersection lane and its distance (NULL when none within the radius)."""
    pts = actors.selectExpr("scenario_id", "track_id", "x AS px", "y AS py")
    line = segments(polylines.where("polyline_type = 'lane_centerline' AND is_intersection")).where("NOT broken")
    best = nearest_per_line(pts, line, ["track_id"], radius).groupBy("scenario_id", "track_id").agg(
        F.min(F.struct("distance", "polyline_id")).alias("m"))
    return best.selectExpr("scenario_id", "track_id", "m.distance AS cross_lane_dist", "m.polyline_id AS cross_lane")


def project_on(points: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Project points (scenario_id, *keys, polyline_id, px, py) on the one polyline named in their row."""
    hit = project(points.join(segs, ["scenario_id", "polyline_id"]))
    return (hit.groupBy("scenario_id", "polyline_id", *keys).agg(F.min(F.struct(*PROJECTION)).alias("m"))
            .select("scenario_id", "polyline_id", *keys, "m.*"))


def lane_attributes(polylines: DataFrame) -> DataFrame:
    """`lanes` plus whether at least two successors name the lane as their predecessor."""
    lane = lanes(polylines)
    back = exploded(lane.selectExpr("scenario_id", "polyline_id AS dst", "explode(pred) AS polyline_id"))
    ahead = exploded(lane.selectExpr("scenario_id", "polyline_id", "explode(succ) AS dst"))
    fork = (ahead.join(back, ["scenario_id", "polyline_id", "dst"]).groupBy("scenario_id", "polyline_id")
            .agg(F.count_distinct("dst").alias("n")).where("n >= 2").selectExpr("scenario_id", "polyline_id", "true AS fork"))
    return lane.join(fork.hint("merge"), ["scenario_id", "polyline_id"], "left").withColumn("diverges", F.expr("coalesce(fork, false)")).drop("fork")


def with_lanes(actors: DataFrame, polylines: DataFrame) -> DataFrame:
    """Actors with both lane matches and the attributes of the matched lanes."""
    attrs = lane_attributes(polylines).hint("merge")
    own = attrs.selectExpr("scenario_id", "polyline_id AS lane", "succ", "pred", "left_id", "right_id", "is_intersection AS in_cross",
                           "lane_length", "end_heading AS lane_end_heading", "diverges", "first_x AS lane_x", "first_y AS lane_y")
    other = attrs.selectExpr("scenario_id", "polyline_id AS any_lane", "succ AS any_succ")
    m = lane_matches(actors, polylines).join(own, ["scenario_id", "lane"], "left").join(other, ["scenario_id", "any_lane"], "left")
    return actors.join(m.hint("merge"), ["scenario_id", "track_id"], "left")


def map_features(polylines: DataFrame) -> DataFrame:
    """The named map features a scenario offers, one array per scenario."""
    lane = "polyline_type = 'lane_centerline'"
    has = {
        "lane_centerline": lane, "lane_successor": f"{lane} AND size(successor_ids) > 0",
        "adjacent_lane": f"{lane} AND (left_neighbor_id IS NOT NULL OR right_neighbor_id IS NOT NULL)",
        "diverging_lane": f"{lane} AND size(successor_ids) >= 2", "intersection_lane": f"{lane} AND is_intersection",
        "pedestrian_crossing": "polyline_type = 'pedestrian_crossing'", "drivable_area": "polyline_type = 'drivable_area'",
        "bike_lane": f"{lane} AND direction = 'bike'", "lane_direction": f"{lane} AND size(points) >= 2"}
    flags = [F.expr(f"coalesce(bool_or({c}), false)").alias(n) for n, c in has.items()]
    base = polylines.groupBy("scenario_id").agg(*flags, F.expr(f"coalesce(bool_or({lane} AND size(predecessor_ids) >= 2), false)").alias("many_pred"))
    shared = (polylines.where(lane).selectExpr("scenario_id", "explode(successor_ids) AS s").groupBy("scenario_id", "s").count()
              .where("count >= 2").select("scenario_id").distinct().withColumn("shared", F.lit(True)))
    names = [*has, "converging_lane"]
    wide = base.join(shared, "scenario_id", "left").withColumn("converging_lane", F.expr("many_pred OR coalesce(shared, false)"))
    return wide.select("scenario_id", F.expr("array_compact(array(" + ", ".join(f"IF({n}, '{n}', NULL)" for n in names) + "))").alias("features"))


def transitions(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of lane along the frames (repeats and unassigned frames dropped)."""
    w = Window.partitionBy(*keys).orderBy("timestep")
    s = assigned.where("lane IS NOT NULL").withColumn("src", F.lag("lane").over(w))
    return s.where("src <> lane").select(*keys, "timestep", "src", F.col("lane").alias("dst"))


def forbidden_transitions(moves: DataFrame, polylines: DataFrame) -> DataFrame:
    """Transitions between lanes that are neither neighbours nor linked either way."""
    edges = lane_edges(polylines).select("scenario_id", "src", "dst")
    both = edges.unionByName(edges.selectExpr("scenario_id", "dst AS src", "src AS dst")).distinct()
    return moves.join(both, ["scenario_id", "src", "dst"], "left_anti").select(*moves.columns)
