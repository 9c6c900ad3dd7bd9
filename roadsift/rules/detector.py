"""Rule scan: scenario gates, one gated pair table, pair rules in a single pass, triple rules, ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from roadsift.functions import formulas as fm
from roadsift.operators import lanes as ln, pairs as pr, tracks as tr
from roadsift.rules import pair_rules as prules, triple_rules
from roadsift.rules.catalog import CATALOG, RULES, Rule
from roadsift.session import materialize
from roadsift.rules.pair_rules import all_of, any_of, bound_list

KEY = ["scenario_id", "track_id"]
MATCH = ["scenario_id", "skill_id", "initiator", "responder", "extra", "score", "risk_metric", "risk_value",
         "measured", "context", "initiator_lane", "responder_lane", "target_lane", "shared_steps"]


def _bit(skills: list[str], keep: str, columns: dict[str, str]) -> str:
    return " | ".join(f"(CASE WHEN {columns[s]} AND {keep} THEN {1 << i}L ELSE 0L END)" for i, s in enumerate(skills)) or "0L"


def gated_actors(states: DataFrame | None, polylines: DataFrame | None, rules: list[Rule], actors: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Actors with one bit per rule they may initiate or respond to (types, history, scenario gates: those of the map's ``features``, if given)."""
    actors = tr.actors(states) if actors is None else actors
    kinds = actors.groupBy("scenario_id").agg(F.collect_set("object_type").alias("kinds"))
    offer = kinds.join(ln.map_features(polylines) if features is None else features, "scenario_id", "left")
    words = lambda ws: "array(" + ", ".join(f"'{w}'" for w in ws) + ")"
    ok = {r.skill_id: f"size(array_except({words(r.required_tracks)}, kinds)) = 0 AND size(array_except({words(r.required_map)}, "
                      "coalesce(features, array()))) = 0" for r in rules}
    gates = offer.selectExpr("scenario_id", *[f"{e} AS gate_{s}" for s, e in ok.items()])
    names = [r.skill_id for r in rules]

    def mask(attr: str) -> str:
        cols = {r.skill_id: f"gate_{r.skill_id} AND hist_steps >= {r.history} AND object_type IN ("
                + ", ".join(f"'{t}'" for t in getattr(r, attr)) + ")" for r in rules}
        return _bit(names, "true", cols)
    wide = actors.join(gates, "scenario_id")
    return (wide.withColumns({"init_mask": F.expr(mask("initiator_types")), "resp_mask": F.expr(mask("responder_types"))})
            .drop(*[f"gate_{s}" for s in names]))


FRAME_FEATURES = {"min_ttc", "min_dist", "path", "headway", "opposite"}
_SIDES = (("a", "b"), ("b", "a"))
# longest first: the pieces of a longer relation must not be replaced inside it
SHARED = sorted({f(*ab) for f in (pr.gap, pr.same_or_successor, pr.adjacent, pr.pair_ttc, pr.angle, pr.fwd, pr.lat) for ab in _SIDES}, key=len, reverse=True)
BIT = {skill: 1 << i for i, skill in enumerate(RULES)}
TRIPLE_RULES = tuple(r.skill_id for r in CATALOG if len(r.roles) == 3)
#: Scans of more rules write their features and matches part by part: the plan of one part stays small, whatever the number of rules.
MANY, PART = 6, 6


#: Columns of an actor that come from frames after its reference frame; needs that read none.
LATER = r"\b[ab]_(future|lateral|turn|min_speed|min_accel|end_x|end_y|end_heading)\b"
PAST_NEEDS = {"lanes", "headway", "opposite"}


def reads_history_only(skill: str) -> bool:
    """Does the rule over two actors read nothing after their reference frames?"""
    rule = prules.pair_rules([RULES[skill]]).get(skill)
    return rule is not None and rule.needs <= PAST_NEEDS and re.search(LATER, str(vars(rule))) is None


def scan_actors(states: DataFrame, polylines: DataFrame) -> DataFrame:
    """Gated actors with their lanes.  Every join of the scan reads them, so they are written once."""
    states, polylines = states.hint("merge"), polylines.hint("merge")   # files are small when compressed, a map is small before it is cut into segments
    gated = gated_actors(states, polylines, list(RULES.values()))
    return materialize(ln.with_lanes(gated, polylines), "actors")


class Scene:
    """The shared tables of one scan; every method returns a lazy DataFrame."""

    def __init__(self, states: DataFrame, polylines: DataFrame, rules: list[Rule], actors: DataFrame | None = None):
        self.states, self.polylines, self.rules = states, polylines, rules
        self.pair = prules.pair_rules(rules)
        self.triples, self._wide = sum(r.skill_id in TRIPLE_RULES for r in self.rules), None
        self.many = len(self.rules) > MANY
        self.needs = set().union(*[p.needs for p in self.pair.values()]) if self.pair else set()
        self.actors = scan_actors(states, polylines) if actors is None else actors
        if self.many:  # files are small when compressed: many of them broadcast at once fill the driver
            self.states, self.polylines, self.actors = (d.hint("merge") for d in (states, polylines, self.actors))
        self.segs = ln.segments(self.polylines.where("polyline_type = 'lane_centerline'"))

    def part(self, df: DataFrame, name: str) -> DataFrame:
        """A part of a scan of many rules, written; a scan of few rules stays one plan."""
        return materialize(df, name).hint("merge") if self.many else df

    def full_actors(self) -> DataFrame:
        return self.actors.where("init_mask <> 0 OR resp_mask <> 0")

    def mask(self, *skills: str) -> int:
        return sum(BIT[s] for s in skills)

    def pairs(self, skills: list[str], full: DataFrame, needs: set[str], radius: float = pr.RADIUS) -> DataFrame:
        """Gated near pairs with both actors' features (those of several rules over three actors come without future frames)."""
        m = self.mask(*skills)
        if self.triples > 1 and set(skills) <= set(TRIPLE_RULES):
            near = "true" if radius > pr.RADIUS else f"dist <= {radius}"
            return self.wide_pairs(full).where(f"(a_init_mask & {m}L) <> 0 AND (b_resp_mask & {m}L) <> 0 AND {near}")
        left, right = self.actors.where(f"(init_mask & {m}L) <> 0"), self.actors.where(f"(resp_mask & {m}L) <> 0")
        near = pr.near_pairs(left, right, radius)
        if radius > pr.RADIUS:  # lanes relate actors at any distance; the radius covers those without a lane, whose gaps are bounded
            near = near.unionByName(pr.related_pairs(left, right)).distinct()
        drop = [c for c in ("past",) if not needs & {"past"}]
        return pr.attach(pr.attach(near, full.drop(*drop), "a"), full.drop(*drop), "b")

    def wide_pairs(self, full: DataFrame) -> DataFrame:
        """Pairs of all rules over three actors, written once: each rule reads its rows and columns. Frames of the future are
        joined to what a rule keeps of them."""
        if self._wide is None:
            m = self.mask(*[r.skill_id for r in self.rules if r.skill_id in TRIPLE_RULES])
            left, right = self.actors.where(f"(init_mask & {m}L) <> 0"), self.actors.where(f"(resp_mask & {m}L) <> 0")
            near = pr.near_pairs(left, right, triple_rules.WIDE_RADIUS).unionByName(pr.related_pairs(left, right)).distinct()
            slim = full.drop("past", "future")
            self._wide = materialize(pr.attach(pr.attach(near, slim, "a"), slim, "b"), "wide-pairs").hint("merge")
        return self._wide

    def with_futures(self, pairs: DataFrame) -> DataFrame:
        if "a_future" in pairs.columns:
            return pairs
        future = self.full_actors().select("scenario_id", "track_id", "future")
        return pr.attach(pr.attach(pairs, future, "a"), future, "b")

    def frame_features(self, pairs: DataFrame, needs: set[str]) -> DataFrame:
        """Values over the frames of both actors; afterwards the frame arrays are no longer needed."""
        pairs = pairs.withColumn("shared_steps", F.expr("size(array_intersect(a_hist_frames, b_hist_frames))"))
        if "min_ttc" in needs:
            pairs = pr.with_min_ttc(pairs)
        if "min_dist" in needs:
            pairs = pr.with_min_distance(pairs)
        if "path" in needs:
            pairs = pr.with_path_distance(pairs)
        if "headway" in needs:
            r = RULES["short_headway_following"]
            run = tr.array_run(pr.headway_flags(r["maximum_time_headway_s"], r["minimum_follower_speed_mps"]))
            pairs = pairs.withColumn("headway_run", F.expr(f"{run} * 0.1D"))
        if "opposite" in needs:
            flags = f"transform(a_past, p -> coalesce(p.observed AND {fm.heading_gap('p.heading', 'a_any_heading')} >= radians(120), false))"
            pairs = pairs.withColumn("opposite_run", F.expr(f"{tr.array_run(flags)} * 0.1D"))
        return pairs.drop(*[f"{s}_{c}" for s in "ab" for c in ("past", "future", "hist_frames")])

    def may_meet(self, columns: list[str]) -> str:
        """What the rules on path conflicts ask of a pair before its conflict is known: their masks, early conditions and bounds on these columns."""
        return " OR ".join(self.meetings(columns)) or "true"

    def meetings(self, columns: list[str]) -> list[str]:
        known = set(columns)
        items = []
        for skill, rule in self.pair.items():
            if "conflict" in rule.needs:
                ready = {n for n, e in rule.measured.items() if known.issuperset(re.findall(r"\b[a-z]\w*\b(?!\s*\()", re.sub(r"'[^']*'|\b(?:div|mod)\b", "", e)))}
                now = " AND ".join(f"{rule.measured[n]} {'>=' if n.startswith('minimum_') else '<='} {v}" for n, v in RULES[skill].thresholds.items() if n in ready)
                items.append(f"((a_init_mask & b_resp_mask & {self.mask(skill)}L) <> 0 AND ({rule.early}) AND {now or 'true'})")
        return items

    # --- optional pair features -------------------------------------------------------------
    def enrich(self, pairs: DataFrame, needs: set[str]) -> DataFrame:
        key = ["scenario_id", "a", "b"]
        source = pairs  # features are made from the pairs as given, not from those that already carry others: plans stay short
        if needs & {"min_ttc", "min_dist"}:
            pairs = self.with_futures(pairs)
        if "stop" in needs:
            r = RULES["lead_sudden_stop"]
            stop = self.part(tr.stop_metrics(self.states, r["stopped_speed_mps"], r["minimum_prior_speed_mps"]), "stop")
            pairs = pr.attach(pairs, stop, "a", "left")
        if "low" in needs:
            pairs = pr.attach(pairs, self.part(tr.low_speed(self.states, RULES["slow_lead_blockage"]["maximum_leader_speed_mps"]), "low"), "a", "left")
        if "entry" in needs:
            entry = self.part(ln.intersection_distance(self.actors, self.polylines), "entry")
            pairs = pr.attach(pr.attach(pairs, entry, "a", "left"), entry, "b", "left")
        if "places" in needs:
            walkers = self.actors.where("object_type IN ('pedestrian', 'cyclist', 'motorcyclist')")
            pairs = pr.attach(pairs, self.part(ln.actor_places(walkers, self.polylines, far=False), "places"), "a", "left")
        if "min_ttc" in needs:
            pairs = pr.with_min_ttc(pairs)
        if "min_dist" in needs:
            pairs = pr.with_min_distance(pairs)
        if "traffic" in needs:
            pairs = self._traffic(pairs, source)
        for flag, x, y, name in (("on_lane", "a_x", "a_y", "at_lane"), ("end_on_lane", "a_end_x", "a_end_y", "end_on_lane")):
            if flag in needs:
                pts = source.where("b_lane IS NOT NULL").selectExpr("scenario_id", "a", "b_lane AS polyline_id", f"{x} AS px", f"{y} AS py").distinct()
                hit = ln.project_on(pts, self.segs, ["a"]).selectExpr("scenario_id", "a", "polyline_id AS b_lane",
                                                                      f"distance AS {name}_dist", f"arc AS {name}_arc")
                pairs = pairs.join(self.part(hit, name), ["scenario_id", "a", "b_lane"], "left")
        if "convergence" in needs:
            pairs = self._convergence(pairs, source)
        if "any_convergence" in needs:
            pairs = self._any_convergence(pairs)
        if "both" in needs:
            pairs = self._shared_neighbour(pairs, source)
        if "conflict" in needs:
            wanted = source.where(any_of(self.meetings(source.columns))).select(*key, "a_lane")
            hits = wanted.join(pr.conflicts(self.actors, pairs=wanted), key)
            if needs & {"conflict_cross", "conflict_lane", "conflict_place"}:
                hits = materialize(hits, "conflicts").hint("merge")          # read by up to five point queries below
            pairs = pairs.join(hits.drop("a_lane"), key, "left")
            points = hits.selectExpr(*key, "cx AS px", "cy AS py", "a_lane AS polyline_id" if "conflict_lane" in needs else "true AS t")
            cross = self.polylines.where("polyline_type = 'lane_centerline' AND is_intersection")
            if "conflict_cross" in needs:
                near = ln.nearest_distance(points, ln.segments(cross).where("NOT broken"), ["a", "b"], 6.0, far=False)
                pairs = pairs.join(self.part(near.withColumnRenamed("distance", "conflict_to_cross"), "conflict-cross"), key, "left")
            if "conflict_lane" in needs:
                on = ln.project_on(points.where("polyline_id IS NOT NULL"), self.segs, ["a", "b"])
                pairs = pairs.join(self.part(on.selectExpr(*key, "distance AS conflict_to_lane"), "conflict-lane"), key, "left")
            if "conflict_place" in needs:
                points = points.drop("polyline_id")            # the lane of conflict_lane, not the area
                walk, area = (self.polylines.where(F.col("polyline_type") == t) for t in ("pedestrian_crossing", "drivable_area"))
                near = self.part(ln.nearest_distance(points, ln.segments(walk), ["a", "b"], 20.0).withColumnRenamed("distance", "walk"), "conflict-walk")
                zero = self.part(ln.points_in_areas(points, walk, ["a", "b"]).withColumn("on_walk", F.lit(True)), "conflict-on-walk")
                inside = self.part(ln.points_in_areas(points, area, ["a", "b"]).withColumn("in_area", F.lit(True)), "conflict-area")
                pairs = (pairs.join(near, key, "left").join(zero, key, "left").join(inside, key, "left")
                         .withColumn("conflict_crosswalk", F.expr("CASE WHEN on_walk THEN CAST(0 AS DOUBLE) ELSE walk END"))
                         .withColumn("conflict_in_area", F.expr("coalesce(in_area, false)")))
        return pairs

    def _traffic(self, pairs: DataFrame, source: DataFrame) -> DataFrame:
        """Distance from b to its nearest adjacent vehicle other than a (only below the 8 m clearance bound matters)."""
        cars = self.actors.where("object_type IN ('vehicle', 'bus')").drop("past", "future", "hist_frames")
        near = pr.attach(pr.attach(pr.near_pairs(cars, cars, 8.0), cars, "a"), cars, "b").where(pr.adjacent("a", "b"))
        near = near.selectExpr("scenario_id", "a AS b", "b AS other", "dist AS other_dist")
        best = (source.select("scenario_id", "a", "b").join(near, ["scenario_id", "b"]).where("other <> a")
                .groupBy("scenario_id", "a", "b").agg(F.min("other_dist").alias("traffic_dist")))
        return pairs.join(self.part(best, "traffic"), ["scenario_id", "a", "b"], "left")

    def _convergence(self, pairs: DataFrame, source: DataFrame) -> DataFrame:
        """Best merge target of the pair, over all relations (one_*) and over two-source relations only (two_*)."""
        key = ["scenario_id", "a", "b"]
        rel = ("concat(transform(array_intersect(a_succ, b_succ), t -> struct(t AS target, 'two_sources' AS relation)), "
               "IF(array_contains(a_succ, b_lane) AND array_contains(b_pred, a_lane) AND size(array_distinct(b_pred)) >= 2, "
               "array(struct(b_lane AS target, 'first_feeds' AS relation)), array()), "
               "IF(array_contains(b_succ, a_lane) AND array_contains(a_pred, b_lane) AND size(array_distinct(a_pred)) >= 2, "
               "array(struct(a_lane AS target, 'second_feeds' AS relation)), array()))")
        cand = source.where("a < b AND a_lane <> b_lane").selectExpr(*key, "a_lane", "b_lane", "a_x", "a_y", "a_heading", "b_x", "b_y", "b_heading", f"inline({rel})")
        lane = ln.lanes(self.polylines).selectExpr("scenario_id", "polyline_id AS target", "first_x AS x", "first_y AS y", "pred", "start_heading AS heading")
        hit = cand.join(lane, ["scenario_id", "target"]).where(
            "relation <> 'two_sources' OR (array_contains(pred, a_lane) AND array_contains(pred, b_lane))")
        f1, f2 = (fm.forward(f"x - {s}_x", f"y - {s}_y", f"{s}_heading") for s in "ab")
        hit = hit.where(f"{f1} > 0 AND {f2} > 0")
        # relation names of the ordering: first_source.. < second_source.. < two_source..
        pick = f"struct(greatest({f1}, {f2}) AS reach, relation, target, x, y, heading)"
        best = hit.groupBy(*key).agg(F.expr(f"min({pick})").alias("one"),
                                     F.expr(f"min({pick}) FILTER (WHERE relation = 'two_sources')").alias("two"))
        cols = [f"{p}.{c} AS {p}_{c}" for p in ("one", "two") for c in ("relation", "target", "x", "y", "heading")]
        return pairs.join(self.part(best.selectExpr(*key, *cols), "convergence"), key, "left")

    def _any_convergence(self, pairs: DataFrame) -> DataFrame:
        lane = ln.lanes(self.polylines).selectExpr("scenario_id", "polyline_id AS any_target", "first_x AS any_x", "first_y AS any_y")
        target = ("CASE WHEN size(array_intersect(a_succ, b_succ)) > 0 THEN array_min(array_intersect(a_succ, b_succ)) "
                  "WHEN array_contains(a_succ, b_lane) THEN b_lane WHEN array_contains(b_succ, a_lane) THEN a_lane END")
        return pairs.withColumn("any_target", F.expr(target)).join(lane, ["scenario_id", "any_target"], "left")

    def _shared_neighbour(self, pairs: DataFrame, source: DataFrame) -> DataFrame:
        """The lane lying between both actors' lanes, which side is left, and each actor's lateral offset to it."""
        key = ["scenario_id", "a", "b"]
        near = "array_compact(array({s}_left_id, {s}_right_id))"
        lane = ln.lanes(self.polylines).selectExpr("scenario_id", "polyline_id", "left_id AS t_left", "right_id AS t_right", "lane_length AS both_length")
        cand = source.where("a < b AND a_lane <> b_lane").selectExpr(
            *key, "a_lane", "b_lane", "a_left_id", "a_right_id", "b_left_id", "b_right_id", "a_x", "a_y", "b_x", "b_y",
            f"array_min(array_intersect({near.format(s='a')}, {near.format(s='b')})) AS polyline_id")
        side = ("CASE WHEN a_right_id = polyline_id AND b_left_id = polyline_id AND t_left = a_lane AND t_right = b_lane THEN 'a' "
                "WHEN NOT coalesce(a_right_id = polyline_id AND b_left_id = polyline_id, false) AND b_right_id = polyline_id "
                "AND a_left_id = polyline_id AND t_left = b_lane AND t_right = a_lane THEN 'b' END")
        hit = cand.join(lane, ["scenario_id", "polyline_id"]).withColumn("both_right_left", F.expr(side)).where("both_right_left IS NOT NULL")
        out = hit.selectExpr(*key, "polyline_id AS both_lane", "both_length", "both_right_left")
        for s in "ab":
            proj = ln.project_on(hit.selectExpr("scenario_id", s, "polyline_id", f"{s}_x AS px", f"{s}_y AS py").distinct(), self.segs, [s])
            out = out.join(proj.selectExpr("scenario_id", s, "polyline_id AS both_lane", f"lateral_m AS both_{s}_lateral"), ["scenario_id", s, "both_lane"])
        return pairs.join(self.part(out, "shared-neighbour"), key, "left")

    # --- matches ------------------------------------------------------------------------------
    def pair_matches(self) -> DataFrame:
        full = self.full_actors()
        unread = [c for c, needs in (("past", {"headway", "opposite"}), ("future", {"min_ttc", "min_dist", "path"})) if not self.needs & needs]
        pairs = self.frame_features(self.pairs(list(self.pair), full.drop(*unread), {"past"}), self.needs)
        # the features below read this table several times: written once, without the frame arrays
        pairs = materialize(pairs, "pairs").hint("merge")
        pairs = self.part(self.enrich(pairs, self.needs - FRAME_FEATURES), "features")
        rules = list(self.pair.items())
        size = PART if self.many else len(rules)
        out = [self.part(self._matches_of(pairs, dict(rules[i:i + size])), "pair-matches") for i in range(0, len(rules), size)]
        return union(out)

    def _matches_of(self, pairs: DataFrame, rules: dict) -> DataFrame:
        # relations used by many rules become columns first, so each is evaluated once per pair
        used = " ".join(str(vars(rule)) for rule in rules.values())
        shared = {text: f"x{i}" for i, text in enumerate(SHARED) if text in used}
        pairs = pairs.withColumns({name: F.expr(text) for text, name in shared.items()})

        def short(text: str) -> str:
            for long, name in shared.items():
                text = text.replace(long, name)
            return text
        # parsed piece by piece: the parser keeps what it has looked ahead over, and keeps far more of it for long nested texts
        say = lambda text: F.expr(short(text))
        numbers = lambda named: F.create_map(*[c for n, e in named.items() for c in (F.lit(n), say(e).cast("double"))]) if named else F.expr("CAST(map() AS MAP<STRING, DOUBLE>)")
        items = []
        for skill, rule in rules.items():
            r, bit = RULES[skill], self.mask(skill)
            pick = lambda s, t: f"IF({rule.swap}, {s}, {t})" if rule.swap != "false" else t
            body = F.struct(
                F.lit(skill).alias("skill_id"), say(pick("b", "a")).alias("initiator"), say(pick("a", "b")).alias("responder"), say(fm.clamp01(rule.score)).cast("double").alias("score"),
                (say(rule.metric) if rule.metric else F.lit(r.metric)).alias("risk_metric"), say(rule.value).cast("double").alias("risk_value"),
                numbers({n: e for n, e in rule.measured.items() if n in r.thresholds}).alias("measured"), numbers(rule.extra).alias("context"),
                say(pick("b_lane", "a_lane")).alias("initiator_lane"), say(pick("a_lane", "b_lane")).alias("responder_lane"), say(rule.target_lane).alias("target_lane"))
            items.append(F.when(all_of([f"(a_init_mask & b_resp_mask & {bit}L) <> 0", rule.where, *bound_list(r, rule.measured), f"({rule.value}) IS NOT NULL"], say), body))
        out = pairs.select("scenario_id", "shared_steps", F.inline(F.array_compact(F.array(*items))))
        return out.withColumn("extra", F.lit(None).cast("string")).select(*MATCH)

    def triple_matches(self) -> list[DataFrame]:
        return [self.part(fn(self), f"matches-{skill}") for skill, fn in triple_rules.TRIPLES.items() if skill in {r.skill_id for r in self.rules}]

    def raw_matches(self) -> DataFrame:
        return union(([self.pair_matches()] if self.pair else []) + self.triple_matches())


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def qualified(matches: DataFrame) -> DataFrame:
    """Distinct roles and enough history frames shared by all roles."""
    need = "CASE " + " ".join(f"WHEN skill_id = '{r.skill_id}' THEN {r.history}" for r in RULES.values()) + " END"
    return matches.where(f"initiator <> responder AND (extra IS NULL OR (extra <> initiator AND extra <> responder)) AND shared_steps >= {need}")


def top_matches(matches: DataFrame, limit: int = 1) -> DataFrame:
    """Best matches per scenario and rule by (-score, roles), after removing repeated role tuples."""
    roles = ["initiator", "responder", "extra"]
    order = [F.col("score").desc(), *[F.col(c) for c in roles]]
    best = Window.partitionBy("scenario_id", "skill_id", *roles).orderBy(F.col("score").desc(), "risk_value")
    unique = matches.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    rank = Window.partitionBy("scenario_id", "skill_id").orderBy(*order)
    return unique.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def detect(states: DataFrame, polylines: DataFrame, rules: list[Rule] | None = None, limit: int | None = 1,
           actors: DataFrame | None = None) -> DataFrame:
    """Seed matches of the given rules; ``limit=None`` keeps every qualified match."""
    scene = Scene(states, polylines, list(RULES.values()) if rules is None else rules, actors)
    found = qualified(scene.raw_matches())
    return found if limit is None else top_matches(found, limit)


def seed_records(matches: DataFrame, source: str = "scenario://") -> DataFrame:
    """Matches in the shape of `seed_records` (roles as a map, evidence as maps)."""
    case = lambda get: "CASE " + " ".join(f"WHEN skill_id = '{r.skill_id}' THEN {get(r)}" for r in RULES.values()) + " END"
    names = case(lambda r: "array(" + ", ".join(f"'{x}'" for x in r.roles) + ")")
    return matches.selectExpr(
        "scenario_id", "skill_id", "initiator AS initiator_track_id", "responder AS responder_track_id",
        f"map_from_arrays({names}, array_compact(array(initiator, responder, extra))) AS role_track_ids",
        "score AS trigger_score", "risk_metric AS seed_risk_metric", "risk_value AS seed_risk_value",
        f"struct({case(lambda r: repr(r.metric))} AS metric, {case(lambda r: r.low)} AS low, {case(lambda r: r.high)} AS high) AS target_risk_definition",
        f"concat('{source}', scenario_id) AS source_path", "measured AS evidence", "context",
        "map('initiator_lane_id', initiator_lane, 'responder_lane_id', responder_lane, 'target_lane_id', target_lane) AS lane_evidence")
