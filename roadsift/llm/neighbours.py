"""Nearest neighbours by inner product: stable projections, a kd-tree and a chi-square stopping test.

Vectors get one more component so that all have the same norm; then the largest inner product is the nearest point. A
Gaussian (2-stable) projection to ``DIMENSIONS`` components multiplies a squared distance by a chi-square variable, so a
neighbour at distance d projects further than ``sqrt(quantile) * d`` with probability ``1 - CONFIDENCE`` only. The kd-tree
of the projections is fitted on at most ``SAMPLE`` points and holds every point in its cells; a cell is split into blocks
of about ``BLOCK`` points by a hash, so copies of one vector don't make a large one.

Each query first searches its own cell. The k-th distance found gives the test's radius, and the query goes to all other
cells whose boxes of projections are inside it. Inside a block, points are verified in the order of their projected
distance until the test holds. Scores are sums in double precision in component order, equal for equal vectors.

Rows with a null id or a vector that is null, zero, of another length than most, or with a null or non-finite component
take no part. A query's own id is no candidate. Ties go to the smaller id; repeated rows are candidates each for
itself; a query id that is there twice is one query, with the smallest of its vectors. Other columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from roadsift.llm.common import materialize, ragged

DIMENSIONS, CONFIDENCE, SAMPLE = 12, 0.97, 16_384
#: Points in a block, most cells of the tree, queries that meet a block at once.
BLOCK, MOST_CELLS, QUERIES = 4096, 4096, 2000
#: Points verified at first; each further step takes twice as many.
STEP = 256


def quantile(share: float, freedom: int) -> float:
    """Chi-square quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 100.0 * freedom
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
        low, high = (x, high) if 1 - tail < share else (low, x)
    return high


def matrix(column) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Projection:
    def __init__(self, size: int, norm: float):
        self.norm = norm
        self.matrix = np.random.default_rng(7).standard_normal((size + 1, DIMENSIONS))

    def points(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (v * v).sum(axis=1), 0))
        return v @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, v: np.ndarray) -> np.ndarray:
        return (v * (self.norm / np.linalg.norm(v, axis=1))[:, None]) @ self.matrix[:-1]


def tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Component and threshold of each inner node of a complete kd-tree, split at medians of the widest component."""
    parts = [points]
    components, thresholds = [], []
    for _ in range(depth):
        following = []
        for p in parts:
            c = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            t = float(np.median(p[:, c])) if len(p) else 0.0
            components.append(c)
            thresholds.append(t)
            following += [p[p[:, c] <= t], p[p[:, c] > t]]
        parts = following
    return np.array(components, int), np.array(thresholds)


def cell_of(points: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    node = np.zeros(len(points), int)
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), nodes[0][node]] > nodes[1][node])
    return node - (2 ** depth - 1)


def ordered_dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component: equal rows give equal numbers wherever they stand."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def search(query: np.ndarray, projected: np.ndarray, bound: float, own: int, ids: np.ndarray, v: np.ndarray, p: np.ndarray, k: int, norm: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block, verified in the order of projected distance until the chi-square test holds."""
    gap = p - projected
    away = np.einsum("ij,ij->i", gap, gap)
    order = np.flatnonzero((away <= limit * bound) & (ids != own))
    order = order[np.argsort(away[order], kind="stable")]
    length = np.linalg.norm(query)
    scale, slack = 2 * norm / length, 1e-9 * norm * length
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, STEP
    while at < len(order) and away[order[at]] <= limit * bound:
        take = order[at:at + step]
        rough = v[take] @ query
        least = best[-1] if len(best) == k else np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
        take = take[rough >= least - slack]  # what can be among the best, with room for rounding
        best_id, best = np.concatenate([best_id, ids[take]]), np.concatenate([best, ordered_dot(v[take], query)])
        keep = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[keep], best[keep]
        if len(best) == k:
            bound = min(bound, max(0.0, 2 * norm ** 2 - scale * best[-1]) * (1 + 1e-9))
        at, step = at + step, 2 * step
    return best_id, best


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    spark = rows.sparkSession
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    points = (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite)
              .withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).where("square > 0"))
    lengths = points.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "size").first()
    answer = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], answer).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    size, total, norm = lengths["size"], lengths["n"], math.sqrt(lengths["square"])
    points = points.where(F.size("v") == size)
    depth = max(0, min(int(math.log2(MOST_CELLS)), math.ceil(math.log2(max(1, total / BLOCK)))))
    plan, limit = Projection(size, norm), quantile(CONFIDENCE, DIMENSIONS)
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    nodes = tree(plan.points(matrix(chosen.column("v"))), depth)
    kind = dict(points.dtypes)["v"]

    def place(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            p = plan.points(v) if len(v) else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([*batch.columns, ragged(p.ravel(), np.full(len(v), DIMENSIONS), pa.float64()), pa.array(cell_of(p, nodes, depth).astype(np.int32))], names=["vec_id", "v", "asks", "p", "cell"])

    index = materialize(points.select("vec_id", "v", "asks").mapInArrow(place, f"vec_id long, v {kind}, asks boolean, p array<double>, cell int"), "index")
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()  # at most MOST_CELLS rows
    cells = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{name}{i}"] for i in range(DIMENSIONS)] for b in boxes]) for name in ("low", "high"))
    blocks = {int(b["cell"]): math.ceil(b["n"] / BLOCK) for b in boxes}

    def visits(first: bool):
        def run(batches):
            for batch in batches:
                v = matrix(batch.column(1))
                if not len(v):
                    continue
                p = plan.queries(v)
                gap = np.maximum(0, np.maximum(low[None] - p[:, None], p[:, None] - high[None]))
                away = (gap ** 2).sum(axis=2)
                home = away.argmin(axis=1)
                if first:
                    row, cell, bound = np.arange(len(v)), home, np.full(len(v), np.inf)
                else:
                    worst = batch.column(2).to_numpy(zero_copy_only=False)
                    each = np.where(np.isnan(worst), np.inf, np.maximum(0, 2 * norm ** 2 - 2 * norm / np.linalg.norm(v, axis=1) * worst) * (1 + 1e-9))
                    inside = away <= limit * each[:, None]
                    inside[np.arange(len(v)), home] = False
                    row, cell = np.nonzero(inside)
                    bound = each[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), ragged(p[row].ravel(), np.full(len(row), DIMENSIONS), pa.float64()), pa.array(bound), pa.array(cells[cell].astype(np.int32))], names=["query_id", "q", "qp", "bound", "cell"])
        return run

    schema = f"query_id long, q {kind}, qp array<double>, bound double, cell int"
    sizes = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")

    def met(key, left, right):
        ids, v, p = right.column("vec_id").to_numpy(), matrix(right.column("v")), matrix(right.column("p"))
        out = [[], [], []]
        if len(ids):
            for own, q, qp, bound in zip(left.column("query_id").to_pylist(), matrix(left.column("q")), matrix(left.column("qp")), left.column("bound").to_pylist()):
                found, score = search(q, qp, bound, own, ids, v, p, k, norm, limit)
                out[0].append(np.full(len(found), own, np.int64)), out[1].append(found), out[2].append(score)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, t) for n, c, t in zip(("query_id", "vec_id", "score"), out, (np.int64, np.int64, np.float64))})

    def visited(asked: DataFrame) -> DataFrame:
        asked = materialize(asked, "visits")
        chunks = [(r["cell"], math.ceil(r["count"] / QUERIES)) for r in asked.groupBy("cell").count().collect()]  # at most MOST_CELLS rows
        table = F.broadcast(sizes.join(spark.createDataFrame(chunks, "cell int, chunks int"), "cell"))
        left = asked.join(table, "cell").select("query_id", "q", "qp", "bound", "cell", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = index.join(table, "cell").select("vec_id", "v", "p", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["cell", "block", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, answer)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    queries = index.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))  # each query once
    home = materialize(ranked(visited(queries.mapInArrow(visits(True), schema))), "near")
    worst = home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst")).distinct()
    others = visited(queries.join(worst, "vec_id", "left").mapInArrow(visits(False), schema))
    return ranked(home.select("query_id", "vec_id", "score").unionByName(others)).select("query_id", "rank", "vec_id", "score")
