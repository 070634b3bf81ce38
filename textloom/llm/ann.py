"""Nearest neighbours by inner product: low-dimensional stable projections in kd-trees, with a chi-square stopping test.

The squared distance of two points in a Gaussian projection to m dimensions, over their true
squared distance, follows a chi-square law with m degrees of freedom. A query takes the projected
points in the order of their distance, leaf by leaf of a kd-tree, and verifies them with the true
vectors. It stops when a point that is nearer than the worst neighbour held would have shown up by
now with the wanted probability.

Inner products become distances by one more coordinate, sqrt(M**2 - |x|**2), of the candidates.

One tree over all rows, fitted on a bounded sample, deals them to cells. A query first meets a part of its
own cell, which bounds its worst neighbour, and then the cells that the stopping test does not exclude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm._bytes import release
from textloom.llm._spark import written

#: Dimensions of the projection; even, for the closed form of the chi-square law.
DIMENSIONS = 32
#: Probability with which the worst of the true neighbours is verified before a search stops; nearer ones are with more.
CONFIDENCE = 0.92
LEAF = 64
#: Rows of a cell that are planned, and rows and queries of a meeting at most.
CELL = 2048
BLOCK = 8192
QUERY_BLOCK = 2048
#: Vectors that the tree is fitted on at most, chosen by hash, and how many there are to a cell at least.
SAMPLE = 1 << 14
SAMPLE_PER_CELL = 32
_CHUNK = 128


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square law with m (even) degrees of freedom, by bisection."""

    def below(x: float) -> float:
        term = total = 1.0
        for k in range(1, m // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projector(d: int, dims: int, seed: int) -> np.ndarray:
    """The projection of vectors of length d with the coordinate that makes inner products distances."""
    return np.random.Generator(np.random.PCG64([seed, d])).normal(size=(d + 1, dims))


def project(vectors: np.ndarray, most: float, stable: np.ndarray) -> np.ndarray:
    """Projections of candidates whose squares are `most` at most."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return vectors @ stable[:-1] + np.sqrt(np.maximum(most - squares, 0))[:, None] * stable[-1]


class Cells:
    """The upper part of a kd-tree: splits at medians of the sample, along the axis of the largest spread, and the box of each cell."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.at, self.child = [], [], []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        dims = points.shape[1]
        low, high = np.full(dims, -np.inf), np.full(dims, np.inf)
        self.root = self._split(points, cells, low, high, boxes)
        self.low, self.high = (np.array([b[i] for b in boxes]) for i in (0, 1))

    def _split(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray, boxes: list) -> int:
        """The number of a node, or ~cell."""
        if cells <= 1 or len(points) < 2 * SAMPLE_PER_CELL:
            boxes.append((low, high))
            return ~(len(boxes) - 1)
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        at = float(np.median(points[:, axis]))
        left = points[:, axis] <= at
        if left.all():  # equal points
            boxes.append((low, high))
            return ~(len(boxes) - 1)
        node = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.child.append((0, 0))
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = at
        self.child[node] = (self._split(points[left], cells // 2, low, below, boxes), self._split(points[~left], cells - cells // 2, above, high, boxes))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, open_ = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while open_:
            node, own = open_.pop()
            if node < 0:
                out[own] = ~node
            elif len(own):
                left = points[own, self.axis[node]] <= self.at[node]
                open_ += [(self.child[node][0], own[left]), (self.child[node][1], own[~left])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """The least squared distance to each cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Tree:
    """A kd-tree of a meeting's points: their leaf order, and the bounding box of each leaf. Splits are at medians, so that equal points do no harm."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, bounds = np.arange(len(points)), [0]
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                bounds.append(b)
                continue
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], half, kind="introselect")]
            stack += [(a + half, b), (a, a + half)]
        self.order, self.sizes = order, np.diff(bounds)
        self.points = points[order]
        self.low = np.minimum.reduceat(self.points, bounds[:-1], axis=0)
        self.high = np.maximum.reduceat(self.points, bounds[:-1], axis=0)

    def within(self, point: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of the points within a squared radius, nearest first; leaves beyond it are not looked into."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        at = np.flatnonzero(np.repeat(np.einsum("ij,ij->i", gap, gap) <= radius, self.sizes))
        apart = self.points[at] - point
        far = np.einsum("ij,ij->i", apart, apart)
        near = far <= radius
        at, far = at[near], far[near]
        order = np.argsort(far, kind="stable")
        return at[order], far[order]


class Search:
    """A meeting's candidates, and how many of them its queries have verified."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], most: float, stable: np.ndarray, limit: float):
        tree = Tree(project(vectors, most, stable))
        self.tree, self.most, self.stable, self.limit, self.verified = tree, most, stable, limit, 0
        self.vectors = np.ascontiguousarray(vectors[tree.order])
        self.ids = [ids[i] for i in tree.order]

    def radius(self, size: float, worst: float) -> float:
        """The squared radius of projections within which a point as near as the worst neighbour lies with the wanted probability."""
        return self.limit * max(size + self.most - 2 * worst, 0.0) + 1e-9 if worst > -np.inf else np.inf

    def nearest(self, q: np.ndarray, own: int, k: int, worst: float = -np.inf) -> tuple[list[tuple[float, int]], float]:
        """(-inner product, id) of the k nearest found, and a bound of the k-th's inner product. worst: such a bound that is known already."""
        size, near, at = float(q @ q), np.zeros(0), np.zeros(0, np.int64)
        places, far = self.tree.within(q @ self.stable[:-1], self.radius(size, worst))
        for a in range(0, len(places), _CHUNK):
            if far[a] > self.radius(size, worst):
                break
            some = places[a : a + _CHUNK]
            self.verified += len(some)
            got = self.vectors[some] @ q
            good = got >= worst - 1e-9
            near, at = np.concatenate([near, got[good]]), np.concatenate([at, some[good]])
            # The query's own vector may be among those held, so that one more is held.
            if len(near) > k:
                worst = max(worst, float(np.partition(near, len(near) - k - 1)[len(near) - k - 1]))
                held = near >= worst - 1e-9
                near, at = near[held], at[held]
        # Row by row in one order of summation: equal vectors have equal scores.
        exact = (self.vectors[at] * q).sum(axis=1)
        found = sorted((-s, i) for s, j in zip(exact.tolist(), at.tolist(), strict=True) for i in self.ids[j].tolist() if i != own)
        return found[:k], worst


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<double>) of vectors that take part: not null, not zero, all components finite, with an id."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = "vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x != 0)"
    return rows.where(fine)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


class Index:
    """Trees for each length of vectors, from a sample, and the largest square of all vectors of that length."""

    def __init__(self, sample: dict[int, np.ndarray], most: dict[int, tuple[int, float]], dims: int, cell: int, seed: int):
        self.dims, self.seed = dims, seed
        self.most = {d: m for d, (_, m) in most.items()}
        self.cells = {d: Cells(project(x, self.most[d], projector(d, dims, seed)), -(-most[d][0] // cell)) for d, x in sample.items()}

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector; of a length that no vector of the sample has there is one cell."""
        d = vectors.shape[1]
        if d not in self.cells:
            return np.zeros(len(vectors), np.int64)
        return self.cells[d].of(project(vectors, self.most[d], projector(d, self.dims, self.seed)))

    def reach(self, q: np.ndarray, worst: float, limit: float) -> np.ndarray:
        """The cells that a query with such a worst neighbour has to meet."""
        d = len(q)
        if d not in self.cells:
            return np.zeros(1, np.int64)
        radius = limit * max(float(q @ q) + self.most[d] - 2 * worst, 0.0) + 1e-9 if worst > -np.inf else np.inf
        return np.flatnonzero(self.cells[d].distances(q @ projector(d, self.dims, self.seed)[:-1]) <= radius)


def nearest(table: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int = BLOCK, query_block: int = QUERY_BLOCK, dims: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`.

    Equal vectors are one candidate with its k + 1 smallest ids, which is all that a result
    can show of them. Vectors of different lengths are not compared; repeated rows are one. Of an id
    with several vectors each is a candidate, the nearest counts, and the first in a fixed order is the query's.
    Meetings hold `block` rows and `query_block` queries at most.
    """
    rows = usable(table, key, vector)
    named = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.reverse("v"), F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # A vector that many rows share is cut to its smallest ids in two steps, so that its rows are dealt out.
    first = named.dropDuplicates(["vec_id", "h", "g", "salt"]).withColumn("r", F.row_number().over(Window.partitionBy("h", "g", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = written(second.groupBy("h", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("v").alias("v")).withColumn("d", F.size("v")), "vectors")
    queries = written(named.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("h", "g", "v")).alias("s")).select("vec_id", F.col("s.v").alias("v"), F.size("s.v").alias("d")), "queries")
    # A row a length of vectors; so many lengths need the square of so many components.
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    most = {r["d"]: (r["n"], r["m"]) for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).collect()}
    total = sum(n for n, _ in most.values())
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = classes.where(F.pmod(F.xxhash64("h", F.lit(9)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).orderBy("h", "g").limit(2 * SAMPLE).select("d", "v").toArrow()
    lengths = drawn.column("d").to_numpy()
    index = Index({int(d): _matrix(drawn.filter(pa.array(lengths == d)).column("v")) for d in np.unique(lengths)}, most, dims, cell, seed)
    del drawn
    release()
    shared, limit = table.sparkSession.sparkContext.broadcast(index), chi_square_quantile(confidence, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                own = batch.filter(pa.array(lengths == d))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shared.value.of(_matrix(own.column("v"))))], names=[*own.schema.names, "cell"])

    held = written(classes.select("ids", "v", "d", "h").mapInArrow(assign, "ids array<long>, v array<double>, d int, h long, cell long"), "cells")
    # Cells are as many as the sample allows: a row each.
    parts = {(r["d"], r["cell"]): -(-r["n"] // block) for r in held.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def visits(all_cells: bool):
        """Cells that each query meets: a part of its own, or all within reach of its worst neighbour."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int, int]] = []
                for i, (q, d, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    v = np.array(v)
                    if all_cells:
                        worst = batch.column(3)[i].as_py()
                        reached = shared.value.reach(v, -np.inf if worst is None else worst, limit)
                        out += [(i, d, int(c), p) for c in reached for p in range(parts.get((d, int(c)), 0))]
                    else:
                        c = int(shared.value.of(v[None])[0])
                        out += [(i, d, c, q % n) for n in [parts.get((d, c), 0)] if n]
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), *(pa.array([x[j] for x in out], t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int32())))], names=["vec_id", "v", "worst", "d", "cell", "part"])

        return run

    def meet(bounds: bool):
        def run(own: pa.Table, asked: pa.Table) -> pa.Table:
            found: list[tuple[int, int | None, float]] = []
            if own.num_rows and asked.num_rows:
                vectors, index = _matrix(own.column("v")), shared.value
                d = vectors.shape[1]
                search = Search(vectors, [np.array(x, np.int64) for x in own.column("ids").to_pylist()], index.most[d], projector(d, index.dims, index.seed), limit)
                for q, own_id, worst in zip(_matrix(asked.column("v")), asked.column("vec_id").to_pylist(), asked.column("worst").to_pylist(), strict=True):
                    best, worst = search.nearest(q, own_id, k, -np.inf if worst is None else worst)
                    # The bound is of this part alone, and so of all: its k-th nearest is no nearer than theirs.
                    found += [(own_id, i, -s) for s, i in best] + [(own_id, None, worst)] * bounds
            return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

        return run

    def meetings(asked: DataFrame, bounds: bool) -> DataFrame:
        visited = written(asked.mapInArrow(visits(not bounds), "vec_id long, v array<double>, worst double, d int, cell long, part int"), "visits")
        # Queries of a part in blocks, and its rows once for each of these.
        blocks = visited.groupBy("d", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("blocks"))
        left = sized.withColumn("part", F.pmod("h", F.col("parts")).cast("int")).join(blocks, ["d", "cell", "part"]).select("ids", "v", "d", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
        right = visited.join(blocks, ["d", "cell", "part"]).select("vec_id", "v", "worst", "d", "cell", "part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("b"))
        on = ["d", "cell", "part", "b"]
        # The number of tasks is given: the few bytes of a meeting are much work.
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet(bounds), "query_id long, vec_id long, score double")

    sized = held.join(held.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), ["d", "cell"])
    asked = queries.select("vec_id", "d", "v", F.lit(None).cast("double").alias("worst"))
    near = written(meetings(asked, True), "near")
    bounds = near.where("vec_id is null").groupBy("query_id").agg(F.max("score").alias("worst"))
    bounds = bounds.withColumn("worst", F.when(F.col("worst") > float("-inf"), F.col("worst")))
    asked = queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left").select("vec_id", "d", "v", "worst")
    # What the first meeting found stays: so every query has its k.
    met = meetings(asked, False).unionByName(near.where("vec_id is not null")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
