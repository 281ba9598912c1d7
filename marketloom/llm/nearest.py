"""Approximate nearest neighbours: stable projections, kd-trees over them, incremental search with a chi-square stopping test.

The coordinates of a difference under a Gaussian (2-stable) projection to ``DIMENSIONS`` numbers, squared and summed,
are its squared length times a chi-square variable. So neighbours taken in order of projected distance can stop once
that distance is beyond what the k-th distance found so far would show with probability ``CERTAINTY``: each true
neighbour is seen with at least that probability. No count of candidates is capped.

Largest inner product becomes least distance: a vector x gets one more coordinate sqrt(M^2 - |x|^2), M the greatest
length of all, and a query is scaled to length M with 0 there.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.shared import materialize

#: Projected dimensions (even), the probability of the stopping test, results of a query.
DIMENSIONS, CERTAINTY, RESULTS = 16, 0.97, 20
#: The upper kd-tree is fitted on this many vectors, those with the least hashes; it has at most so many cells.
SAMPLE, CELLS = 8192, 256
#: Vectors of a unit of work (a cell, or a part of one by hash), of a leaf of its kd-tree, and of a step of verification.
UNIT, LEAF, STEP = 16384, 64, 256
#: Queries that meet a unit in one task.
QUERIES = 16384


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number ``m`` of degrees of freedom, by bisection of its closed form."""
    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))

    low, high = 0.0, 1.0
    while above(high) > 1 - p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def directions(d: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((d + 1, DIMENSIONS))


class Cells:
    """Upper kd-tree: cells of the projected space, each an (unbounded) box, found by median cuts of a sample."""

    def __init__(self, sample: np.ndarray, wanted: int):
        m = sample.shape[1] if sample.ndim == 2 else DIMENSIONS
        boxes = [(sample, np.full(m, -np.inf), np.full(m, np.inf), ())]
        while len(boxes) < wanted:
            at = max(range(len(boxes)), key=lambda k: len(boxes[k][0]))
            rows, low, high, _ = boxes[at]
            axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) > 1 else 0
            cut = float(np.median(rows[:, axis])) if len(rows) > 1 else 0.0
            left = rows[:, axis] < cut
            if len(rows) < 2 or not left.any():
                break
            high_left, low_right = high.copy(), low.copy()
            high_left[axis], low_right[axis] = cut, cut
            boxes[at:at + 1] = [(rows[left], low, high_left, ()), (rows[~left], low_right, high, ())]
        self.low, self.high = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Squared distance of each row of ``y`` to each cell; 0 to its own."""
        return np.stack([(np.maximum(np.maximum(lo - y, y - hi), 0) ** 2).sum(axis=1) for lo, hi in zip(self.low, self.high, strict=True)], axis=1)

    def home(self, y: np.ndarray) -> np.ndarray:
        inside = np.stack([((y >= lo) & (y < hi)).all(axis=1) for lo, hi in zip(self.low, self.high, strict=True)], axis=1)
        return inside.argmax(axis=1)


class Tree:
    """kd-tree of one unit: leaves of at most LEAF points with tight boxes, and the search of one query."""

    def __init__(self, x: np.ndarray, y: np.ndarray, firsts: np.ndarray):
        self.x, self.y, self.firsts = x, y, firsts
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(x))] if len(x) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            axis = int(np.ptp(y[rows], axis=0).argmax())
            half = len(rows) // 2
            part = np.argpartition(y[rows, axis], half)
            todo += [rows[part[:half]], rows[part[half:]]]
        self.low = np.array([y[r].min(axis=0) for r in self.leaves])
        self.high = np.array([y[r].max(axis=0) for r in self.leaves])

    def search(self, q: np.ndarray, p: np.ndarray, scale: float, greatest: float, bound: float, k: int, limit: float) -> list[tuple[float, int, int]]:
        """The best ``k`` as (score, -first, row), best last; ``bound`` is a score that k vectors elsewhere reach.

        ``scale`` is the greatest length of all vectors by the query's own, ``greatest`` that length squared, so that
        the squared distance of a score is 2 (greatest - scale * score). ``limit``: the chi-square quantile.
        """
        if not self.leaves:
            return []
        away = (np.maximum(np.maximum(self.low - p, p - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(away, kind="stable")
        best: list[tuple[float, int, int]] = []
        wait_d, wait_i = np.empty(0), np.empty(0, np.int64)
        at, group = 0, 4

        def reach() -> float:
            """Projected squared distance beyond which the test holds."""
            score = max(bound, best[0][0] if len(best) == k else -np.inf)
            return limit * max(2 * (greatest - scale * score), 0.0) * (1 + 1e-9) + 1e-12 * greatest if score > -np.inf else np.inf

        while True:
            if at < len(order) and away[order[at]] <= reach():
                taken = np.concatenate([self.leaves[j] for j in order[at:at + group]])
                at, group = at + group, min(2 * group, 64)
                wait_d = np.concatenate([wait_d, ((self.y[taken] - p) ** 2).sum(axis=1)])
                wait_i = np.concatenate([wait_i, taken])
                complete = away[order[at]] if at < len(order) else np.inf  # no leaf left holds a nearer projection
                last = False
            else:
                complete, last = np.inf, True
            ready = np.flatnonzero(wait_d <= complete)
            ready = ready[np.argsort(wait_d[ready], kind="stable")]
            for s in range(0, len(ready), STEP):
                step = ready[s:s + STEP]
                if wait_d[step[0]] > reach():
                    return sorted(best)
                rows = wait_i[step]
                scores = np.einsum("ij,j->i", self.x[rows], q)
                floor = max(bound - 1e-9 * greatest, best[0][0] if len(best) == k else -np.inf)
                for j in np.flatnonzero(scores >= floor):
                    item = (float(scores[j]), -int(self.firsts[rows[j]]), int(rows[j]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            keep = np.ones(len(wait_d), bool)
            keep[ready] = False
            wait_d, wait_i = wait_d[keep], wait_i[keep]
            if last or (at >= len(order) and not len(wait_d)):
                return sorted(best)


def vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite doubles, negative zeros as zeros."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return embeddings.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("v")).where(F.size("v") > 0)


def as_matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def nearest(embeddings: DataFrame, every: int = 20, results: int = RESULTS, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``results`` best others by inner product.

    Rows without an id, with a null or zero vector or a null, infinite or not-a-number entry take no part, nor do
    vectors of another length than the most frequent one (of equals the longest) or whose squared length isn't a
    positive finite double. Rows that repeat an id count once; of different vectors under one id, the one with the least digest.
    Equal scores go by id. Copies of one vector share one search and one score, however many there are: a class keeps
    its ``results`` + 1 smallest ids, which are all that can be in a result. With fewer candidates than ``results`` all
    are returned; an empty table gives an empty result; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors(embeddings, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d, k = lengths[0]["d"], results + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.einsum("ij,ij->i", x, x))], names=["vec_id", "x", "norm"])

    # a copy of the table in doubles; the class of equal vectors is the digest of its bytes
    base = rows.where(F.size("v") == d).mapInArrow(packed, "vec_id long, x binary, norm double").where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    base = materialize(base.withColumn("class", F.md5("x")), "nearest-base")
    greatest = base.agg(F.max("norm")).first()[0]
    if greatest is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("class").orderBy("vec_id")
    rows = base.groupBy("vec_id").agg(F.min("class").alias("class"))
    ids = (rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
           .groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shapes = base.groupBy("class").agg(F.first("x").alias("x"))
    asked = materialize(rows.where(F.pmod("vec_id", F.lit(every)) == 0), "nearest-asked")
    plane = directions(d)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = as_matrix(b.column(1), d)
            lift = np.sqrt(np.maximum(greatest - np.einsum("ij,ij->i", x, x), 0))
            y = np.concatenate([x, lift[:, None]], axis=1) @ plane
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in y], pa.binary())], names=[*b.schema.names, "y"])

    points = materialize(shapes.join(ids, "class").select("class", "x", "ids").mapInArrow(project, "class string, x binary, ids array<long>, y binary"), "nearest-points")
    sample = points.select(F.xxhash64("class").alias("h"), "y").orderBy("h", "y").limit(SAMPLE).collect()  # at most SAMPLE projections
    total = points.count()
    cells = Cells(np.array([np.frombuffer(r["y"]) for r in sample]), min(CELLS, 2 ** max(0, math.ceil(math.log2(max(total / UNIT, 1))))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = cells.home(as_matrix(b.column(3), DIMENSIONS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32())], names=[*b.schema.names, "cell"])

    placed = points.mapInArrow(place, "class string, x binary, ids array<long>, y binary, cell int")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows
    parts = [max(1, math.ceil(counts.get(c, 0) / UNIT)) for c in range(len(cells.low))]
    first = np.concatenate([[0], np.cumsum(parts)])
    part, start = F.array(*map(F.lit, parts)), F.array(*[F.lit(int(v)) for v in first[:-1]])
    unit = (F.element_at(start, F.col("cell") + 1) + F.pmod(F.xxhash64("class"), F.element_at(part, F.col("cell") + 1))).cast("long")
    none = F.lit(None)
    data = materialize(placed.select(unit.alias("unit"), F.lit(0).alias("kind"), "class", "x", "y", "ids", none.cast("double").alias("bound")), "nearest-units")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = as_matrix(b.column(1), d)
            scale = np.sqrt(greatest / np.einsum("ij,ij->i", x, x))
            y = (x * scale[:, None]) @ plane[:d]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in y], pa.binary()), pa.array(cells.home(y), pa.int32())], names=["class", "x", "y", "cell"])

    limit = chi_square_quantile(CERTAINTY, DIMENSIONS)
    blocks = max(1, math.ceil(asked.select("class").distinct().count() / QUERIES))
    wanted = asked.select("class").distinct().join(shapes, "class").mapInArrow(ask, "class string, x binary, y binary, cell int")
    at_home = wanted.select(unit.alias("unit"), F.lit(1).alias("kind"), "class", "x", "y", F.lit(None).cast("array<long>").alias("ids"), none.cast("double").alias("bound"))
    starts = {"first": first.tolist(), "parts": parts}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every unit that the ball of the stopping test meets, for each query, but its home."""
        for b in batches:
            if not b.num_rows:
                continue
            x, y, bound = as_matrix(b.column(1), d), as_matrix(b.column(2), DIMENSIONS), b.column(3).to_numpy(zero_copy_only=False)
            scale = np.sqrt(greatest / np.einsum("ij,ij->i", x, x))
            reach = np.where(np.isfinite(bound), limit * np.maximum(2 * (greatest - scale * bound), 0) * (1 + 1e-9) + 1e-12 * greatest, np.inf)
            q, c = np.nonzero(cells.distances(y) <= reach[:, None])
            n = np.array(starts["parts"])[c]
            home = b.column(4).to_numpy()
            q, units = np.repeat(q, n), np.concatenate([np.arange(starts["first"][j], starts["first"][j] + m) for j, m in zip(c, n, strict=True)])
            q, units = q[units != home[q]], units[units != home[q]]
            for s in range(0, len(q), 4096):
                t = b.take(pa.array(q[s:s + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(units[s:s + 4096], pa.int64()), *t.columns[:4]], names=["unit", "class", "x", "y", "bound"])

    def searched(asks: DataFrame, output: str, emit) -> DataFrame:
        """Queries against the vectors of their units: a task holds one unit and a batch of queries.

        Queries of a unit are dealt into blocks of about QUERIES; its vectors go with every block that has one.
        """
        fields = pa.schema([("class", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts_, held, tree = None, [], [], None
            for b in batches:
                if not b.num_rows:
                    continue
                place_ = np.stack([b["unit"].to_numpy(), b["block"].to_numpy(), b["kind"].to_numpy()])
                edges = np.concatenate([[0], np.flatnonzero((place_[:, 1:] != place_[:, :-1]).any(axis=0)) + 1, [b.num_rows]]).tolist()
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    g, key = b.slice(s, e - s), tuple(place_[:2, s])
                    x, y = as_matrix(g["x"], d), as_matrix(g["y"], DIMENSIONS)
                    if key != now:
                        now, parts_, held, tree = key, [], [], None
                    if place_[2, s] == 0:
                        parts_.append((x, y))
                        held += g["ids"].to_pylist()
                        continue
                    if tree is None:
                        tree = Tree(np.concatenate([v for v, _ in parts_]), np.concatenate([v for _, v in parts_]), np.array([i[0] for i in held], np.int64)) if parts_ else Tree(x[:0], y[:0], np.empty(0, np.int64))
                        parts_ = []
                    out = []
                    for j, (name, bound) in enumerate(zip(g["class"].to_pylist(), g["bound"].to_pylist(), strict=True)):
                        scale = math.sqrt(greatest / float(np.einsum("i,i->", x[j], x[j])))
                        out += emit(name, tree.search(x[j], y[j], scale, greatest, -math.inf if bound is None else bound, k, limit), held)
                        if len(out) >= 4096:
                            yield from pa.Table.from_pylist(out, schema=fields).to_batches()
                            out = []
                    if out:
                        yield from pa.Table.from_pylist(out, schema=fields).to_batches()

        dealt = asks.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "class"), F.lit(blocks)))
        both = data.join(dealt.select("unit", "block").distinct(), "unit").unionByName(dealt)
        return both.repartition("unit", "block").sortWithinPartitions("unit", "block", "kind").mapInArrow(run, output)

    # a query's own unit gives a score that k vectors reach; the other units within its ball then give what is better
    def emit(name: str, found: list, held: list) -> list[dict]:
        return [{"class": name, "score": score, "ids": held[i]} for score, _, i in found]

    output = "class string, score double, ids array<long>"
    near = materialize(searched(at_home, output, emit), "nearest-home")
    bounds = near.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound")).where(F.col("n") == k)
    bounded = materialize(wanted.withColumn("home", unit).join(bounds, "class", "left").select("class", "x", "y", "bound", "home"), "nearest-bounds")
    tours = bounded.mapInArrow(visit, "unit long, class string, x binary, y binary, bound double")
    tours = tours.select("unit", F.lit(1).alias("kind"), "class", "x", "y", F.lit(None).cast("array<long>").alias("ids"), "bound")
    hits = near.unionByName(searched(tours, output, emit))

    classes = Window.partitionBy("class").orderBy(F.desc("score"), F.col("ids")[0])
    best = hits.withColumn("n", F.row_number().over(classes)).where(F.col("n") <= k).select("class", "score", F.explode("ids").alias("vec_id"))
    members = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("n", F.row_number().over(members)).where(F.col("n") <= k).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    # queries with equal vectors may be many: their class meets its results in eight salted parts
    salts = 8
    lists = best.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    mine = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(lists, ["class", "salt"])
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, results)
    return mine.select(F.col("vec_id").alias("query_id"), F.posexplode(others)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
