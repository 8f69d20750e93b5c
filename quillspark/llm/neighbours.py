"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Unit vectors (so that the nearest are those of largest cosine) are projected with normal entries to
M dimensions, at most half of their own; squared projected over squared true distance follows a
chi-square law of that many degrees. A kd-tree gives candidates in order of projected distance; each
is verified by its true distance, until a point nearer than the k-th found so far would have shown up
by now with probability SURE. Candidates beyond that distance are neither visited nor verified.

The upper levels of the tree are cells of the cluster: their planes are fitted on SAMPLE vectors of
least hash, every vector is indexed in its cell, and cells of more than CELL vectors (copies of one
vector, say; fewer for long vectors, so that a cell holds at most NUMBERS numbers) are dealt to
sub-cells by hash. A query first visits its own cell; its k-th distance then bounds the cells that
the stopping test still lets it visit. A cell is read once for every CELL queries that visit it.

Every vector length is searched on its own; lengths of at most CELL vectors go together, each as one cell.

Defined cases: vectors that are null, zero or have null or non-finite components take no part; a
query's candidates are the vectors of its length; ties go to the smaller vec_id; a query with fewer
than k candidates gets them all; rows without vec_id take no part. Repeated rows are rows of their own:
each is a query, and all but a query's own row are its candidates, those of its vec_id included. An
empty table gives an empty result; only vec_id, embedding and what is_query names are read.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, group_starts, stash, whole_groups
from .vectors import matrix, sample, unit, usable

M, SURE, LEAF, FIRST, CELL, NUMBERS, SAMPLE, SEED = 32, 0.95, 256, 32, 20_000, 8_000_000, 8192, 5


def chi_square_bound(p: float, m: int) -> float:
    """The p-quantile for an even number m of degrees, by bisection of its closed form."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 100.0 * m
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def degrees(dim: int) -> int:
    """Projected dimensions of vectors of a length: an even number."""
    return max(2, min(M, dim // 4 * 2))


@lru_cache(64)
def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, degrees(dim)))


class KdTree:
    """Over rows of p; leaves of at most `leaf` rows; nodes keep the box of their rows."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(p))
        self.nodes: list[tuple[int, int, int]] = []  # lo, hi, first child (or -1); children are neighbours
        boxes, todo = [], [(0, len(p))]
        self.nodes.append((0, len(p), -1))
        at = 0
        while at < len(self.nodes):
            lo, hi, _ = self.nodes[at]
            rows = p[self.order[lo:hi]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            boxes.append((low, high))
            if hi - lo > leaf and (high > low).any():
                axis, mid = int((high - low).argmax()), (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
                self.nodes[at] = (lo, hi, len(self.nodes))
                self.nodes += [(lo, lo + mid, -1), (lo + mid, hi, -1)]
            at += 1
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def leaves(self, q: np.ndarray):
        """(squared projected distance, first and last place in order) of the leaves, nearest first."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        far = (gap * gap).sum(axis=1).tolist()
        heap = [(far[0], 0)]
        while heap:
            d, k = heapq.heappop(heap)
            lo, hi, kid = self.nodes[k]
            if kid < 0:
                yield d, lo, hi
            else:
                heapq.heappush(heap, (far[kid], kid))
                heapq.heappush(heap, (far[kid + 1], kid + 1))


class Cell:
    """Vectors of one length, in the order of a kd-tree over their projections."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray):
        dim = x.shape[1]
        norms = np.sqrt((x * x).sum(axis=1))
        p = unit(x) @ projection(dim)
        self.tree, self.dim = KdTree(p), dim
        o = self.tree.order
        self.x, self.ids, self.rids, self.norms, self.p = x[o], ids[o], rids[o], norms[o], p[o]
        self.p_norms = (self.p * self.p).sum(axis=1)

    def nearest(self, q: np.ndarray, q_rid: int, k: int, bound: float, start: float = np.inf) -> tuple[list[tuple[float, int]], int]:
        """The k best (score, id) of one query, and how many vectors were verified; start: a squared
        distance that k others have. bound: the quantile of the stopping test."""
        nq = np.sqrt((q * q).sum())
        u = q / nq
        pq = u @ projection(self.dim)
        pq_norm, limit = pq @ pq, bound * max(start, 1e-9) + 1e-9
        best_s, best, kth, verified = np.zeros(0), np.zeros(0, np.int64), start, 0
        for d, lo, hi in self.tree.leaves(pq):
            if d > limit:
                break
            far = self.p_norms[lo:hi] + pq_norm - 2 * (self.p[lo:hi] @ pq)
            left = np.flatnonzero((far <= limit) & (self.rids[lo:hi] != q_rid))
            if kth == np.inf:  # nearest projections first, so that a k-th distance is known soon
                left = left[far[left].argsort(kind="stable")]
            while len(left):
                size = len(left) if kth < np.inf else FIRST
                now, left = left[:size] + lo, left[size:]
                verified += len(now)
                s = (self.x[now] @ u) / self.norms[now]
                near = 2 - 2 * s <= kth + 1e-9
                if near.any():
                    best_s, best = np.concatenate((best_s, s[near])), np.concatenate((best, now[near]))
                    if len(best) >= k:
                        cut = np.partition(best_s, len(best) - k)[len(best) - k] - 1e-9  # ties within rounding stay
                        best_s, best = best_s[best_s >= cut], best[best_s >= cut]
                        kth = min(start, max(0.0, 2 - 2 * float(cut)))
                        limit = bound * max(kth, 1e-9) + 1e-9
                        left = left[far[left] <= limit]
        score = (self.x[best] * q).sum(axis=1) / (self.norms[best] * nq)
        top = np.lexsort((self.ids[best], -score))[:k]
        return list(zip(score[top].tolist(), self.ids[best][top].tolist())), verified


class Cells:
    """Regions of the projected space: planes at the sample's medians, 2 ** depth cells."""

    def __init__(self, p: np.ndarray, depth: int):
        self.depth, self.planes = depth, []
        rows = [np.arange(len(p))]
        low, high = [np.full(p.shape[1], -np.inf)], [np.full(p.shape[1], np.inf)]
        for _ in range(depth):
            planes, nrows, nlow, nhigh = [], [], [], []
            for r, lo, hi in zip(rows, low, high):
                axis = int(np.ptp(p[r], axis=0).argmax()) if len(r) else 0
                cut = float(np.median(p[r, axis])) if len(r) else 0.0
                planes.append((axis, cut))
                left = p[r, axis] <= cut
                mid_hi, mid_lo = hi.copy(), lo.copy()
                mid_hi[axis], mid_lo[axis] = min(hi[axis], cut), max(lo[axis], cut)
                nrows += [r[left], r[~left]]
                nlow += [lo, mid_lo]
                nhigh += [mid_hi, hi]
            self.planes.append((np.array([a for a, _ in planes]), np.array([c for _, c in planes])))
            rows, low, high = nrows, nlow, nhigh
        self.low, self.high = np.array(low), np.array(high)

    def of(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for axis, cut in self.planes:
            at = 2 * at + (p[np.arange(len(p)), axis[at]] > cut[at])
        return at

    def distance(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of one projected point to every cell."""
        gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
        return (gap * gap).sum(axis=1)


def cell_rows(dim: int) -> int:
    return max(1, min(CELL, NUMBERS // dim))


def search(rows: DataFrame, asks: DataFrame, k: int, sure: float) -> DataFrame:
    """asks (cell, block, rid, vec_id, embedding, start) against rows (cell, rid, vec_id, embedding), of
    one length within a cell: (rid, query_id, vec_id, score), the k best of each cell."""
    keys = ["cell", "block"]
    blocks = asks.groupBy("cell").agg(F.max("block").alias("last"))
    held = rows.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    both = held.select("cell", F.col("block").cast("int"), F.lit(0).alias("ask"), "rid", "vec_id", "embedding", F.lit(0.0).alias("start"))
    both = both.unionByName(asks.select("cell", F.col("block").cast("int"), F.lit(1).alias("ask"), "rid", "vec_id", "embedding", "start"))

    def run(batches):
        for t in whole_groups(batches, keys, CELL):
            cuts = [*group_starts(t, keys), t.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                g = t.slice(lo, hi - lo)
                ask, ids, rids, start = g["ask"].to_numpy() == 1, g["vec_id"].to_numpy(), g["rid"].to_numpy(), g["start"].to_numpy()
                if ask.all() or not ask.any():
                    continue
                dim = len(g["embedding"][0])
                x, bound = matrix(g["embedding"], dim), chi_square_bound(sure, degrees(dim))
                cell = Cell(x[~ask], ids[~ask], rids[~ask])
                out = [(r, i, *b) for q, i, r, s in zip(x[ask], ids[ask].tolist(), rids[ask].tolist(), start[ask]) for b in cell.nearest(q, r, k, bound, s)[0]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["rid", "query_id", "vec_id", "score"])

    return by_group(both, keys).mapInArrow(run, "rid bigint, query_id bigint, vec_id bigint, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query: Column | None = None, k: int = 5, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id divisible by 50)."""
    spark = vectors.sparkSession
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    dim = F.size("embedding")
    # rows get their numbers as they are written, once
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = stash(good.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("rid")))
    room = F.least(F.lit(CELL), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / dim)))
    # lengths of over a cell's vectors, and in the row without n all others
    lengths = good.groupBy(dim.alias("n"), room.alias("room")).count().groupBy(F.when(F.col("count") > F.col("room"), F.col("n")).alias("n")).agg(F.sum("count").alias("count")).collect()
    large = {r["n"]: r["count"] for r in sorted(lengths, key=lambda r: r["n"] or 0) if r["n"] is not None}
    found = None
    if len(large) < len(lengths):
        rows = good.where(~dim.isin(*large)).withColumn("cell", dim.cast("bigint"))
        asks = rows.where("is_query").withColumn("start", F.lit(float("inf")))
        found = search(rows, blocked(asks), k, sure)
    for n, total in large.items():
        one = of_length(good.where(dim == n), n, total, k, sure)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def of_length(good: DataFrame, dim: int, total: int, k: int, sure: float) -> DataFrame:
    """(rid, query_id, vec_id, score) among vectors of one length, the k best of each cell that a query visits."""
    some, size, bound = sample(good, total, SAMPLE, "vec_id"), cell_rows(dim), chi_square_bound(sure, degrees(dim))
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / size)))), int(np.log2(max(1, len(some) / 8)))))
    cells = Cells(some @ projection(dim), depth)

    def place(batches):
        proj = projection(dim)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(unit(matrix(b.column(1), dim)) @ proj))], names=[*b.schema.names, "region"])

    kind = good.schema["embedding"].dataType.simpleString()
    placed = stash(good.mapInArrow(place, f"vec_id bigint, embedding {kind}, is_query boolean, rid bigint, region bigint"))
    sizes = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}  # at most 2 ** depth rows
    cuts = [max(1, -(-sizes.get(r, 0) // size)) for r in range(2**depth)]
    first = np.concatenate(([0], np.cumsum(cuts))).tolist()
    at = F.element_at(F.array(*map(F.lit, first)), (F.col("region") + 1).cast("int"))
    n = F.element_at(F.array(*map(F.lit, cuts)), (F.col("region") + 1).cast("int"))
    rows = placed.withColumn("cell", at + F.pmod(F.xxhash64("rid"), n))
    asks = placed.where("is_query")
    own = asks.withColumn("cell", F.explode(F.sequence(at, at + n - 1))).withColumn("start", F.lit(float("inf")))
    near = stash(search(rows, blocked(own), k, sure))
    kth = best(near, k).groupBy("rid").agg(F.when(F.count(F.lit(1)) == k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(F.lit(float("inf"))).alias("start"))

    def further(batches):
        proj = projection(dim)
        for b in batches:
            if not b.num_rows:
                continue
            rows_, cell_, start_ = [], [], []
            starts = b.column(4).to_pylist()
            for i, (p, home, s) in enumerate(zip(unit(matrix(b.column(2), dim)) @ proj, b.column(3).to_pylist(), starts)):
                s = np.inf if s is None else s
                for r in np.flatnonzero(cells.distance(p) <= bound * max(s, 1e-9)):
                    if r != home:
                        for c in range(first[r], first[r + 1]):
                            rows_.append(i)
                            cell_.append(c)
                            start_.append(s)
            if rows_:
                took = b.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays([*took.columns[:3], pa.array(cell_, pa.int64()), pa.array(start_, pa.float64())], names=["rid", "vec_id", "embedding", "cell", "start"])

    others = asks.join(kth, "rid", "left").select("rid", "vec_id", "embedding", "region", "start").mapInArrow(further, f"rid bigint, vec_id bigint, embedding {kind}, cell bigint, start double")
    return near.unionByName(search(rows, blocked(others), k, sure)) if depth else near


def blocked(asks: DataFrame) -> DataFrame:
    """Queries of a cell in blocks of about CELL, so that copies of cells are no more than what queries take."""
    n = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CELL))).cast("int").alias("_n"))
    return asks.join(n, "cell").withColumn("block", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("_n")).cast("int")).drop("_n")
