"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label collapse first. Each of TREES trees cuts recursively at the median of a random
direction, which every node has of its own (drawn by its number from POOL directions of the tree); vectors within SPILL of a
cut go to both sides. SPILL counts in standard deviations of what a pair just similar enough differs by along such
a direction. Cuts are fitted on SAMPLE vectors; a node that FEW or less of them reach takes direction and cut
of its last ancestor that has more, by level. A tree has as many levels as bring the largest label to LEAF vectors a leaf.

At a level, a pair of cosine 0.98 is parted with probability of about 0.037 (a cut through the middle of normal vectors,
spill 0.2), so it shares no leaf of any of 12 trees with probability 0.45^12 < 0.0001 at 16 levels; closer pairs less. The
price is 1.032^levels leaves a tree and vector.

Within a leaf, vectors of one label are compared by cosine in double precision; a pair that shares
several leaves counts in the first only. Links are united within leaves to spanning trees and then
across leaves. Leaves with more than CHUNK vectors of a label (near copies of one another, say) are
dealt to pairs of chunks, none of which is left out. Every vector length has its own trees.

Defined cases: a vector that is null, zero or has a null or non-finite component, or whose label is
null, links with nothing and is its own component; vectors of different lengths don't link; repeated
rows count as vectors that link; a component without any vec_id has a null id and keeps no row. An empty
table gives an empty result; only vec_id, embedding and label are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, group_starts, local_components, stash, whole_groups
from .vectors import matrix, sample, unit, usable

TREES, SPILL, LEAF, CHUNK, SAMPLE, FEW, SEED = 12, 0.2, 32, 2048, 8192, 16, 17
#: Directions that the nodes of a tree draw from.
POOL = 128


def drawn(level: int, node: np.ndarray) -> np.ndarray:
    """Which of the pool's directions a node has."""
    x = (node.astype(np.uint64) + np.uint64(level << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(POOL)).astype(np.int64)


class Tree:
    def __init__(self, p: np.ndarray, depth: int, spill: float, rng: np.random.Generator):
        self.depth, self.spill = depth, spill
        pool = rng.normal(size=(POOL, p.shape[1]))
        self.pool = (pool / np.sqrt((pool**2).sum(axis=1, keepdims=True))).T
        self.fitted = max(0, min(depth, int(np.log2(max(1, len(p) / FEW)))))  # levels whose nodes have cuts of their own
        node, self.cuts, along, row = np.zeros(len(p), np.int64), [], p @ self.pool, np.arange(len(p))
        for level in range(depth):
            v, n = along[row, drawn(level, node)], 2 ** min(level, self.fitted)
            order = np.lexsort((v, node))
            lo, hi = np.searchsorted(node[order], np.arange(n)), np.searchsorted(node[order], np.arange(n), "right")
            self.cuts.append(np.where(hi > lo, v[order[np.minimum((lo + hi) // 2, len(p) - 1)]], 0.0) if len(p) else np.zeros(n))
            if level < self.fitted:
                node = 2 * node + (v > self.cuts[level][node])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row falls in."""
        row, node, along = np.arange(len(x)), np.zeros(len(x), np.int64), x @ self.pool
        for level in range(self.depth):
            above = node >> max(0, level - self.fitted)
            v = along[row, drawn(level, above)] - self.cuts[level][above]
            left, right = v <= self.spill, v > -self.spill
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node


class Forest:
    def __init__(self, some: np.ndarray, depth: int, trees: int, spill: float, least: float):
        rng = np.random.default_rng(SEED)
        width = spill * np.sqrt((2 - 2 * least) / max(1, some.shape[1]))
        self.trees = [Tree(some, depth, width, rng) for _ in range(trees if depth else 1)]

    def codes(self, x: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, first place of each row and the end) of every leaf of unit vectors, by row and code;
        upto: of the first trees only."""
        row, code = zip(*((r, (k << 44) + leaf) for k, t in enumerate(self.trees[:upto]) for r, leaf in [t.leaves(x)]))
        row, code = np.concatenate(row), np.concatenate(code)
        order = np.lexsort((code, row))
        return row[order], code[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))


def leaf_links(u: np.ndarray, weight: np.ndarray, forest: Forest | None, here: int, chunk: np.ndarray, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(summed weights of the links that count here, component labels) of the vectors of one leaf."""
    n = len(u)
    links, label = np.zeros(n, np.int64), np.arange(n)
    step = max(1, 2_000_000 // n)
    for lo in range(0, n, step):
        s = u[lo : lo + step] @ u.T
        i, j = np.nonzero(s >= least - 1e-9)
        i += lo
        ok = (i < j) & (chunk[i] != chunk[j]) if cross else i < j
        i, j = i[ok], j[ok]
        edge = np.abs(s[i - lo, j] - least) < 1e-9
        if edge.any():
            exact = (u[i[edge]] * u[j[edge]]).sum(axis=1) >= least
            keep = np.ones(len(i), bool)
            keep[np.flatnonzero(edge)] = exact
            i, j = i[keep], j[keep]
        label = local_components(n, i, j, label)
        if len(i) and forest is not None:
            some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            row, code, first = forest.codes(u[some], (here >> 44) + 1)
            before = np.full((len(some), int(np.diff(first).max())), -1, np.int64)  # leaves before this one
            before[row, np.arange(len(row)) - first[row]] = np.where(code < here, code, -1)
            a, b = before[at[: len(i)]], before[at[len(i) :]]
            met = np.zeros(len(i), bool)
            for k in range(before.shape[1]):
                met |= (a[:, k, None] == b).any(axis=1) & (a[:, k] >= 0)
            i, j = i[~met], j[~met]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
    return links, label


def forest_components(vectors: DataFrame, least: float = 0.98, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    part = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.when(part, F.xxhash64("label", "embedding")).alias("rid"), F.when(part, F.col("label")).alias("label"), F.when(part, F.col("embedding")).alias("embedding"))
    unique = stash(rows.where("rid is not null").groupBy("rid", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total = unique.count()
    dim = F.size("embedding")
    by_label = unique.groupBy(dim.alias("dim"), "label").count()
    large = {r["dim"]: r for r in by_label.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).where(F.col("most") > LEAF).orderBy("dim").collect()}
    small, linked = unique.where(~dim.isin(*large)), None
    if total > sum(r["n"] for r in large.values()):
        linked = leaf_pairs(small.withColumn("code", dim.cast("bigint")), None, least)
    for d, r in large.items():
        own = unique.where(dim == d)
        depth = int(np.ceil(np.log2(r["most"] / LEAF)))
        one = links_of(own, Forest(sample(own, r["n"], SAMPLE, "rid"), depth, trees, spill, least), d, least)
        linked = one if linked is None else linked.unionByName(one)
    ids = vectors.select("vec_id").schema["vec_id"].dataType
    if linked is None:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    linked = stash(linked)
    roots = components(linked.select("a", "b")).withColumnRenamed("node", "rid")
    links = linked.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    named = unique.select("rid", "first", "n").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(least_id, "root").join(links, "rid", "left").select("rid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "rid").join(told, "rid", "left")
    component = F.when(F.col("rid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast(ids)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def links_of(own: DataFrame, forest: Forest, dim: int, least: float) -> DataFrame:
    """(a, b, links): a spanning link (or a with itself) and link weight of a, by leaf."""
    schema = own.select("rid", "label", "embedding", "n").schema

    def place(batches):
        for b in batches:
            if b.num_rows:
                _, code, first = forest.codes(unit(matrix(b.column(2), dim)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(code))], names=[*b.schema.names, "codes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    placed = stash(own.select(*schema.names).mapInArrow(place, f"{kinds}, codes array<bigint>"))
    return leaf_pairs(placed.select(*schema.names, F.explode("codes").alias("code")), forest, least)


def leaf_pairs(dealt: DataFrame, forest: Forest | None, least: float) -> DataFrame:
    """The same from rid, label, embedding, n and code, a leaf of one vector length. The groups that need
    more than one task are a table of their own: where it is small the planner broadcasts it, and
    vectors move once for each of their leaves."""
    dealt = dealt.withColumn("label", F.xxhash64("label"))
    hot = stash(dealt.groupBy("code", "label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CHUNK))
    hot = hot.select("code", "label", F.ceil(F.col("m") / F.lit(float(CHUNK))).cast("int").alias("parts"))
    cut = dealt.join(hot, ["code", "label"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("code", "label", F.least("chunk", "other").alias("part_x"), F.greatest("chunk", "other").alias("part_y"), "chunk", "rid", "embedding", "n")
    keys = ["code", "label", "part_x", "part_y"]

    def run(batches):
        for t in whole_groups(batches, keys, 4 * CHUNK):
            cuts = [*group_starts(t, keys), t.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                g = t.slice(lo, hi - lo)
                rid = g["rid"].to_numpy()
                links, lab = leaf_links(unit(matrix(g["embedding"], len(g["embedding"][0]))), g["n"].to_numpy(), forest, g["code"][0].as_py(), g["chunk"].to_numpy(), g["part_x"][0].as_py() != g["part_y"][0].as_py(), least)
                told = (links > 0) | (lab != np.arange(len(lab)))
                if told.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rid[told]), pa.array(rid[lab[told]]), pa.array(links[told])], names=["a", "b", "links"])

    return by_group(cut, keys).mapInArrow(run, "a bigint, b bigint, links bigint")
