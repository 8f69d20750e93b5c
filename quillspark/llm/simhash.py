"""SimHash near-duplicates: 64-bit fingerprints of word shingles and a binary trie self-join.

Fingerprints are made in one Arrow pass; the join works on distinct fingerprints only. Two
fingerprints with at most k differing bits agree on at least r of k + r bit blocks, so each
fingerprint is dealt to C(k + r, r) buckets by block contents and every link falls within a bucket.
These buckets spread the trie over tasks: the blocks are what the levels above would have compared.
A bucket is a binary trie; node pairs are traversed together from the root, level by level,
accumulating differing bits, and pairs beyond the budget, or whose leaves are one component
already, are cut off. Only spanning links leave a task, never all pairs of a group.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other. Repeated rows share a fingerprint and each keeps its row. Rows whose doc_id is null keep
their row and never name a component unless no other id is in it (then component_id is null). Texts
are hashed whole, whatever their length; an empty table gives an empty result; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_group, components, group_starts, local_components, split_hot, stash, whole_groups

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is 1 if set in over half of the XXH64 (seed 42) hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 65536):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[k : k + 65536], last[k : k + 65536])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4) -> DataFrame:
    """The columns `keep` of docs and fp, the fingerprint of text as a signed bigint."""
    d = docs.select(F.col("text").alias("__qs_text"), *keep)
    schema = StructType([*d.schema.fields[1:], StructField("fp", LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=[*b.schema.names[1:], "fp"])

    return d.mapInArrow(run, schema)


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each entry and the entries' order: entries of one group whose fingerprints
    are joined by chains of links of at most `budget` bits get one label. All groups are traversed
    at once; group is 0..g-1, fp uint64, distinct within a group."""
    order = np.lexsort((fp, group))
    g, f = group[order], fp[order]
    n = len(f)
    near = (g[1:] == g[:-1]) & (np.bitwise_count(f[1:] ^ f[:-1]) <= budget)
    at = np.flatnonzero(near)
    label = local_components(n, at, at + 1)
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    lo, hi = edge, np.concatenate((edge[1:], [n]))
    big = hi - lo > 1
    a0, a1 = lo[big].astype(np.int32), hi[big].astype(np.int32)
    b0, b1, d = a0, a1, np.zeros(len(a0), np.int8)
    for bit in range(BITS - 1, -1, -1):
        if not len(a0):
            break
        zeros = np.concatenate(([0], np.cumsum(((f >> np.uint64(bit)) & np.uint64(1)) == 0))).astype(np.int32)
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = a0 == b0
        kids = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        other = ~own
        kids.append(tuple(x[other] for x in (am, a1, b0, bm, d + 1)))
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*kids))
        run = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

        def alive(a0, a1, b0, b1, d):
            ok = (a1 > a0) & (b1 > b0) & (d <= budget)
            ok &= ~((a0 == b0) & (a1 - a0 == 1))
            x, y = np.where(ok, a0, 0), np.where(ok, b0, 0)
            one = (run[np.where(ok, a1 - 1, 0)] == run[x]) & (run[np.where(ok, b1 - 1, 0)] == run[y]) & (label[x] == label[y])
            return ok & ~one

        ok = alive(a0, a1, b0, b1, d)
        a0, a1, b0, b1, d = (x[ok] for x in (a0, a1, b0, b1, d))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            hit = np.bitwise_count(f[i] ^ f[j]) <= budget
            label = local_components(n, i[hit], j[hit], label)
            a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
    return label, order


def blocks(budget: int, shared: int) -> list[tuple[int, ...]]:
    """The bit masks of the buckets: every choice of `shared` of budget + shared blocks of bits."""
    m = budget + shared
    cuts = [BITS * i // m for i in range(m + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
    return [sum(part[i] for i in c) for c in combinations(range(m), shared)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_components(distinct: DataFrame, budget: int = 4, chunk: int = 1024) -> DataFrame:
    """(fp, root) for the distinct fingerprints that link with another; roots name components."""
    n = distinct.count()
    shared = next((r for r in (1, 2, 3) if n >> (BITS * r // (budget + r)) < 256), 4)
    masks = blocks(budget, shared)
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("block", "part"))
    keys = ["block", "part", "part_x", "part_y"]
    tasks = by_group(split_hot(dealt, ["block", "part"], F.col("fp"), chunk), keys)

    def run(batches):
        for t in whole_groups(batches, keys, 4 * chunk):
            starts = group_starts(t, keys)
            group = np.zeros(t.num_rows, np.int64)
            group[starts[1:]] = 1
            fp = t["fp"].to_numpy().view(np.uint64)
            label, order = trie_links(np.cumsum(group), fp, budget)
            fps = fp[order].view(np.int64)
            linked = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(fps[label[linked]]), pa.array(fps[linked])], names=["a", "b"])

    return components(tasks.select(*keys, "fp").mapInArrow(run, "a bigint, b bigint")).withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, budget: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    own = stash(fingerprints(docs, ["doc_id"], shingle))
    ids = stash(own.groupBy("fp").agg(F.min("doc_id").alias("first")), own.count())
    roots = fingerprint_components(ids.select("fp"), budget)
    named = ids.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(least, "root").select("fp", "component_id")
    return own.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each SimHash component: that of smallest doc_id, nulls last, then of
    smallest MD5 of text, then by the other columns; of repeated rows one stays."""
    rest = F.xxhash64(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.col("text").isNull())
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), rest.alias("r"))
    keyed = docs.withColumn("__qs_key", F.to_json(key))
    own = stash(fingerprints(keyed.select("text", F.col("__qs_key").alias("_key"), key.alias("_order")), ["_key", "_order"], shingle))
    first = stash(own.groupBy("fp").agg(F.min(F.struct("_order", "_key")).alias("first")), 4 * own.count())
    roots = fingerprint_components(first.select("fp"), budget)
    named = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = named.groupBy("root").agg(F.min("first").alias("m")).select(F.col("m._key").alias("__qs_key"))
    return keyed.join(kept, "__qs_key", "left_semi").dropDuplicates(["__qs_key"]).drop("__qs_key")
