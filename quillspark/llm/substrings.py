"""Substring dedup on a compacted De Bruijn graph of token k-mers.

Every window of k words is an edge (k = 50). As in minimiser-based compaction, an edge belongs to
the least hash among the m-grams inside it, so equal edges of different documents always meet;
neighbouring edges of one document with the same minimiser form a path (a super-k-mer), which is
carried as one row: its two hashes, its document and its place. Paths whose minimiser is of one
document only cannot repeat and go. Equal paths compact into one (nonbranching stretches that all
their documents share) through grouping and joins; only where several different paths share a
minimiser, branches are resolved edge by edge, at every place of each distinct path within its source
document, whatever the number of its copies in others.

Two 64-bit hashes that agree only claim a repeat. Each claim names its source by coordinates (document, place); the words
there are cut from the source, go to the claiming document and are compared with its own before they are removed. Should
any claim fail, hashes clashed, and the whole is done again with other hash functions: what is returned
rests on compared words alone (a source of a clash that could hide a repeat has a failed claim, as its group holds two
different texts).

Defined cases: null, empty and short texts have no window and keep all words; documents with a null
doc_id neither lose words nor are a source; rows that share a doc_id aren't smaller than each other, and
equal ones have their spans once between them; an empty table gives an empty result; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash

WINDOW, GRAM = 50, 12
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEEP = 500_000
#: Claims on one source in one task, about, and tries with other hash functions.
CLAIMS, TRIES = 500, 8


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.inverse = pow(base, -1, 1 << 64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 4096, 2 * self.n)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.n - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of any word range of one document at a time; the number of the try tells the hash functions apart."""

    def __init__(self, number: int = 0, bits: int = 64):
        self.words: dict[bytes, tuple[int, int]] = {}
        self.powers = [Powers(b) for b in BASES]
        self.seeds, self.mask = (2 * number + 1, 2 * number + 2), np.uint64((1 << bits) - 1)

    def load(self, words: list[bytes]) -> None:
        known = self.words
        if len(known) > KEEP:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (xxhash.xxh64_intdigest(w, self.seeds[0]), xxhash.xxh64_intdigest(w, self.seeds[1]))
        h = np.array([known[w] for w in words], np.uint64)
        self.sums, self.down = [], []
        for k, p in enumerate(self.powers):
            up, down = p.upto(len(words) + 1)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[:, k] * up[:-1], dtype=np.uint64))))
            self.down.append(down)

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[k][end] - self.sums[k][start]) * self.down[k][start]) & self.mask


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    n, size, m = len(x) - w + 1, 1, x
    while 2 * size <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def paths(r: Rolling, words: list[bytes], window: int, gram: int):
    """(minimiser, first hash, second hash, first window, windows) of the super-k-mers, as arrays."""
    r.load(words)
    n = len(words) - window + 1
    at = np.arange(len(words) - gram + 1)
    least = sliding_min(r.of(0, at, at + gram), window - gram + 1)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.concatenate((start[1:], [n]))
    stop = end + window - 1
    return least[start], r.of(0, start, stop), r.of(1, start, stop), start, end - start


def bigint(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def text_hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"), 3) >> 1


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (0 for null) and the text under zstd, which is what joins move."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([0 if t is None else text_hash(t) for t in texts], pa.int32()), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())],
                names=["doc_id", "text_hash", "body"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash int, body binary")


def all_paths(docs: DataFrame, window: int, gram: int, how: tuple[int, int]) -> DataFrame:
    """m, h1, h2, doc_id, text_hash, start, n of every super-k-mer."""

    def run(batches):
        r = Rolling(*how)
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = t.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                m, h1, h2, start, n = paths(r, words, window, gram)
                k = len(m)
                for o, x in zip(out, (m, h1, h2, np.full(k, d, np.int64), np.full(k, text_hash(t), np.int32), start.astype(np.int32), n.astype(np.int32))):
                    o.append(x)
            if out[0]:
                cols = [np.concatenate(o) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=["m", "h1", "h2", "doc_id", "text_hash", "start", "n"])

    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "m bigint, h1 bigint, h2 bigint, doc_id bigint, text_hash int, start int, n int")


def edges_of(joined: DataFrame, window: int, how: tuple[int, int]) -> DataFrame:
    """e1, e2, doc_id, text_hash, at of the edges in the listed places of each document."""
    names = ["e1", "e2", "doc_id", "text_hash", "at"]

    def run(batches):
        r, z = Rolling(*how), zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for d, h, body, places in zip(*(b.column(i).to_pylist() for i in range(4))):
                r.load(z.decompress(body).split())
                at = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in places]))
                for o, x in zip(out, (r.of(0, at, at + window).view(np.int64), r.of(1, at, at + window).view(np.int64), np.full(len(at), d, np.int64), np.full(len(at), h, np.int32), at.astype(np.int32))):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=names)

    return joined.select("doc_id", "text_hash", "body", "places").mapInArrow(run, "e1 bigint, e2 bigint, doc_id bigint, text_hash int, at int")


def claims(docs: DataFrame, bodies: DataFrame, window: int, gram: int, how: tuple[int, int]) -> DataFrame:
    """doc_id, text_hash, from_doc, from_hash, shift, spans: word ranges covered by windows that, by their hashes, also start
    in a smaller document, where they lie `shift` words further on."""
    path = ["m", "h1", "h2"]
    every = stash(all_paths(docs, window, gram, how))
    # tables on their own, so that the joins below may split the partition of a hot key
    shared = stash(every.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"))
    found = stash(every.join(shared, "m"))
    drop(every, shared)
    # compaction: equal paths are one, whose source is its smallest document
    unit = stash(found.groupBy(*path).agg(F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("source")))
    claim = lambda s, e, source, at: (F.col(s).alias("s"), e.alias("e"), F.col(f"{source}.doc_id").alias("from_doc"), F.col(f"{source}.text_hash").alias("from_hash"), (F.col(at) - F.col(s)).alias("shift"))
    whole = found.join(unit, path).where(F.col("doc_id") > F.col("source.doc_id"))
    whole = whole.select("doc_id", "text_hash", *claim("start", F.col("start") + F.col("n") + F.lit(window - 1), "source", "source.start"))
    # branches: different paths with one minimiser may share edges; each source tells its own, at
    # every place where it has them, as `whole` covers larger documents only
    branching = stash(unit.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("m"))
    told = unit.join(branching, "m").select(*path, F.col("source.doc_id").alias("doc_id"))
    places = found.join(told, [*path, "doc_id"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    edges = stash(edges_of(bodies.join(places, ["doc_id", "text_hash"]), window, how))
    first = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("lo"), F.max("doc_id").alias("hi")).where("lo.doc_id < hi")
    first = stash(first.select("e1", "e2", "lo"))
    part = edges.join(first, ["e1", "e2"]).where("doc_id > lo.doc_id").select("doc_id", "text_hash", *claim("at", F.col("at") + F.lit(window), "lo", "lo.at"))
    return whole.unionByName(part).groupBy("doc_id", "text_hash", "from_doc", "from_hash", "shift").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def joined_up(spans: list[dict]) -> list[tuple[int, int]]:
    """Ranges without overlaps, in order."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def source_words(claimed: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, text_hash, s, e, said: the words that stand at each claim's source, under zstd. Many claims on one source
    are dealt to several rows."""
    claimed = stash(claimed)
    source = ["from_doc", "from_hash"]
    parts = stash(claimed.groupBy(*source).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CLAIMS))).cast("int").alias("parts")))
    dealt = claimed.join(parts, source).withColumn("part", F.pmod(F.xxhash64("doc_id", "shift"), F.col("parts")))
    listed = dealt.groupBy(*source, "part").agg(F.collect_list(F.struct("doc_id", "text_hash", "shift", "spans")).alias("claims"))
    own = bodies.select(F.col("doc_id").alias("from_doc"), F.col("text_hash").alias("from_hash"), "body")

    def run(batches):
        z, back = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for body, claims in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = z.decompress(body).split()
                for c in claims:
                    for s, e in joined_up(c["spans"]):
                        for o, x in zip(out, (c["doc_id"], c["text_hash"], s, e, back.compress(b" ".join(words[max(0, s + c["shift"]) : e + c["shift"]])))):
                            o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "text_hash", "s", "e", "said"])

    return own.join(listed, source).select("body", "claims").mapInArrow(run, "doc_id bigint, text_hash int, s int, e int, said binary")


def kept_words(joined: DataFrame, id_type: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and failed: the claims whose words differ, which remove nothing."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            size, gone, sha, failed = [], [], [], []
            for body, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, kept, at = z.decompress(body).split(), [], 0
                true: dict[tuple[int, int], bool] = {}
                for x in spans or ():
                    key = x["s"], x["e"]
                    true[key] = true.get(key, False) or b" ".join(words[x["s"] : x["e"]]) == z.decompress(x["said"])
                for s, e in sorted(k for k, ok in true.items() if ok):
                    if s > at:
                        kept += words[at:s]
                    at = max(at, e)
                kept += words[at:]
                size.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                failed.append(sum(not ok for ok in true.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(failed, pa.int64())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "failed"])

    return joined.select("doc_id", "body", "spans").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, failed bigint")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs. bits: those of the first try's hashes."""
    bodies = stash(packed(docs))
    for number in range(TRIES):
        said = source_words(claims(docs, bodies, window, gram, (number, bits if number == 0 else 64)), bodies)
        spans = said.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("s", "e", "said")).alias("spans"))
        joined = bodies.join(spans, ["doc_id", "text_hash"], "left")
        out = stash(kept_words(joined, docs.schema["doc_id"].dataType.simpleString()))
        if out.where("failed > 0").isEmpty():
            drop(bodies)
            return out.drop("failed")
        drop(out)
    raise RuntimeError(f"hashes clashed {TRIES} times")
