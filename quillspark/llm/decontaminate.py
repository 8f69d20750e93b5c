"""Benchmark decontamination by a distributed positional inverted index.

The training texts are indexed whole: documents stand one after another in blocks of about BLOCK words, with
GAP places between them, and a block has for each of its terms the ascending places where it stands (as
differences, in one binary value). A block is a shard of the index: lists of different terms meet by
block, no list of a term is ever gathered, and hot terms are as many lists as there are blocks.

Items are cut into windows of WINDOW words; equal texts of items are one. A window is looked up from its rarest
terms, by the counts of the index: the two rarest words' lists, each less the word's offset, are
intersected (within SLOP places), and only what is left is compared with the lists of all its words.
Windows with the same two rarest words are looked up together.

A window occurs exactly where all its words stand at their places. It is near where its rarest word (the first of
equal ones) stands and every other word has some occurrence within SLOP places of its own; near
matches are reported beside the exact ones and mark no word.

Defined cases: null texts and items have no words; an item of fewer than WINDOW words, but not none, is one
window; rows that share an item_id are windows of one item; an item whose item_id is null marks words but
isn't listed or counted; rows that share a doc_id, or have none, are documents of their own; matches don't
cross documents; texts are taken whole; empty tables give no match; only doc_id, item_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, group_starts, stash, whole_groups
from .words import strings, texts, words

WINDOW, SLOP = 10, 2
#: Words of a block, places between documents (over WINDOW + 2 SLOP), and places of a range in which documents are looked up.
BLOCK, GAP, RANGE = 2_000_000, 64, 4096


class Numbers(dict):
    """Numbers terms from 0 as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Block:
    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.at, self.ends, self.size = number, Numbers(), [], [], [], 0

    def add(self, text: bytes | None) -> tuple[int, int]:
        """(first place, words) of the document."""
        w, base = words(text), self.size
        self.ids.append(np.fromiter(map(self.terms.__getitem__, w), np.int64, len(w)))
        self.at.append(np.arange(base, base + len(w)))
        self.size += len(w) + GAP
        return base, len(w)

    def lists(self) -> tuple[list[bytes], np.ndarray, pa.Array]:
        """Terms, their counts, and the differences of their places as 32-bit numbers."""
        order = np.sort(np.concatenate(self.ids) << 32 | np.concatenate(self.at)) if self.ids else np.zeros(0, np.int64)
        term, at = order >> 32, (order & 0xFFFFFFFF).astype(np.int32)
        count = np.bincount(term, minlength=len(self.terms))
        start = np.cumsum(count) - count
        step = np.diff(at, prepend=np.int32(0))
        step[start] = at[start]
        ends = np.concatenate((start, [len(at)])).astype(np.int32) * 4
        return list(self.terms), count, pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(step.tobytes())])


def places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """block, term, n, steps: one row for each block and term. Rows without a term are the documents:
    block, n (words), base (first place) and doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "term", "n", "steps", "base", "doc_id"]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for b in batches:
            ids, base, size, of = b.column(0), [], [], []

            def documents():
                k = len(base)
                return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.nulls(k, pa.string()), pa.array(size, pa.int64()), pa.nulls(k, pa.binary()), pa.array(base, pa.int64()), ids], names=names)

            for t in texts(b.column(1)):
                at, n = block.add(t)
                of.append(block.number)
                base.append(at)
                size.append(n)
                if block.size >= BLOCK:
                    yield from told(block)
                    number += 1
                    block = Block(number)
            yield documents()
        yield from told(block)

    def told(block):
        terms, count, steps = block.lists()
        k = len(terms)
        for lo in range(0, k, 20_000):
            hi = min(k, lo + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, block.number)), strings(terms[lo:hi]), pa.array(count[lo:hi]), steps[lo:hi], pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, doc_type)], names=names)

    doc_type = arrow_type(docs, "doc_id")
    made = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"block bigint, term string, n bigint, steps binary, base bigint, doc_id {kind}")
    return stash(made, codec="zstd")


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def item_words(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, i, term) of every different text of items with its size, and (key, item_id)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            split = [words(t) for t in texts(b.column(1))]
            flat = strings([w for ws in split for w in ws])
            ends = np.concatenate(([0], np.cumsum([len(ws) for ws in split]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["item_id", "terms"])

    each = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, terms array<string>").where("size(terms) > 0")
    each = stash(each.withColumn("key", F.sha2(F.array_join("terms", " "), 256)))
    once = each.groupBy("key").agg(F.first("terms").alias("terms"))
    return stash(once.select("key", F.size("terms").alias("size"), F.posexplode("terms").alias("i", "term"))), each.select("key", "item_id").distinct()


def lookups(own: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """key, i1, term1, i2, term2 (null for windows of one word), width, first and last: the windows from first to last
    have these two rarest words. Windows with a word that no document has can't occur and are left out."""
    lists = index.where("term is not null").select("term", "n").join(own.select("term").distinct(), "term")
    counts = stash(lists.groupBy("term").agg(F.sum("n").alias("n")))
    frame = Window.partitionBy("key").orderBy("i").rowsBetween(0, window - 1)
    w = own.join(counts, "term", "left").withColumn("all", F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term")).over(frame))
    w = w.withColumn("width", F.least("size", F.lit(window))).where("size(all) = width").withColumn("all", F.array_sort("all")).where("all[0].n > 0")
    rare = w.select("key", "width", "i", F.col("all")[0].alias("a"), F.get("all", F.lit(1)).alias("b"))
    return stash(rare.groupBy("key", "width", F.col("a.i").alias("i1"), F.col("a.term").alias("term1"), F.col("b.i").alias("i2"), F.col("b.term").alias("term2")).agg(F.min("i").alias("first"), F.max("i").alias("last")))


def candidates(found: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """key, width, i1, first, last, block, start: places where the text of an item would begin, by its two rarest words."""
    lists = index.where("term is not null").select("block", "term", "steps")
    one = found.join(lists.withColumnRenamed("term", "term1").withColumnRenamed("steps", "steps1"), "term1")
    second = lists.join(found.select(F.col("term2").alias("term")).distinct(), "term", "left_semi")
    two = one.join(second.withColumnRenamed("term", "term2").withColumnRenamed("steps", "steps2"), ["block", "term2"], "left").where("i2 is null or steps2 is not null")
    names = ["key", "width", "i1", "first", "last", "block", "start"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for key, width, i1, first, last, block, i2, s1, s2 in zip(*(b.column(k).to_pylist() for k in range(9))):
                start = places(s1) - i1
                if i2 is not None:
                    start = start[nearest(places(s2), start + i2) <= slop]
                start = start[start + last >= 0]
                for o, x in zip(out, (key, width, i1, first, last, block)):
                    o.extend(repeat(x, len(start)))
                out[6].append(start)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(o, pa.int32()) for o in out[1:5]], pa.array(out[5], pa.int64()), pa.array(np.concatenate(out[6]))], names=names)

    cols = ["key", "width", "i1", "first", "last", "block", "i2", "steps1", "steps2"]
    return stash(two.select(*cols).mapInArrow(run, "key string, width int, i1 int, first int, last int, block bigint, start bigint"))


def nearest(at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How far the nearest of the ascending places is from each wanted one."""
    k = np.searchsorted(at, wanted)
    return np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - wanted), np.abs(wanted - at[np.maximum(k - 1, 0)]))


def compared(cands: DataFrame, own: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """The candidates' words (i) that stand within slop places of their own, with how far off. Lists and wanted places
    of a block's term meet in one task, the list first; a block's size bounds them."""
    words_of = own.select("key", "i", "term")
    wanted = cands.join(words_of, "key").where("i >= first and i < last + width").withColumn("at", F.col("start") + F.col("i")).where("at >= 0")
    cols = ["key", "width", "i1", "first", "last", "block", "start", "i"]
    lists = index.where("term is not null").select("block", "term", "steps").join(own.select("term").distinct(), "term", "left_semi").join(cands.select("block").distinct(), "block", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in cols if c != "block"]
    both = wanted.select("term", "at", F.lit(None).cast("binary").alias("steps"), *cols).unionByName(lists.select("term", F.lit(-1).cast("bigint").alias("at"), "steps", "block", *none))

    def run(batches):
        for t in whole_groups(batches, ["block", "term"], 50_000):
            cuts = [*group_starts(t, ["block", "term"]), t.num_rows]
            at, keep, off = t["at"].to_numpy(), [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if at[lo] >= 0 or hi - lo < 2 or t["steps"][int(lo)].as_py() is None:
                    continue
                d = nearest(places(t["steps"][int(lo)].as_py()), at[lo + 1 : hi])
                ok = np.flatnonzero(d <= slop)
                keep.append(lo + 1 + ok)
                off.append(d[ok])
            if keep:
                kept = t.select(cols).take(pa.array(np.concatenate(keep))).append_column("off", pa.array(np.concatenate(off).astype(np.int32)))
                yield from kept.combine_chunks().to_batches()

    dealt = both.repartition("block", "term").sortWithinPartitions("block", "term", "at")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", off int")


def documents(index: DataFrame) -> DataFrame:
    return index.where("term is null").select("block", "base", F.col("n").alias("n_words"), "doc_id")


def in_documents(df: DataFrame, index: DataFrame) -> DataFrame:
    """df (block, anchor) with base of the document that the place is in: an interval join by ranges of places,
    each of which few documents reach into."""
    n = F.lit(RANGE)
    reach = documents(index).where("n_words > 0").select("block", "base", (F.col("base") + F.col("n_words")).alias("stop"))
    reach = reach.withColumn("range", F.explode(F.sequence(F.floor(F.col("base") / n), F.floor((F.col("stop") - 1) / n))))
    found = df.withColumn("range", F.floor(F.col("anchor") / n)).join(reach, ["block", "range"])
    return found.where("anchor >= base and anchor < stop").drop("range", "stop", "anchor")


def occurrences(index: DataFrame, own: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """block, base (which tell the document), key, offset (of the window), at, width, exact: every place where a window of
    a text of items occurs exactly or near."""
    found = lookups(own, index, window)
    hits = compared(candidates(found, index, slop), own, index, slop)
    each = hits.groupBy("block", "key", "width", "i1", "first", "last", "start").agg(F.collect_list(F.struct("i", "off")).alias("hits"))
    within = lambda o, most: F.size(F.filter("hits", lambda h: (h["i"] >= o) & (h["i"] < o + F.col("width")) & (h["off"] <= most))) == F.col("width")
    opened = F.transform(F.sequence("first", "last"), lambda o: F.struct(o.alias("offset"), (F.col("start") + o).alias("at"), within(o, 0).alias("exact"), within(o, slop).alias("near")))
    told = each.select("block", "key", "width", (F.col("start") + F.col("i1")).alias("anchor"), F.inline(opened)).where("near").drop("near")
    return stash(in_documents(told, index))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, place (where its first word is or would be, from 0), width, exact: each occurrence of a window."""
    index = build_index(docs)
    own, ids = item_words(items)
    hits = occurrences(index, own, window, slop).join(documents(index), ["block", "base"]).join(ids, "key")
    return hits.select("doc_id", "item_id", (F.col("at") - F.col("base")).alias("place"), "width", "exact").distinct()


def covered(spans: Column) -> Column:
    """Places covered by sorted (at, width) spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["at"] + x["width"] - F.greatest(acc["upto"], x["at"]))).alias("n"), F.greatest(acc["upto"], x["at"] + x["width"]).alias("upto"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items that are near in the document but
    nowhere exact) of every row of docs."""
    index = build_index(docs)
    own, ids = item_words(items)
    hits = occurrences(index, own, window, slop)
    key = ["block", "base"]
    span = F.array_sort(F.collect_set(F.struct(F.col("at").cast("bigint").alias("at"), F.col("width").cast("bigint").alias("width"))))
    marked = hits.where("exact").groupBy(*key).agg(span.alias("spans")).select(*key, covered(F.col("spans")).alias("n_hit"))
    named = hits.groupBy(*key, "key").agg(F.max("exact").alias("exact")).join(ids.where("item_id is not null"), "key").groupBy(*key, F.col("item_id").cast("string").alias("item")).agg(F.max("exact").alias("exact"))
    listed = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near"))
    out = documents(index).join(marked, key, "left").join(listed, key, "left")
    of = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(of).cast("bigint").alias("n_items"), F.sha2(F.array_join(of, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))
