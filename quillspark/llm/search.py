"""Ranked lexical search over term-bucketed postings, in whole numbers.

Postings hold one row for each document and term with its score before the term's weight; terms share
buckets by hash, and a bucket's documents are dealt to as many files as the session's shuffle partitions give it. Items join them on
their terms, matches are summed by item and document, and a window ranks each item's documents.

An item's frequent words match nearly every document, so the matches are many times the postings. They don't move:
postings are dealt by document once, and joining the items' terms (broadcast where the planner finds their
table small), summing by item and document, and the first cut to the best of each item all happen there. Only
each task's best of each item move on to the ranking. A term that no document or item shares is never dealt.

Defined cases: null texts and items, and those without a term, match nothing; rows that share a doc_id are
documents of their own, each with a rank; a null doc_id comes last among equal scores; rows that share an
item_id are ranked together as one item with the terms of all (a null item_id likewise); empty tables give
an empty result; texts are taken whole; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .words import strings, texts, words

TOP, BUCKETS = 20, 16


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def run(batches):
        for b in batches:
            sizes = [len(words(t)) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], names=["docs", "terms"])

    r = docs.select(F.col("text").cast("string")).mapInArrow(run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def frequencies(docs: DataFrame) -> DataFrame:
    """row (of its own for each document), doc_id, n (its terms), term, tf."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, at, size, term, tf = [], [], [], [], []
            for k, t in enumerate(texts(b.column(1))):
                w = words(t)
                found = Counter(w)
                rows += [row + k] * len(found)
                at += [k] * len(found)
                size += [len(w)] * len(found)
                term += found.keys()
                tf += found.values()
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.int64()), strings(term), pa.array(tf, pa.int64())], names=["row", "doc_id", "n", "term", "tf"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"row bigint, doc_id {kind}, n bigint, term string, tf bigint")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, r (times in the item)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            split = [words(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, w in enumerate(split) for _ in w], pa.int64())), strings([x for w in split for x in w])], names=["item_id", "term"])

    each = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, term string")
    return each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("r"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, n_docs: int, n_terms: int, terms: DataFrame | None = None) -> DataFrame:
    """bucket, term, row, doc_id, part (the score before the term's weight), of all terms or of those given."""
    f = frequencies(docs)
    if terms is not None:
        f = f.join(terms, "term", "left_semi")
    m = f"100 - 25 + ((25 * n * {n_docs}L) div {max(1, n_terms)}L)"
    dealt = f.select(bucket(F.col("term")).alias("bucket"), "term", "row", "doc_id", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * ({m}))").alias("part"))
    # as many tasks as the session shuffles with, whole buckets or equal parts of one each
    parts = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS))
    part = F.col("bucket") * parts + F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    return stash(dealt.repartitionById(BUCKETS * parts, part), by="bucket")


def weighted(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item_id, bucket, term, weight (times in the item included) of the terms that some document has."""
    facts = index.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * F.lit(float(n_docs)) + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("bigint") * F.col("r")
    return terms.withColumn("bucket", bucket(F.col("term"))).join(facts, ["bucket", "term"]).select("item_id", "bucket", "term", w.alias("weight")).where("weight > 0")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` best documents."""
    terms = stash(item_terms(items))
    most = terms.count()
    n_docs, n_terms = totals(docs)
    index = postings(docs, n_docs, n_terms, stash(terms.select("term").distinct(), most))
    own = stash(weighted(terms, index, n_docs), most)  # in few files, whose size tells the planner whether to broadcast
    matches = index.repartition("row").join(own, ["bucket", "term"])
    scores = matches.groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("part")).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
