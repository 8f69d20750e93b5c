"""Outlines of any depth kept as rows of (doc_id, node, parent): depth-first order and levels without recursion.

Each node holds the way down to it from the farthest ancestor known; in every round it takes over that of this
ancestor, so ways double and a tree of depth d takes about log2(d) joins on (doc_id, node). Rounds are cut with
checkpoints and only whether rows are open is asked of them. Nodes whose ways come back on themselves are cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def ways(nodes: DataFrame) -> DataFrame:
    """doc_id, node, way (sort keys and nodes from the root down to the node), cyclic (above it lies a cycle, or it is in
    one; way is null)."""
    step = F.struct(F.col("ord"), F.col("node"))
    now = cut(nodes.select("doc_id", "node", F.col("parent").alias("up"), F.array(step).alias("way"), F.lit(False).alias("cyclic")))
    while not now.where("up is not null").isEmpty():
        top = now.select("doc_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("way").alias("_way"), F.col("cyclic").alias("_cyclic"))
        open_, done = now.where("up is not null"), now.where("up is null")
        met = open_.join(top, ["doc_id", "up"], "left")
        round_ = F.coalesce("_cyclic", F.lit(False)) | F.exists("_way", lambda x: x["node"] == F.col("node"))
        round_ = F.coalesce(round_, F.lit(False))
        way = F.when(~round_, F.when(F.col("_way").isNull(), F.col("way")).otherwise(F.concat("_way", "way")))
        now = cut(done.unionByName(met.select("doc_id", "node", F.when(~round_, F.col("_up")).alias("up"), way.alias("way"), round_.alias("cyclic"))))
    return now.select("doc_id", "node", "way", "cyclic")


def flatten_adjacency(nodes: DataFrame) -> DataFrame:
    """doc_id, ord (from 0, depth first), node, title, level (from 0) of outlines as rows of doc_id, node, parent, ord
    (among its siblings; then node), title. A parent that isn't there, or null, makes a root. Nodes in cycles, or
    under one, are left out (`cycles` lists them). A node's key comes once in a document; null keys have no place and are left out."""
    known = nodes.where("node is not null")
    way = ways(known).where("not cyclic").select("doc_id", "node", "way")
    order = Window.partitionBy("doc_id").orderBy("way")
    told = way.join(known.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), "title"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("node") == F.col("_n")))
    return told.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "node", "title", (F.size("way") - 1).alias("level"))


def cycles(nodes: DataFrame) -> DataFrame:
    """doc_id, node of those that no root leads to."""
    return ways(nodes.where("node is not null")).where("cyclic").select("doc_id", "node")
