"""Shared plumbing of the training-data operators: shared-folder tables, Arrow passes, hot-group
splitting and connected components. Everything here is distributed; the driver sees row counts only."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: maximal runs of anything but the six ASCII spaces. bytes.split() and
#: str.split(" \t\n\v\f\r") style splitting agree with it on UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        file = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(file))
        # texts may be long: Python workers see a few rows, and a few bytes, at a time, unless the user says otherwise
        for key, usual, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "268435456", "16777216")):
            key = f"spark.sql.execution.arrow.{key}"
            if re.sub(r"\D", "", spark.conf.get(key, usual)) == usual:
                spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and
    the driver is the only executor (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir()


#: Narrow rows (a few numbers) in one file of the shared folder.
FILE_ROWS = 250_000


def stash(df: DataFrame, rows: int | None = None, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. Where
    a bound on its (narrow) rows is known, it goes to as few files as that takes. by: a folder for each value of
    this column, which comes last then; codec: other than the session's."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def remove(spark: SparkSession, pattern: str) -> None:
    """Deletes the files and folders of the shared folder that match."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path) or ():
        fs.delete(found.getPath(), True)


def drop(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.stashed_at)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table of this application's shared folder, once results have been read."""
    for name in ("stash-*", "pipeline-*"):
        remove(spark, f"{shared_dir(spark)}/{name}")


def bounded_sample(df: DataFrame, total: int, size: int, *keys: str) -> DataFrame:
    """At most `size` rows, those of least hash of the keys, of `total`. A first cut by hash leaves
    little more than `size` rows in all tasks together, so the final ordering moves no more."""
    h = F.pmod(F.xxhash64(*keys, F.lit(99)), F.lit(1 << 30))
    share = min(1.0, (size + 4 * size**0.5 + 16) / max(1, total))
    return df.where(h < F.lit(int(np.ceil(share * (1 << 30))))).orderBy(h, *keys).limit(size)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, in order, of about `rows` rows each; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(t, keys)
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.combine_chunks().to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def split_hot(df: DataFrame, keys: list[str], item: Column, size: int) -> DataFrame:
    """Deals groups to tasks of at most about 2 x size rows without losing a pair: a group of n rows
    is cut in g = ceil(n / size) chunks by a hash of the item, and each pair of chunks is a task
    (columns part_x <= part_y); each row goes to g tasks. Column chunk says which chunk it is of.
    Groups of one row have no pairs and go."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    g = F.ceil(F.col("_n") / F.lit(float(size))).cast("int")
    cut = df.join(n, keys).withColumn("_g", g).withColumn("chunk", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_g")).cast("int"))
    cut = cut.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return cut.withColumn("part_x", F.least("chunk", "_d")).withColumn("part_y", F.greatest("chunk", "_d")).drop("_n", "_g", "_d")


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def local_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable, for links i-j among 0..n-1, on top of the labels so far."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        live = a != b
        if not live.any():
            break
        i, j, a, b = i[live], j[live], a[live], b[live]
        root = np.arange(n)
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint), equal roots exactly within a component.

    Random contraction: in each round every node points at the neighbour (or itself) of least
    seeded hash, edges move to what their ends point at, and loops and repeats go; a constant share
    of the nodes goes each round, chains included. Pointers are composed backwards at the end.
    Joins are plain equi-joins, whose hot keys AQE splits; groupings combine before the shuffle."""
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    bound = 2 * edges.count()  # nodes, and edges ever after
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        r = F.lit(len(steps))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")), F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("b").alias("to")))).alias("e")).select("e.*")
        to = stash(both.groupBy("node").agg(F.min(F.struct(F.xxhash64("to", r).alias("h"), F.col("to"))).alias("m")).select("node", F.col("m.to").alias("to")), bound)
        steps.append(to)
        pa_, pb_ = to.select(F.col("node").alias("a"), F.col("to").alias("pa")), to.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        moved, before = edges.join(pa_, "a").join(pb_, "b").where("pa <> pb"), edges
        edges = stash(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), bound)
        drop(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1].withColumnRenamed("to", "root")
    for to in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = stash(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), bound)
    return found
