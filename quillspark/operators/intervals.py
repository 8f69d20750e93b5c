"""Points in intervals: an equi-join on bins in place of a comparison of all with all.

An interval belongs to the level whose bins are at least as long as it is, so it reaches into two bins at most, however
long it is; a point looks into one bin of each level that occurs. Bins that many points fall in are split: their points
are dealt by hash and their intervals repeated for each part. The join is on equal keys only, so any
join of Spark's will do, and every pair is found once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the bins of the first level, and points of a bin in one part, about.
WIDTH, HOT = 1024, 100_000
OWN = ("_level", "_bin", "_part", "_parts", "_seen")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Every row of points (keys, at, ...) beside every row of intervals (keys, start, stop, ...) with start <= at < stop
    and equal keys. Whole numbers below 2^53; a null place, end or key is in nothing, an interval whose stop isn't beyond its
    start holds nothing. Apart from the keys the two tables name their columns differently; names of OWN are taken."""
    log = F.ceil(F.log2((F.col(stop) - F.col(start)).cast("double") / width))
    good = intervals.where(F.col(start) < F.col(stop)).withColumn("_level", F.greatest(log, F.lit(0)).cast("int"))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    bins = lambda c: F.floor(c.cast("double") / size)
    reach = good.withColumn("_bin", F.explode(F.sequence(bins(F.col(start)), bins(F.col(stop) - 1))))
    levels = sorted(r[0] for r in good.select("_level").distinct().collect())  # 54 at most
    seen = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bins(F.col(at)))
    own = [*keys, "_level", "_bin"]
    crowded = seen.groupBy(*own).agg(F.count(F.lit(1)).alias("_seen")).where(F.col("_seen") > hot)
    crowded = crowded.select(*own, F.ceil(F.col("_seen") / F.lit(float(hot))).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = seen.join(crowded, own, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("_parts")
    held = reach.join(crowded, own, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    met = dealt.join(held, [*own, "_part"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop)))
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])
