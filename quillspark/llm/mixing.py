"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The mix takes SHARE times all words. Sources, in code-point order (null last), have the repeating
weights WEIGHTS. A source gets its weight's share until it stands at CAP times its own size; what is
over goes to the others by weight until none is above. Ordered by size over weight the fixed point
has a closed form: source j is clamped exactly if the level that remains after clamping all
before it reaches its cap. (The order of sources is a window over one row a source.)

A document's rate is its source's target over its source's size. The whole part of the rate repeats
every document whole; the fractional part is a systematic sample of whole documents: in the order of
a seeded number, documents are taken until the source has its target. Only the document where it
gets there is cut, to a run of words of seeded place, so each source meets its target to the word.
That place is found without ordering a source: sums by range of the seeded number tell the range in
which it lies, and only that range's documents are ordered. No step moves texts.

Defined cases: a null text has size 0; a document without words is not in the mix; empty tables
give empty results; a source without words has target 0; repeated rows of a doc_id
are documents of their own and get equal amounts (if the target lies within them, each a part); documents
whose doc_id is null use their text as seed; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

SHARE, CAP, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), "mix-1"
#: Documents of a source in one range of the seeded number, about.
RANGE = 2000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("clamped", F.col("level") >= F.col("cap") / F.col("weight"))
    free = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0.0))
    return w.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(rest / free * F.col("weight"))).select("source", "source_size", "target")


def seeded(key: Column, salt: str, digits: int = 15) -> Column:
    """A whole number of so many hexadecimal digits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{salt}:"), key)), 1, digits), 16, 10).cast("bigint")


def seed_key(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def amounts(own: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source of own (source, size, turn: the seeded number): source, source_size, target,
    whole (copies of every document), last (the turn at which the rest of the target is reached; documents
    of smaller turns get one more copy), part and among (documents of that turn get part of among)."""
    sums = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rate = targets(sums.select("source", "source_size"), share, cap, weights).withColumnRenamed("source", "_s").withColumnRenamed("source_size", "_z")
    goal = sums.join(rate, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_z")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    goal = stash(goal.withColumn("rest", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("bigint")).withColumn("ranges", F.ceil(F.col("rows") / F.lit(float(RANGE)))))
    narrow = goal.where("rest > 0").select(F.col("source").alias("_s"), "rest", "ranges")
    ranged = own.join(narrow, F.col("source").eqNullSafe(F.col("_s"))).withColumn("range", F.floor(F.col("turn") / F.lit(float(16**15)) * F.col("ranges")))
    by_range = ranged.groupBy("_s", "range", "rest").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("_s").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    crossed = by_range.withColumn("upto", F.sum("words").over(run)).where("upto >= rest and upto - words < rest")
    crossed = stash(crossed.select(F.col("_s").alias("_t"), F.col("range").alias("_r"), (F.col("upto") - F.col("words")).alias("before")))
    inside = ranged.join(crossed, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("range") == F.col("_r"))).groupBy("_s", "rest", "before", "turn").agg(F.sum("size").alias("among"))
    run = Window.partitionBy("_s").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("among").over(run)).where("upto >= rest and upto - among < rest")
    end = inside.select("_s", F.col("turn").alias("last"), (F.col("rest") - (F.col("upto") - F.col("among"))).alias("part"), "among")
    found = goal.join(end, F.col("source").eqNullSafe(F.col("_s")), "left")
    return found.select("source", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("among", F.lit(1)).alias("among"))


def extra(size: Column, turn: Column, last: Column, part: Column, among: Column) -> Column:
    """Words beyond the whole copies."""
    some = size * part
    return F.when(turn < last, size).when(turn == last, F.round((some - some % among) / among).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    own = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), seeded(seed_key(docs), "turn").alias("turn")))
    goal = stash(amounts(own.select("source", "size", "turn"))).withColumnRenamed("source", "_source")
    joined = own.join(goal, own["source"].eqNullSafe(F.col("_source")))
    taken = F.col("whole") * F.col("size") + extra(F.col("size"), *map(F.col, ("turn", "last", "part", "among")))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of docs: documents whole, but for the one of each source that is cut
    to a run of its words, joined by one space, of seeded place. n_chars counts the new text."""
    own = stash(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), seeded(seed_key(docs), "turn").alias("turn")))
    goal = stash(amounts(own))
    goal = goal.select(*[F.col(c).alias(f"__qs_{c}") for c in goal.columns])
    d = docs.withColumn("__qs_turn", seeded(seed_key(docs), "turn")).join(goal, docs["source"].cast("string").eqNullSafe(F.col("__qs_source")))
    at, last = F.col("__qs_turn"), F.col("__qs_last")
    # words are counted again only where a document may be cut
    size = F.when(at == last, words(F.col("text")))
    d = d.where(F.col("text").rlike(WORD)).withColumn("__qs_size", size).withColumn("__qs_cut", F.coalesce(extra(F.col("__qs_size"), at, last, F.col("__qs_part"), F.col("__qs_among")), F.lit(0)))
    cut = F.when(at == last, F.col("__qs_cut")).otherwise(F.lit(0))
    d = d.withColumn("__qs_cut", cut).withColumn("__qs_full", F.col("__qs_whole") + F.when(at < last, 1).when((F.col("__qs_cut") > 0) & (F.col("__qs_cut") == F.col("__qs_size")), 1).otherwise(0))
    d = d.withColumn("__qs_copies", F.col("__qs_full") + F.when((F.col("__qs_cut") > 0) & (F.col("__qs_full") == F.col("__qs_whole")), 1).otherwise(0)).where("__qs_copies > 0")
    d = d.withColumn("__qs_copy", F.explode(F.sequence(F.lit(1), F.col("__qs_copies").cast("int"))))
    partial = F.col("__qs_copy") > F.col("__qs_full")
    start = F.pmod(seeded(seed_key(docs), "place"), F.col("__qs_size") - F.col("__qs_cut") + 1).cast("int")
    run = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), start + 1, F.col("__qs_cut").cast("int")), " ")
    d = d.withColumn("__qs_text", F.when(partial, run).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(partial, F.length("__qs_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.withColumn("text", F.col("__qs_text")).select(*docs.columns)
