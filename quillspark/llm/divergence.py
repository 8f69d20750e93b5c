"""Source divergence audit: how far each source's use of words is from the other sources of its language.

Plain relations. Terms are exploded from regular-expression matches and counted by language, source and
term; a language keeps the terms that at least LEAST of its documents have. Its sources meet its
kept terms, so that a term a source lacks counts zero there, and every count becomes a smoothed share p. The
dense table joined with itself on language and term gives, for each two sources, the sum of
(p-q)^2 / (p+q); against the language's own shares it gives the terms that mark a source.

A document's terms are sorted in its own row and put beside the term before, so that its first occurrence of each shows without a
shuffle of (document, term) pairs: one grouping gives both occurrences and documents, and combines before it
shuffles. The difference is symmetric, so each two sources are summed once and told twice. Products
that may pass 64 bits go through decimals.

Defined cases: null text, language and source read as ''; a group without terms has zero counts, and
pairs of value 0 where its language keeps none; repeated rows are documents of their own; terms are told
apart by their bytes, with only A-Z folded; texts of any length are taken whole; an empty table gives an
empty result; only text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: What parts terms, which hold letters and signs beyond ASCII. Texts are split there: taking the matches between
#: (regexp_extract_all) copies the text for each match, which is quadratic.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, SHOWN = 10, 10
#: Of bigints count, total and kept: 1 + floor(10^9 (count + 2) / (total + 2 kept)).
SHARE = "cast(1000000000 AS decimal(10,0)) * cast({count} + 2 AS decimal(20,0)) div cast({total} + 2 * kept AS decimal(20,0)) + 1"
DISTANCE = "(p - q) * (p - q) div (p + q)"


def fold(text: Column) -> Column:
    """A-Z in lower case; texts without signs beyond ASCII take the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    own = named(docs).select("lang", "source", F.sort_array(F.split(fold(F.col("text")), BETWEEN)).alias("terms"))
    each = own.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit("")), "terms").alias("before")))).where("term <> ''")
    return each.select("lang", "source", "term", (F.col("term") != F.col("before")).cast("bigint").alias("first")).groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def dense_shares(kept: DataFrame, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """id, group, p of every kept term (of a language) and source of its language."""
    every = vocabulary.select("id", "lang").join(groups.select("lang", "group", "total", "kept"), "lang")
    return every.join(kept.select("id", "group", "n"), ["id", "group"], "left").select("id", "group", F.expr(SHARE.format(count="coalesce(n, 0)", total="total")).alias("p"))


def source_pairs(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value of every two sources of a language."""
    other = dense.select("id", F.col("group").alias("other"), F.col("p").alias("q"))
    sums = dense.join(other, "id").where("group < other").groupBy("group", "other").agg(F.sum(F.expr(DISTANCE)).alias("value"))
    both = sums.select("value", F.inline(F.array(F.struct("group", "other"), F.struct(F.col("other").alias("group"), F.col("group").alias("other")))))
    pairs = groups.select("lang", "source", "group").join(groups.select("lang", F.col("source").alias("item"), F.col("group").alias("other")), "lang").where("group <> other")
    return pairs.join(both, ["group", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def marked_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has above its language's share), value."""
    mine = kept.join(groups, "group")
    shares = mine.select("lang", "source", F.col("term").alias("item"), F.expr(SHARE.format(count="n", total="total")).alias("p"), F.expr(SHARE.format(count="every", total="whole")).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", F.expr(DISTANCE).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = stash(term_counts(docs))
    # numbers stand for a language's term and a language's source from here on: the joins move no strings
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("every"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    vocabulary = stash(known.select("lang", "term", "every", F.monotonically_increasing_id().alias("id")))
    names = stash(named(docs).select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))
    kept = stash(counts.join(vocabulary, ["lang", "term"]).join(names, ["lang", "source"]).select("group", "id", "term", "n", "every"))
    of_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("every").alias("whole"))
    groups = names.join(kept.groupBy("group").agg(F.sum("n").alias("total")), "group", "left").join(of_lang, "lang", "left")
    groups = stash(groups.select("lang", "source", "group", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "whole")]))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(source_pairs(stash(dense_shares(kept, vocabulary, groups)), groups), "pair")
    return pairs.unionByName(ranked(marked_terms(kept, groups), "term").where(F.col("rank") <= shown))
