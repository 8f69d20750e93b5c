"""Further analyses of documents, sections and terms. Row-local but for the sums within a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def priority_concepts(facts: DataFrame, most: int = 15, keep: tuple = ()) -> DataFrame:
    """doc_id, term, priority, rank: frequency (20 at most), category and length of the definition; with the columns `keep`."""
    n = F.length(F.coalesce("definition", F.lit("")))
    kind = reduce(lambda acc, x: acc.when(F.col("category") == x[0], x[1]), list(V.CATEGORY_PRIORITIES.items())[1:], F.when(F.col("category") == "api_concepts", V.CATEGORY_PRIORITIES["api_concepts"])).otherwise(3)
    score = F.least(F.col("frequency") * 2, F.lit(20)) + kind + F.when(n > 50, 5).when(n > 20, 2).otherwise(0)
    return top(facts.select("doc_id", "term", *keep, score.alias("priority")), ["doc_id"], [F.desc("priority"), "term"], most)


def tables_with_text(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, markdown, n_rows, n_cols of runs of over two pipe lines."""
    runs = T.find_all(F.concat(F.lit("\n"), "text", F.lit("\n")), r"(?:\n[^\n]*\|[^\n]*(?=\n)){3,}")
    d = docs.select("doc_id", F.posexplode(runs).alias("k", "run")).select("doc_id", (F.col("k") + 1).alias("table_no"), F.expr("substring(run, 2)").alias("markdown"))
    return d.select("*", (F.regexp_count("markdown", F.lit("\n")) - 1).alias("n_rows"), (F.regexp_count(F.element_at(F.split("markdown", "\n"), 1), F.lit(r"\|")) - 1).alias("n_cols"))


def important_tables(tables: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, table_no, score, rank: tables of moderate size and with key words first."""
    size = F.when(F.col("n_rows").between(3, 10) & F.col("n_cols").between(2, 6), 8).when((F.col("n_rows") > 0) & (F.col("n_cols") > 0), 3).otherwise(0)
    score = size + F.when(T.any_of(F.lower("markdown"), V.TABLE_WORDS), 6).otherwise(0)
    return top(tables.select("doc_id", "table_no", score.alias("score")), ["doc_id"], [F.desc("score"), "table_no"], most)


def examples(content: Column) -> Column:
    """Up to two code blocks and two passages of each of two phrases, cut short."""
    inner = lambda b: F.array_join(F.filter(F.split(b, "\n", -1), lambda x, i: (i > 0) & (i < F.size(F.split(b, "\n", -1)) - 1)), "\n")
    blocks = F.filter(F.slice(T.find_all(content, r"```[\s\S]*?```"), 1, 2), lambda b: F.size(F.split(b, "\n", -1)) > 2)
    code = F.transform(blocks, lambda b: F.concat(F.lit("Code: "), F.left(inner(b), F.lit(200)), F.lit("...")))
    said = lambda p: F.transform(F.slice(T.find_all(content, p, 1), 1, 2), lambda m: F.concat(F.lit("For instance: "), F.left(T.strip(m), F.lit(150)), F.lit("...")))
    return F.concat(code, *[said(p) for p in V.EXAMPLE_PATTERNS])


def technical_details(content: Column) -> Column:
    """Requests, parameters and responses one to a line, or else the first two sentences."""
    methods, paths = (T.find_all(content, r"(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w\-{}.:]+)", g) for g in (1, 2))
    calls = F.transform(F.slice(F.arrays_zip(methods.alias("m"), paths.alias("p")), 1, 3), lambda e: F.concat(F.lit("**"), e["m"], F.lit("** `"), e["p"], F.lit("`")))
    said = lambda name, p, k: F.transform(F.slice(T.find_all(content, p, 1), 1, k), lambda m: F.concat(F.lit(name), F.left(T.strip(m), F.lit(100))))
    found = F.concat(calls, said("Takes: ", V.PARAMETER_PATTERN, 2), said("Gives: ", V.RESPONSE_PATTERN, 1))
    first = F.slice(T.sentences(content), 1, 2)
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).when(F.size(first) > 0, F.array_join(first, " ")).otherwise("Nothing technical here.")


def section_points(s: Column, detailed: bool = False) -> Column:
    """Of sentences, the first and those with key words, joined; null without any. Detailed: the first
    three, the last two of over six, then telling ones between until eight stand; else the first two
    and the first telling one of the next four."""
    n, none = F.size(s), F.expr("cast(array() as array<string>)")
    if detailed:
        last = F.when(n > 6, F.slice(s, n - 1, F.lit(2))).otherwise(none)
        between = F.filter(F.slice(s, F.lit(4), F.greatest(n - 5, F.lit(0))), lambda x: T.says(x, V.DETAIL_WORDS))
        keep = F.concat(F.slice(s, 1, 3), last, F.slice(between, F.lit(1), F.lit(8) - 3 - F.size(last)))
    else:
        telling = F.filter(F.slice(s, 3, 4), lambda x: T.says(x, V.BRIEF_WORDS))
        keep = F.concat(F.slice(s, 1, 2), F.when(n > 3, F.slice(telling, 1, 1)).otherwise(none))
    return F.when(n > 0, F.array_join(keep, " "))


def trimmed_points(points: Column, target: int | Column) -> Column:
    return F.coalesce(T.trim_to_tokens(points, target), F.lit("This section is empty."))


def section_summary(content: Column, target: int | Column, detailed: bool = False) -> Column:
    """The telling sentences of a section, cut to `target` tokens."""
    return trimmed_points(section_points(T.sentences(content), detailed), target)


def top_connected(degrees: DataFrame, most: int = 10) -> DataFrame:
    return degrees.orderBy(F.desc("degree"), "term").limit(most)


def strong_pairs(pairs: DataFrame, most: int = 15) -> DataFrame:
    return pairs.where("weight > 2").orderBy(F.desc("weight"), "term_a", "term_b").limit(most)


def category_ranks(scores: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, category, term, score, rank within each category of at least three terms of a document."""
    all_ = Window.partitionBy("doc_id", "category")
    d = scores.withColumn("k", F.count(F.lit(1)).over(all_)).withColumn("rank", F.row_number().over(all_.orderBy(F.desc("score"), "term")))
    return d.where(F.col("k") >= least).select("doc_id", "category", "term", "score", "rank")


def structure_sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, section: numbered lines as they come, and short capital or title lines not yet seen."""
    listed = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in V.STRUCTURE_LISTS])
    numbered = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in V.STRUCTURE_SECTIONS])
    title = lambda s: T.is_upper(s) | s.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$")
    head = lambda x: (T.strip(x) != "") & (F.length(T.strip(x)) < 60) & title(T.strip(x)) & ~T.strip(x).startswith("•") & ~listed(x)
    ls = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), T.strip(x).alias("s"), numbered(x).alias("numbered"), head(x).alias("head")))
    d = docs.select("doc_id", F.explode(F.filter(ls, lambda x: x["numbered"] | x["head"])).alias("x")).select("doc_id", "x.*")
    w = Window.partitionBy("doc_id", "s").orderBy("i")
    kept = d.withColumn("first", F.row_number().over(w) == 1).where("numbered OR first")
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).alias("ord"), F.col("s").alias("section"))


def field_context(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, context, section: the five lines around each line with a colon, and the numbered title in them."""
    def row(line: Column, i: Column) -> Column:
        start = F.greatest(i - 2, F.lit(0))
        near = F.array_join(F.filter(F.slice("ls", start + 1, i + 3 - start), lambda x: x != ""), " ")
        return F.when(F.contains(line, F.lit(":")), F.struct(i.alias("line_no"), near.alias("context")))

    d = docs.select("doc_id", F.transform(F.split("text", "\n", -1), T.strip).alias("ls")).select("doc_id", F.explode(F.array_compact(F.transform("ls", row))).alias("x")).select("doc_id", "x.*")
    return d.withColumn("section", F.trim(F.nullif(F.regexp_extract("context", r"(\d+\.\d+\s+[A-Z][^:]+)", 1), F.lit(""))))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, sizes and flags of a Markdown document. A null text is an empty one."""
    c = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.length(c).alias("total_characters"), F.size(T.find_all(c, r"\S+")).alias("total_words"), F.size(T.find_all(c, r"(?m)^#{1,6}[ \t]+\S")).alias("total_headers"),
        F.size(T.find_all(F.concat(F.lit("\n"), c, F.lit("\n")), r"(?:\n[^\n]*\|[^\n]*(?=\n)){3,}")).alias("total_tables"), F.size(T.find_all(c, r"!\[([^\]]*)\]\(([^)]+)\)")).alias("total_images"), T.has_toc(c).alias("has_toc"),
        F.greatest(F.lit(1), F.floor(F.length(c) / 3000)).cast("int").alias("estimated_pages"), c.rlike(r"(?m)^#{1,6}\s+").alias("has_headers"), c.rlike(r"(?m)^[*\-+]\s+").alias("has_lists"), F.contains(c, F.lit("```")).alias("has_code_blocks"),
    )


def page_offsets(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, start, end: where each page lies in the pages' joined text (joiners not counted)."""
    w = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("page_text")).over(w)
    return pages.select("doc_id", "page_num", (end - F.length("page_text")).alias("start"), end.alias("end"))


def guidance(size: Column, section_type: Column, tokens: Column) -> Column:
    """Notes on a chunk by its size, section type and tokens."""
    pick = lambda c, notes: reduce(lambda acc, x: acc.when(c == x[0], x[1]), notes[1:], F.when(c == notes[0][0], notes[0][1]))
    return F.array_compact(F.array(pick(size, V.SIZE_NOTES), pick(section_type, V.TYPE_NOTES), F.when(tokens < 1000, V.TOKEN_NOTES[0]).when(tokens > 5000, V.TOKEN_NOTES[1])))


def table_usage(profiles: DataFrame) -> DataFrame:
    """doc_id, table_no, usage: what a profiled table is good for."""
    t = profiles.groupBy("doc_id", "table_no").agg(F.max("n").alias("rows"), F.count_if("has_number").alias("numeric"), F.count_if(F.col("n_unique") <= 10).alias("grouping"))
    notes = F.array(F.when(F.col("numeric") >= 2, V.USAGE_NOTES[0]), F.when(F.col("grouping") > 0, V.USAGE_NOTES[1]), F.when(F.col("rows") > 20, V.USAGE_NOTES[2]).otherwise(V.USAGE_NOTES[3]))
    return t.select("doc_id", "table_no", F.array_join(F.array_compact(notes), "; ").alias("usage"))
