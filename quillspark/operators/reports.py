"""Markdown reports as tables of files: doc_id, path, body. Each groups the rows of one document by
its key and joins their lines in a stated order; sinks.write_text writes them. No wall clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .analysis import guidance
from .chunks import split_sections
from .matching import meet

NAME = {"summaries": "summaries", "concepts": "concepts", "tables": "tables", "chunked": "chunks", "references": "references", "sections": "sections"}


def cat(*parts) -> Column:
    """Strings and columns joined; a plain str is a literal, a null part is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def title(c: Column | str) -> Column:
    """Words with capitals; a plain str is a literal, made here: the driver would load title tables of all scripts to fold it (3 GB passed through its heap)."""
    if isinstance(c, str):
        return F.lit(" ".join(w.capitalize() for w in c.split("_")))
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def listing(source: DataFrame, order: list, line: Column, keys: tuple = ("doc_id",), sep: str = "\n", **more: Column) -> DataFrame:
    """Keys, n (rows), body (lines in `order`) and further aggregates."""
    # made by a projection, which is compiled, as what stands within collect_list isn't
    source = source.withColumn("_item", F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], line.alias("line")))
    items = F.sort_array(F.collect_list("_item"))
    g = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), items.alias("items"), *[c.alias(k) for k, c in more.items()])
    return g.select(*keys, "n", F.array_join(F.transform("items", lambda x: x["line"]), sep).alias("body"), *more)


def _file(rows: DataFrame, path, body: Column) -> DataFrame:
    return rows.select("doc_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), body.alias("body"))


def glossary(facts: DataFrame, most: int = 20, per_category: int = 10) -> DataFrame:
    """concepts/glossary.md: terms of score 5 and over, then the frequent terms of each category."""
    # facts are read once: both ranks stand beside each term, and one sum a document takes the lines
    over = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = facts.select("*", over(["doc_id"], F.desc("score"), "term").alias("rank"), over(["doc_id", "category"], F.desc("frequency"), "term").alias("rank_in"))
    high = cat("### ", title(F.col("term")), "\nClass: ", title(F.col("category")), "\nFound: ", F.col("frequency"), " times\nIn: ", F.col("sections"), "\n",
               F.when(F.col("definition").isNotNull(), cat("Meaning: ", F.col("definition"), "\n")), F.when(F.col("context").isNotNull(), cat("Where: ...", F.col("context"), "...\n")))
    line = cat("- **", title(F.col("term")), "** (", F.col("frequency"), "x)", F.when(F.col("definition").isNotNull(), cat(": ", F.left("definition", F.lit(100)), "...")))
    is_high, is_by = (F.col("score") >= 5) & (F.col("rank") <= most), (F.col("category") != "general") & (F.col("rank_in") <= per_category)
    ranked = ranked.select("doc_id", "category", F.when(is_high, F.struct("rank", high.alias("line"))).alias("h"), F.when(is_by, F.struct("category", "rank_in", line.alias("line"))).alias("b"))
    g = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("category")).alias("k"), F.sort_array(F.collect_list("h")).alias("hs"), F.sort_array(F.collect_list("b")).alias("bs"))
    lines = lambda xs: F.array_join(F.transform(xs, lambda x: x["line"]), "\n")
    block = lambda c: cat("## Of class ", title(c), "\n\n", lines(F.filter("bs", lambda x: x["category"] == c)), "\n")
    by = F.array_join(F.transform(F.array_distinct(F.transform("bs", lambda x: x["category"])), block), "\n")
    d = g.select("doc_id", "n", "k", lines(F.col("hs")).alias("high"), by.alias("by"))
    return _file(d, "concepts/glossary.md", cat("# Terms of this document\n\nTerms: ", F.col("n"), "\nClasses: ", F.col("k"), "\n\n## Weightiest\n\n", F.col("high"), "\n", F.col("by")))


def category_glossaries(facts: DataFrame, least: int = 3) -> DataFrame:
    """concepts/categories/<category>-glossary.md for each category of at least three terms."""
    line = cat("### ", title(F.col("term")), "\nFound: ", F.col("frequency"), "\nWeight: ", F.format_string("%.1f", F.col("score")), "\n",
               F.when(F.col("definition").isNotNull(), cat("Meaning: ", F.col("definition"), "\n")), F.when(F.col("context").isNotNull(), cat("Where: ", F.left("context", F.lit(100)), "...\n")))
    d = listing(facts, [-F.col("score"), F.col("term")], line, ("doc_id", "category")).where(F.col("n") >= least)
    return _file(d, cat("concepts/categories/", T.safe_filename(F.col("category")), "-glossary.md"), cat("# Terms of class ", title(F.col("category")), "\n\nTerms: ", F.col("n"), "\n\n## All of them\n\n", F.col("body")))


def internal_references(resolved: DataFrame) -> DataFrame:
    """references/internal-references.md: counts by family, then the section resolved."""
    # references are read once: one sum a document has the counts and the rows
    kinds, kind = ("concept", "figure", "page", "section", "table"), F.col("type")
    row = cat("| §", F.col("section_id"), " | §", F.col("target"), " | ", F.col("text"), " |")
    d = resolved.where(kind.isin(*kinds)).select("doc_id", "type", F.when(kind == "section", F.struct("section_id", "target", "text", row.alias("line"))).alias("row"))
    g = d.groupBy("doc_id").agg(*[F.count_if(kind == k).alias(k) for k in kinds], F.sort_array(F.collect_list("row")).alias("rows"))
    counts = F.concat_ws("\n", *[F.when(F.col(k) > 0, cat("- **", title(k), ": ", F.col(k), " resolved")) for k in kinds])
    table = F.when(F.col("section") > 0, cat("\n\n### To sections (", F.col("section"), ")\n\n| From | To | Words |\n|---|---|---|\n", F.array_join(F.transform("rows", lambda x: x["line"]), "\n")))
    return _file(g, "references/internal-references.md", cat("# References within the document\n\n## Counts\n\n", counts, table))


def external_references(refs: DataFrame) -> DataFrame:
    """references/external-references.md: the URLs with their domains and the interface paths with their methods."""
    d = refs.where(F.col("type").isin("url", "api"))
    method = F.upper(F.regexp_extract("text", r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s", 1))
    line = F.when(F.col("type") == "url", cat("| ", F.col("target"), " | ", F.parse_url("target", F.lit("AUTHORITY")), " | §", F.col("section_id"), " |")).otherwise(cat("| ", F.when(method == "", "–").otherwise(method), " | ", F.col("target"), " | §", F.col("section_id"), " |"))
    parts = listing(d, [F.col("section_id"), line], line, ("doc_id", "type")).groupBy("doc_id").agg(*[F.max(F.when(F.col("type") == t, F.col(c))).alias(f"{t}_{c}") for t in ("url", "api") for c in ("n", "body")])
    n = lambda t: F.coalesce(F.col(f"{t}_n"), F.lit(0))
    body = cat("# References to other places\n\n- All: ", n("url") + n("api"), "\n- Web addresses: ", n("url"), "\n- Interface paths: ", n("api"), "\n\n## Web addresses\n\n| Address | Host | From |\n|---|---|---|\n", F.col("url_body"),
               "\n\n## Interface paths\n\n| Call | Path | From |\n|---|---|---|\n", F.col("api_body"))
    return _file(parts, "references/external-references.md", body)


def broken_references(broken: DataFrame) -> DataFrame:
    """references/broken-references.md, for documents that have any."""
    row = cat("| ", F.col("type"), " | ", F.col("text"), " | §", F.col("section_id"), " | ", F.col("reason"), " |")
    d = listing(broken, [F.col("section_id"), row], row)
    return _file(d, "references/broken-references.md", cat("# References without a target\n\n- All: ", F.col("n"), "\n\n| Family | Words | From | Why |\n|---|---|---|---|\n", F.col("body")))


def link_mapping(links: DataFrame) -> DataFrame:
    """references/link-mapping.md: each text and its link."""
    d = listing(links, [F.col("text")], cat("Words: `", F.col("text"), "`\nLink: `", F.col("link"), "`\n"))
    return _file(d, "references/link-mapping.md", cat("# Words and their links\n\n## All (", F.col("n"), ")\n\n", F.col("body")))


def table_files(tables: DataFrame) -> DataFrame:
    """tables/table-NNN.md of tables with their Markdown."""
    no = F.format_string("%03d", F.col("table_no"))
    return _file(tables, cat("tables/table-", no, ".md"), cat("# Table ", F.col("table_no"), "\n\nSize: ", F.col("n_rows"), " rows by ", F.col("n_cols"), " columns\n\n", F.col("markdown")))


def tables_index(tables: DataFrame) -> DataFrame:
    """tables/tables-index.md with the totals."""
    line = cat("- [Table ", F.col("table_no"), "](table-", F.format_string("%03d", F.col("table_no")), ".md) - ", F.col("n_rows"), " rows by ", F.col("n_cols"), " columns")
    d = listing(tables, [F.col("table_no")], line, rows=F.sum("n_rows"), cols=F.sum("n_cols"), tokens=F.sum(T.tokens(F.col("markdown"))))
    return _file(d, "tables/tables-index.md", cat("# Tables of this document\n\nTables: ", F.col("n"), "\nIn all: ", F.col("rows"), " rows, ", F.col("cols"), " columns\nTokens: ", F.col("tokens"), "\n\n", F.col("body")))


def chunk_files(chunks: DataFrame) -> DataFrame:
    """chunked/NN-<title>[-chunk-K]-<size>.md of section chunks, with head and guidance."""
    notes = guidance(F.col("size"), F.col("section_type"), F.col("token_count"))
    head = cat("# ", F.col("title"), "\n\nPart: ", F.col("part"), " of ", F.col("parts"), "\nTier: ", F.col("size"), " (", F.col("token_count"), " tokens)\nKind: ", F.col("section_type"), "\nRank: ", F.col("priority"), "\nFits: ", T.recommend_model(F.col("token_count")),
               "\n\n---\n\n", F.when(F.size(notes) > 0, cat("## Advice\n\n", F.array_join(F.transform(notes, lambda x: F.concat(F.lit("- "), x)), "\n"), "\n\n---\n\n")), F.col("content"))
    return _file(chunks, cat("chunked/", F.format_string("%02d", F.col("section_id")), "-", T.safe_filename(F.col("title")), F.when(F.col("parts") > 1, cat("-chunk-", F.col("part"))), "-", F.col("size"), ".md"), head)


def chunk_manifest(typed: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunked/chunk-manifest.md: each section with its tokens and number of chunk files, by priority."""
    n = chunks.groupBy("doc_id", "section_id", "priority").agg(F.count(F.lit(1)).alias("k"))
    d = meet(typed.select("doc_id", "section_id", "title", "token_count"), n, ["doc_id", "section_id"])
    rows = listing(d, [-F.col("priority"), F.col("section_id")], cat("| ", F.col("section_id"), " | ", F.left("title", F.lit(30)), "... | ", F.col("token_count"), " | ", F.col("k"), " |"), chunks=F.sum("k"))
    return _file(rows, "chunked/chunk-manifest.md", cat("# Chunks of this document\n\nSections: ", F.col("n"), "\nChunks: ", F.col("chunks"), "\n\n| No. | Begins | Tokens | Files |\n|---|---|---|---|\n", F.col("body")))


def summary_files(summaries: DataFrame) -> DataFrame:
    """summaries/<type>-summary.md with front matter, for summaries that have a text."""
    kind = F.col("summary_type")
    body = cat("---\ntitle: ", title(kind), "\ntype: ", kind, "\ntoken_count: ", F.col("token_count"), "\n---\n\n", F.col("content"))
    return _file(summaries.where("content <> ''"), cat("summaries/", kind, "-summary.md"), body)


def summary_index(summaries: DataFrame) -> DataFrame:
    """summaries/README.md: the summaries of a document and what they are."""
    kind = F.col("summary_type")
    note = reduce(lambda acc, x: acc.when(kind == x[0], x[1]), list(V.SUMMARY_NOTES.items())[1:], F.when(kind == "executive", V.SUMMARY_NOTES["executive"])).otherwise("A summary")
    d = listing(summaries.where("content <> ''"), [kind], cat("- [", title(kind), "](", kind, "-summary.md) - ", note))
    return _file(d, "summaries/README.md", cat("# Summaries of this document\n\n## Which there are\n\n", F.col("body")))


def word_sections(sections: DataFrame, kind: Column, limit: int = 20_000, part: int = 7500) -> DataFrame:
    """sections/NN-<title>.md with type, level, tokens and reading time; sections of over `limit` tokens in -partNN files
    of about `part` tokens, cut before headings."""
    d, n = sections.withColumn("kind", kind), T.tokens(F.coalesce("content", F.lit("")))
    whole = d.where(n <= limit).select("doc_id", "section_id", "title", "level", "kind", F.lit(1).alias("part"), F.lit(1).alias("parts"), F.coalesce("content", F.lit("")).alias("content"))
    cut = split_sections(d.where(n > limit), "semantic", part, ["title", "level", "kind"])
    files, n = whole.unionByName(cut), T.tokens(F.col("content"))
    several = F.col("parts") > 1
    body = cat("# ", F.col("title"), F.when(several, cat(" (", F.col("part"), " of ", F.col("parts"), ")")), "\n\nKind: ", F.col("kind"), "\nDepth: ", F.col("level"), "\nTokens: ", n, "\nMinutes to read: ", F.greatest(F.lit(1), F.floor(n / 250)), "\n\n---\n\n", F.col("content"))
    path = cat("sections/", F.format_string("%02d", F.col("section_id")), "-", T.safe_filename(F.col("title")), F.when(several, cat("-part", F.format_string("%02d", F.col("part")))), ".md")
    return _file(files, path, body)


def word_navigation(sections: DataFrame) -> DataFrame:
    """structure-overview.md: an indented link and a preview of 200 signs for each section."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    preview = cat(T.strip(F.left("content", F.lit(200))), F.when(F.length("content") > 200, "..."))
    line = cat(indent, "- **[", F.col("title"), "](sections/", F.format_string("%02d", F.col("section_id")), "-", T.safe_filename(F.col("title")), ".md)**\n", indent, "  Begins: ", preview, "\n")
    d = listing(sections, [F.col("section_id")], line)
    return _file(d, "structure-overview.md", cat("# Way through the document\n\nSections: ", F.col("n"), "\n\n---\n\n## Sections in order\n\n", F.col("body")))


def image_catalog(images: DataFrame) -> DataFrame:
    """images/image-catalog.md of doc_id, alt, url rows, in the order of their links."""
    d = listing(images, [F.col("url"), F.col("alt")], cat("- Says: ", F.col("alt"), "\n- File: ", F.col("url"), "\n"))
    return _file(d, "images/image-catalog.md", cat("# Pictures\n\nPictures: ", F.col("n"), "\n\n", F.col("body")))


def let(value: Column, make) -> Column:
    """make(value), with the value made once however often it is used."""
    return F.transform(F.array(value), make)[0]


def file_category(path: Column) -> Column:
    """Category of a file by its folder, then its name."""
    name = F.substring_index(path, "/", -1)
    folder = F.when(F.contains(path, F.lit("/")) & (name != ""), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise("")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in V.FILE_CATEGORIES for x in (k, NAME[k])]), folder), F.when(name.endswith("-metadata.json") | (name == "README.md"), "metadata").otherwise("main_documents"))


CATEGORIES = sorted({*NAME.values(), "metadata", "main_documents"})


def index_body(sorted_: Column) -> Column:
    """README.md of a document's files (c, category, and p, path) in order: by category; of over ten, the first five and the last three."""
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- ["), F.substring_index(x, "/", -1), F.lit("]("), x, F.lit(")"))), "\n")

    def block(name: str, p: Column) -> Column:
        n = F.size(p)
        some = F.when(n <= 10, shown(p)).otherwise(cat(shown(F.slice(p, 1, 5)), "\n- ... (", n - 8, " others)\n", shown(F.slice(p, n - 2, F.lit(3)))))
        return F.when(n > 0, cat("### ", title(name), " (", n, " files)\n\n", some, "\n"))

    of = lambda s, name: let(F.transform(F.filter(s, lambda x: x["c"] == name), lambda x: x["p"]), lambda p: block(name, p))
    return cat("# What came of this document\n\n## Files by kind\n\n", let(sorted_, lambda s: F.concat_ws("\n", *[of(s, name) for name in CATEGORIES])))


def master_index(files: DataFrame) -> DataFrame:
    """README.md: a document's files by category."""
    own = files.select("doc_id", F.struct(file_category(F.col("path")).alias("c"), F.col("path").alias("p")).alias("p"))
    return _file(own.groupBy("doc_id").agg(F.array_sort(F.sort_array(F.collect_list("p"))).alias("p")), "README.md", index_body(F.col("p")))


def with_master_index(files: DataFrame) -> DataFrame:
    """files and the README.md of each document. Bodies stay where they are made: only the paths are read again and moved."""
    return files.unionByName(master_index(files))


def conversion_metadata(files: DataFrame, stamp: str | None = None) -> DataFrame:
    """conversion-metadata.json: numbers, sizes and tokens of a document's files by category; with the time that the
    caller gives, as nothing here reads a clock."""
    d = files.select("doc_id", file_category(F.col("path")).alias("category"), F.length("body").alias("n"), T.tokens(F.col("body")).alias("k"))
    d = d.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("characters"), F.sum("k").alias("tokens"))
    line = cat('"', F.col("category"), '": {"files": ', F.col("files"), ', "characters": ', F.col("characters"), ', "tokens": ', F.col("tokens"), "}")
    g = listing(d, [F.col("category")], line, sep=", ", total=F.sum("files"))
    return _file(g, "conversion-metadata.json", cat("{", F.when(F.lit(stamp).isNotNull(), cat('"converted": ', T.json_text(F.lit(stamp).cast("string")), ", ")), '"total_files": ', F.col("total"), ', "categories": {', F.col("body"), "}}"))


def concept_map(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """concepts/concept-map.md: of the terms of a document, categories of several terms, and of its pairs
    (doc_id, term_a, term_b, weight) the most connected terms and the strong ones."""
    pair = F.struct("weight", "term_a", "term_b")
    ends = F.array(F.struct(F.col("term_a").alias("term"), pair.alias("pair")), F.struct(F.col("term_b").alias("term"), F.when(F.lit(False), pair).alias("pair")))
    by_term = pairs.select("doc_id", F.explode(ends).alias("e")).groupBy("doc_id", "e.term").agg(F.count(F.lit(1)).alias("k"), F.collect_list("e.pair").alias("ps"))  # each pair once
    p = by_term.groupBy("doc_id").agg(F.collect_list(F.struct((-F.col("k")).alias("o"), "term")).alias("ts"), F.flatten(F.collect_list("ps")).alias("ps"))
    strong = F.transform(F.filter("ps", lambda x: x["weight"] > 2), lambda x: F.struct((-x["weight"]).alias("o"), x["term_a"].alias("a"), x["term_b"].alias("b")))
    connected = F.transform(F.slice(F.sort_array("ts"), 1, 10), lambda x: cat("- **", title(x["term"]), "**: ", -x["o"], " neighbours"))
    strong = F.transform(F.slice(F.sort_array(strong), 1, 15), lambda x: cat("- **", title(x["a"]), "** with **", title(x["b"]), "** (together ", -x["o"], " times)"))
    p = p.select("doc_id", F.array_join(connected, "\n").alias("connected"), F.array_join(strong, "\n").alias("strong"))
    g = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("category", "term"))).alias("f"))
    of = lambda c: F.transform(F.filter("f", lambda x: x["category"] == c), lambda x: x["term"])
    names = F.filter(F.array_distinct(F.transform("f", lambda x: x["category"])), lambda c: F.size(of(c)) > 1)
    block = lambda c: cat("### ", title(c), "\nTerms: ", F.size(of(c)), "\nFirst: ", F.array_join(F.slice(of(c), 1, 5), ", "), "\n")
    d = meet(g.select("doc_id", F.size("f").alias("n"), F.array_join(F.transform(names, block), "\n").alias("by")), p, ["doc_id"], "left")
    return _file(d, "concepts/concept-map.md", cat("# Terms and their company\n\nTerms: ", F.col("n"), "\n\n## Most neighbours\n\n", F.col("connected"), "\n\n## Classes\n\n", F.col("by"), "\n\n## Often together\n\n", F.col("strong")))


def field_response(fields: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, response: the first twenty fields with their contents cut to 300 signs, and how many more."""
    text = cat(F.left("content", F.lit(300)), F.when(F.length("content") > 300, "..."))
    line = cat(F.col("name"), " (", F.col("type"), "): ", text)
    g = fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "rule", line.alias("line")))).alias("f"))
    first = F.array_join(F.transform(F.slice("f", 1, most), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    return g.select("doc_id", cat("Fields (", F.size("f"), " in all)\n", first, F.when(F.size("f") > most, cat("\nand ", F.size("f") - most, " others"))).alias("response"))
