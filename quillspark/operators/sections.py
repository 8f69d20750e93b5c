"""Documents to sections, pages and names. All row-local: arrays within a document, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .matching import found_in, meet


def sections_from_markdown(docs: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id, section_id, title, content, level. Text before the first header opens Introduction;
    compat gives that section twice where a header follows, under one number."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,6}[ \t]+\S)", -1)
    # split in a step of its own: what stands beside a generator is made for each of its rows
    d = docs.select("doc_id", parts.alias("parts")).select("doc_id", "parts", (T.strip(F.element_at("parts", 1)) != "").alias("opens"))
    d = d.select("doc_id", "opens", F.posexplode_outer("parts").alias("at", "part"))  # outer, else a filter on the array makes it again; null texts go below
    head = r"^#{1,6}[ \t]+([^\n]+)"
    d = d.withColumn("body", T.strip(F.when(F.col("at") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))))
    d = d.where((F.col("at") > 0) | F.col("opens"))
    out = d.select(
        "doc_id", (F.col("at") + F.when(F.col("opens"), 1).otherwise(0)).cast("int").alias("section_id"),
        F.when(F.col("at") == 0, "Introduction").otherwise(T.strip(F.regexp_extract("part", head, 1))).alias("title"), F.col("body").alias("content"),
        F.when(F.col("at") == 0, 1).otherwise(F.length(F.regexp_extract("part", r"^(#{1,6})", 1))).cast("int").alias("level"),
    )
    return out.unionByName(out.where("title = 'Introduction' AND section_id = 1")) if compat else out


def sections_from_headers(docs: DataFrame) -> DataFrame:
    """doc_id, section_id, title, n_lines, content: runs of lines opened by header-like lines."""
    lines = F.split("text", "\n", -1)
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), T.strip(x).alias("line"), T.is_header(x).alias("head"))), lambda x: x["head"])
    d = docs.select("doc_id", lines.alias("lines"), F.size(lines).alias("n"), numbered.alias("heads"))
    upto = lambda k: F.coalesce(F.get("heads", k + 1)["i"], F.col("n"))
    own = F.transform("heads", lambda h, k: F.struct((k + 1).cast("int").alias("section_id"), h["line"].alias("title"), (upto(k) - h["i"] - 1).cast("int").alias("n_lines"), T.strip(F.array_join(F.slice("lines", h["i"] + 2, upto(k) - h["i"] - 1), "\n")).alias("content")))
    return d.select("doc_id", F.explode(own).alias("s")).select("doc_id", "s.*")


def pages_fixed(docs: DataFrame, size: int = 3000) -> DataFrame:
    """doc_id, page_num, page_text: slices of `size` characters; an empty text has none."""
    d = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))).alias("at"))
    return d.select("doc_id", (F.floor(F.col("at") / size) + 1).cast("int").alias("page_num"), F.expr(f"substring(text, at + 1, {size})").alias("page_text"))


def sections_from_pages(docs: DataFrame, size: int = 3000, pages: int = 3) -> DataFrame:
    """doc_id, section_id, first_page, last_page, n_chars: groups of pages."""
    step = size * pages
    d = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("at"))
    size_ = F.least(F.lit(step), F.col("n") - F.col("at"))
    first = F.floor(F.col("at") / size) + 1
    return d.select("doc_id", (F.floor(F.col("at") / step) + 1).cast("int").alias("section_id"), first.cast("int").alias("first_page"), (first + F.ceil(size_ / size) - 1).cast("int").alias("last_page"), size_.cast("int").alias("n_chars"))


def flatten_outline(outline: DataFrame) -> DataFrame:
    """doc_id, ord, title, level of an outline whose `nodes` (title, kids (title, kids ...)) nest as deep as
    their type says; a level whose type has no array of kids is the last."""
    def flat(nodes, kind, level: int):
        node = lambda x: F.array(F.struct(x["title"].alias("title"), F.lit(level).alias("level")))
        below = next((f.dataType for f in kind.elementType.fields if f.name == "kids" and f.dataType.typeName() == "array"), None)
        if below is None:
            return F.flatten(F.transform(nodes, node))
        none = F.expr("cast(array() as array<struct<title: string, level: int>>)")
        return F.flatten(F.transform(nodes, lambda x: F.concat(node(x), F.coalesce(flat(x["kids"], below, level + 1), none))))

    all_ = flat(F.col("nodes"), outline.schema["nodes"].dataType, 1)
    return outline.select("doc_id", F.posexplode(all_).alias("ord", "n")).select("doc_id", "ord", "n.title", "n.level")


def sections_from_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, section_id, title, content, level, page_num from a flat outline (doc_id, ord, title, level,
    page_num) and pages (doc_id, page_num, page_text): each entry's content is its page's text, '' without
    one. No title is Untitled Section, no level 0; of pages with one number the least text counts."""
    first = pages.where("page_num <> 0").groupBy("doc_id", "page_num").agg(F.min("page_text").alias("page_text"))
    return outline.join(first, ["doc_id", "page_num"], "left").select(
        "doc_id", (F.col("ord") + 1).cast("int").alias("section_id"), F.coalesce("title", F.lit("Untitled Section")).alias("title"),
        F.coalesce("page_text", F.lit("")).alias("content"), F.coalesce("level", F.lit(0)).cast("int").alias("level"), "page_num",
    )


def choose_sections(docs: DataFrame, outline: DataFrame | None = None, pages: DataFrame | None = None, size: int = 3000, group: int = 3) -> DataFrame:
    """doc_id, section_id, title, content, level: by a document's outline if it has one, else by its headers;
    where that gives fewer than two sections, by groups of pages. outline and pages as sections_from_outline takes them."""
    keep = ["doc_id", "section_id", "title", "content", "level"]
    found = sections_from_markdown(docs).select(*keep)
    if outline is not None:
        listed = outline.select("doc_id").distinct()
        found = found.join(listed, "doc_id", "left_anti").unionByName(sections_from_outline(outline, pages).select(*keep))
    several = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    step = size * group
    rest = docs.where(F.length("text") > 0).join(several, "doc_id", "left_anti").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("at"))
    first, n = F.floor(F.col("at") / size) + 1, F.ceil(F.least(F.lit(step), F.length("text") - F.col("at")) / size)
    place = F.when(n == 1, F.concat(F.lit(" (Page "), first.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" (Pages "), first.cast("string"), F.lit("-"), (first + n - 1).cast("string"), F.lit(")")))
    number = (F.floor(F.col("at") / step) + 1).cast("int")
    paged = rest.select("doc_id", number.alias("section_id"), F.concat(F.lit("Section "), number.cast("string"), place).alias("title"), F.expr(f"substring(text, at + 1, {step})").alias("content"), F.lit(1).alias("level"))
    return found.join(several, "doc_id", "left_semi").unionByName(paged)


def classify(title, content):
    t, c = F.lower(title), F.lower(content)
    by_title = T.first_class(t, V.SECTION_TITLES)
    return F.coalesce(by_title, F.when(T.any_of(c, V.SECTION_API_CONTENT), "api_endpoints").when(F.regexp_count(c, F.lit("```")) >= 2, "code_examples").when(F.regexp_count(c, F.lit(r"\|")) > 5, "data_formats"), F.lit("content"))


def with_types(sections: DataFrame) -> DataFrame:
    return sections.withColumn("section_type", classify(F.col("title"), F.col("content"))).withColumn("token_count", T.tokens(F.col("content")))


def file_name(title, section_type, section_id):
    base = reduce(lambda acc, x: acc.when(section_type == x[0], x[1]), list(V.FILE_NAMES.items())[1:], F.when(section_type == "introduction", V.FILE_NAMES["introduction"]))
    return F.concat(F.format_string("%02d", section_id), F.lit("-"), base.otherwise(T.safe_filename(title)), F.lit(".md"))


def word_section_type(title):
    return T.first_class(F.lower(title), V.WORD_SECTION_TITLES, F.lit("content"))


def related_by_type(typed: DataFrame) -> DataFrame:
    """doc_id, section_id, related_id: sections whose type follows by the fixed relation. The relation
    (18 rows) joins first, so that the self-join is on document and type."""
    spark = typed.sparkSession
    rel = spark.createDataFrame([(a, b) for a, bs in V.RELATED.items() for b in bs], "section_type string, other string")
    a = typed.select("doc_id", "section_id", "section_type").join(F.broadcast(rel), "section_type")
    b = typed.select("doc_id", F.col("section_id").alias("related_id"), F.col("section_type").alias("other"))
    return a.join(b, ["doc_id", "other"]).where("section_id <> related_id").select("doc_id", "section_id", "related_id")


def related_by_mention(typed: DataFrame) -> DataFrame:
    """doc_id, section_id, related_id: one's title occurs in the other's content. The pairs found, which are
    narrow, count both ways."""
    texts = typed.select("doc_id", "section_id", F.lower("content").alias("text"))
    titles = typed.select("doc_id", F.col("section_id").alias("related_id"), F.lower("title").alias("needle"))
    met = meet(found_in(texts, titles, "section_id"), titles, ["doc_id", "needle"]).where("section_id <> related_id").select("doc_id", "section_id", "related_id")
    return met.unionByName(met.select("doc_id", F.col("related_id").alias("section_id"), F.col("section_id").alias("related_id"))).distinct()


def purpose(section_type):
    return reduce(lambda acc, x: acc.when(section_type == x[0], x[1]), list(V.PURPOSES.items())[1:], F.when(section_type == "introduction", V.PURPOSES["introduction"])).otherwise(V.PURPOSE_REST)


def document_map(typed: DataFrame) -> DataFrame:
    """doc_id, map: one bullet for each section, in order, with what it is for."""
    line = F.concat(F.lit("- ["), "title", F.lit("](sections/"), file_name(F.col("title"), F.col("section_type"), F.col("section_id")), F.lit(") - "), purpose(F.col("section_type")), F.lit(", "), F.col("token_count").cast("string"), F.lit(" tokens"))
    rows = typed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_id", line.alias("line")))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("map"))


def section_files(typed: DataFrame, limit: int = 32_000, target: int = 28_000) -> DataFrame:
    """doc_id, path, body: what write_section_files writes; a file of over `limit` tokens in -partNN files."""
    path = F.concat(F.lit("sections/"), file_name(F.col("title"), F.col("section_type"), F.col("section_id")))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.lit("> "), "section_type", F.lit(", "), F.col("token_count").cast("string"), F.lit(" tokens\n\n"))
    # made once, by a generator, as a filter on them would make them again for its test; what is large carries its path
    made = F.struct(path.alias("path"), head.alias("head"), (T.tokens(F.concat(head, "content")) > limit).alias("large"))
    d = typed.select("doc_id", "section_id", "content", F.explode(F.array(made)).alias("x")).select("doc_id", "section_id", "content", "x.*")
    whole = d.where("not large").select("doc_id", "path", F.concat("head", "content", F.lit("\n")).alias("body"))
    # the head and a rule, so that every part repeats it
    big = d.where("large").select("doc_id", "section_id", "path", F.concat("head", F.lit("---\n"), "content", F.lit("\n")).alias("content"))
    part = F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("-part"), F.format_string("%02d", "part"), F.lit(".md"))
    return whole.unionByName(split_large(big, limit, target, keep=("path",)).select("doc_id", part.alias("path"), F.col("content").alias("body")))


def readme(typed: DataFrame) -> DataFrame:
    """doc_id, path, body of README.md: what the document is about, and its map as the way in."""
    d = meet(document_map(typed), consolidated(typed), ["doc_id"])
    return d.select("doc_id", F.lit("README.md").alias("path"), F.concat(F.lit("# Map of the document\n\n"), "summary", F.lit("\n\n## Sections\n\n"), "map", F.lit("\n")).alias("body"))


def consolidated(typed: DataFrame) -> DataFrame:
    """doc_id, n_sections, n_tokens, kinds (sorted section types), summary (a sentence on what it is, one on what it covers)."""
    g = typed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("token_count").alias("n_tokens"), F.sort_array(F.collect_set("section_type")).alias("k"))
    has = lambda kind: F.array_contains("k", kind)
    about = reduce(lambda acc, x: acc.when(has(x[0]), x[1]), V.ABOUT[1:], F.when(has(V.ABOUT[0][0]), V.ABOUT[0][1])).otherwise(F.concat(F.lit("A technical text in "), F.col("n_sections").cast("string"), F.lit(" sections.")))
    areas = F.array_compact(F.array(*[F.when(has(kind), name) for kind, name in V.AREAS]))
    summary = F.concat_ws(" ", about, F.when(F.size(areas) > 0, F.concat(F.lit("It covers "), F.array_join(areas, ", "), F.lit("."))))
    return g.select("doc_id", "n_sections", "n_tokens", F.array_join("k", ",").alias("kinds"), summary.alias("summary"))


def split_large(sections: DataFrame, limit: int = 32_000, target: int = 28_000, header_tokens: int = 50, keep: tuple = ()) -> DataFrame:
    """doc_id, section_id, part, content and the columns `keep`: sections of over `limit` tokens, line by line in parts of at most
    about `target` tokens; the lines above the first rule (---) head every part, with its number. A text
    without a rule has no head. The others are as they are. One Arrow pass, as the cut is sequential."""
    kind = sections.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        count = lambda s: len(s) // 4

        def parts(text):
            if text is None or count(text) <= limit:
                return [text]
            lines = text.split("\n")
            rule = next((i for i, x in enumerate(lines) if x.startswith("---")), -1)
            head, out, held, n = lines[: max(rule, 0)], [], [], 0
            extra = sum(map(count, head)) + header_tokens
            close = lambda: out.append("\n".join([*head, f"\n(part {len(out) + 1})\n---\n", *held]))
            for line in lines[rule + 1 :]:
                if held and n + count(line) > target:
                    close()
                    held, n = [], extra
                held.append(line)
                n += count(line)
            if held:
                close()
            return out

        for b in batches:
            cut = [parts(c) for c in b.column(2).to_pylist()]
            at = pa.array([i for i, p in enumerate(cut) for _ in p], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k + 1 for p in cut for k in range(len(p))], pa.int32()), pa.array([x for p in cut for x in p], pa.string()), *[b.column(3 + k).take(at) for k in range(len(keep))]], names=["doc_id", "section_id", "part", "content", *keep])

    kept = "".join(f", `{c}` {sections.schema[c].dataType.simpleString()}" for c in keep)
    return sections.select("doc_id", F.col("section_id").cast("int").alias("section_id"), "content", *keep).mapInArrow(run, f"doc_id {kind}, section_id int, part int, content string{kept}")
