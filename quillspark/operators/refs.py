"""Cross references: seven families of patterns, resolution, broken ones, link map and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .matching import meet

INTERNAL = ("section", "page", "figure", "table")
RANK = {"section": 0, "page": 1, "figure": 2, "table": 3, "concept": 4, "url": 5, "api": 6}


def _hits(content: Column, low: Column, located: bool = False, kinds: tuple = tuple(RANK), made=None, type_: str | None = None) -> Column:
    """All matches of a section's content, pattern by pattern of the families `kinds`. A pattern is tried only where one
    of its literal cues occurs; the group comes from the match, which is short. Rows have type, text, target (and position), or are
    of the type `type_` as made(kind, text, target) makes them. To be projected before it is exploded: a
    projection tests the cues in compiled code, a generator doesn't."""
    def one(kind: str, p: str, g: int, cues: list[str], first: str | None) -> Column:
        got = lambda t: F.regexp_extract(t, p, g)
        target = lambda t: F.lower(got(t)) if kind == "concept" else F.when(got(t) == "", "0").otherwise(got(t)) if kind == "table" else got(t)
        found = T.find_all(content, T.starting(p, first), 0)
        at = T.match_starts(content, T.starting(p, first)) if located else None
        row = (lambda t, i: made(kind, t, target(t))) if made else lambda t, i: F.struct(F.lit(kind).alias("type"), t.alias("text"), target(t).alias("target"), *([F.get(at, i).alias("position")] if located else []))
        own = type_ or f"struct<type: string, text: string, target: string{', position: int' if located else ''}>"
        empty = f"cast(array() as array<{own}>)"
        return F.when(T.any_of(low, cues), F.transform(found, row)).otherwise(F.expr(empty))

    return F.concat(*[one(*r, c, first) for r, c, first in zip(V.REFERENCES, V.REFERENCE_CUES, V.REFERENCE_STARTS) if r[0] in kinds])


def references(sections: DataFrame, kinds: tuple = tuple(RANK)) -> DataFrame:
    """doc_id, section_id, type, text, target: one row for each match of each pattern (patterns overlap) of the families `kinds`."""
    d = sections.select("doc_id", "section_id", "content", F.lower("content").alias("low"))
    d = d.select("doc_id", "section_id", _hits(F.col("content"), F.col("low"), kinds=kinds).alias("rs"))
    return d.select("doc_id", "section_id", F.explode_outer("rs").alias("r")).where("r is not null").select("doc_id", "section_id", "r.type", "r.text", "r.target")  # outer, else a filter on the array makes it again


def located(sections: DataFrame, around: int = 50) -> DataFrame:
    """References with position (from 0), context (`around` signs to both sides of it) and, for interface
    paths, the method."""
    d = sections.select("doc_id", "section_id", "content", F.lower("content").alias("low"))
    d = d.select("doc_id", "section_id", "content", _hits(F.col("content"), F.col("low"), True).alias("rs"))
    d = d.select("doc_id", "section_id", "content", F.explode_outer("rs").alias("r")).where("r is not null").select("doc_id", "section_id", "content", "r.*")
    start = F.greatest(F.col("position") - around, F.lit(0))
    context = T.strip(F.substring("content", start + 1, F.col("position") + around - start))
    method = F.when(F.col("type") == "api", F.nullif(F.upper(F.regexp_extract("text", r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s", 1)), F.lit("")))
    return d.select("doc_id", "section_id", "type", "text", "target", "position", context.alias("context"), method.alias("method"))


#: How mentions of pages, figures and tables are written, in the text's lower case: what a reference can point to.
MENTIONED = [("page", r"page\s+(\d+)", "page"), ("page", r"p\.\s*(\d+)", "p."), ("figure", r"figure\s+(\d+)", "figure"), ("table", r"table\s+(\d+)", "table")]
PREVIEW = 200


def _number(c: Column) -> Column:
    """A reference's number as targets are compared: without leading zeros."""
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def resolution(sections: DataFrame) -> DataFrame:
    """References with `known` (whether a section, page, figure or table reference has its target in the document; null
    for the other families) and what they point to: title, anchor and preview of a section, the sections on a
    page, the last section that names a figure or table. Sections are read once: their references, their mentions and
    they themselves as targets meet by document, family and number. A null content has none and an empty preview."""
    content, low = F.coalesce("content", F.lit("")), F.col("low")
    d = sections.select("doc_id", "section_id", "title", content.alias("content"), F.lower(content).alias("low"))
    none = F.lit(None).cast("string")
    kind_of = "struct<type: string, number: string, text: string, target: string, title: string, preview: string>"
    named = f"cast({{0}} as array<{kind_of}>)"
    row = lambda kind, number, text, target, title, preview: F.struct(kind.alias("type"), number.alias("number"), text.alias("text"), target.alias("target"), title.alias("title"), preview.alias("preview"))
    refs = _hits(F.col("content"), low, made=lambda k, text, target: row(F.lit(k), _number(target) if k in INTERNAL else target, text, target, none, none), type_=kind_of)
    mention = lambda k: lambda n: row(F.lit(k), n, none, none, none, none)
    said = [F.when(F.contains(low, F.lit(cue)), F.transform(F.array_distinct(F.transform(T.find_all(low, p, 1), _number)), mention(k))).otherwise(F.expr(named.format("array()"))) for k, p, cue in MENTIONED]
    preview = F.when(F.length("content") > PREVIEW, F.concat(F.left("content", F.lit(PREVIEW)), F.lit("..."))).otherwise(F.col("content"))
    itself = F.array(row(F.lit(INTERNAL[0]), F.col("section_id").cast("string"), none, none, F.coalesce("title", F.lit("")), preview))
    d = d.select("doc_id", "section_id", F.concat(refs, *said, itself).alias("xs"))
    x = d.select("doc_id", "section_id", F.explode_outer("xs").alias("x")).select("doc_id", "section_id", "x.*")  # outer, else a filter on the array makes it again
    is_ref = F.col("text").isNotNull()
    g = x.groupBy("doc_id", "type", "number").agg(
        F.collect_list(F.when(is_ref, F.struct("section_id", "text", "target"))).alias("refs"), F.sort_array(F.collect_set(F.when(~is_ref, F.col("section_id")))).alias("at"),
        F.max(F.when(~is_ref, F.struct("section_id", "title", "preview"))).alias("last"),
    )
    kind, is_section = F.col("type"), F.col("type") == INTERNAL[0]
    known = F.when(kind.isin(*INTERNAL), F.size("at") > 0)
    told = {
        "known": known, "target_title": F.when(is_section, F.col("last.title")), "target_anchor": F.when(is_section, T.anchor(F.col("last.title"))), "target_preview": F.when(is_section, F.col("last.preview")),
        "sections_on_page": F.when(known & (kind == "page"), F.array_join(F.transform("at", lambda i: i.cast("string")), ",")), "target_section": F.when(kind.isin("figure", "table"), F.col("last.section_id")),
    }
    return g.select("doc_id", "type", *[c.alias(k) for k, c in told.items()], F.explode("refs").alias("r")).select("doc_id", "r.section_id", "type", "r.text", "r.target", *told)


def url_facts(refs: DataFrame) -> DataFrame:
    return refs.where("type = 'url'").select("doc_id", "section_id", F.col("target").alias("url"), F.parse_url("target", F.lit("AUTHORITY")).alias("domain"))


def external(refs: DataFrame) -> DataFrame:
    """doc_id, section_id, type, text, target, domain (of a URL), documentation (the anchor of an /api/ path)."""
    is_url = F.col("type") == "url"
    docs = F.when(~is_url & F.contains("target", F.lit("/api/")), F.concat(F.lit("#api-docs"), F.replace("target", F.lit("/"), F.lit("-"))))
    return refs.where("type in ('url', 'api')").select("doc_id", "section_id", "type", "text", "target", F.when(is_url, F.parse_url("target", F.lit("AUTHORITY"))).alias("domain"), docs.alias("documentation"))


def resolved(known: DataFrame) -> DataFrame:
    """Of a resolution, the references that have their target, with their link and what they point to."""
    return known.where("known").drop("known").withColumn("link", F.concat(F.lit("#"), "type", F.lit("-"), _number(F.col("target"))))


def broken(known: DataFrame) -> DataFrame:
    """Of a resolution, the references of the four internal families without a target, with the reason."""
    miss = known.where("not known")
    return miss.select("doc_id", "section_id", "type", "text", "target", F.concat(F.initcap("type"), F.lit(" "), "target", F.lit(" not found")).alias("reason"))


def concept_links(refs: DataFrame, scores: DataFrame) -> DataFrame:
    known = scores.select("doc_id", F.col("term").alias("target"), "category")
    return meet(refs.where("type = 'concept'"), known, ["doc_id", "target"]).select("doc_id", "section_id", "text", "target", "category")


def link_map(found: DataFrame) -> DataFrame:
    """doc_id, text, link: for each surface text the last family's last link."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("type"))
    link = F.when(F.col("type") == "url", F.concat(F.lit("["), "text", F.lit("]("), "target", F.lit(")"))).otherwise(F.concat(F.lit("["), "text", F.lit("](#"), "type", F.lit("-"), "target", F.lit(")")))
    return found.groupBy("doc_id", "text").agg(F.max_by(link, F.struct(rank, "section_id", "target")).alias("link"))


def statistics(known: DataFrame) -> DataFrame:
    """doc_id, internal, external, broken of a resolution."""
    kind = F.col("type")
    return known.groupBy("doc_id").agg(F.count_if(kind.isin(*INTERNAL, "concept")).alias("internal"), F.count_if(kind.isin("url", "api")).alias("external"), F.count_if(~F.coalesce("known", F.lit(True))).alias("broken"))
