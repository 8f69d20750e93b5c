"""Line-level operators: bullets, structure, fields. Neighbouring lines come from the document's own
array of lines, so nothing shuffles until a result is summed over the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

MARKS = "l•*·‣▪▫-"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def repair_bullets(c: Column, marks: str = MARKS) -> Column:
    """A line that is one marker and the next, if not blank and under 200 signs, become one line;
    pairs go from left to right, as the pattern's matches do not overlap."""
    body = r"[ \t]*([^\s][^\n]{0,198})(?=\n|$)"
    joined = F.regexp_replace(F.concat(F.lit("\n"), c), rf"\n[ \t]*([{marks}])[ \t]*\n{body}", "\n$1 $2")
    return F.regexp_replace(F.substring(joined, 2, 2147483647), r"[ \t]+(?=\n|$)", "")


def bulleted(docs: DataFrame, indicators: list[str] | None = None) -> DataFrame:
    """doc_id, ls (lines): marker lines become `• text` where the seven lines around name a list
    or hold another line with the same marker."""
    words = indicators or V.BULLET_INDICATORS

    def converted(line: Column, i: Column) -> Column:
        start = F.greatest(i - 3, F.lit(0))
        near, s = F.slice("ls", start + 1, i + 4 - start), T.strip(line)
        same = F.size(F.filter(near, lambda x: T.strip(x).startswith(F.left(s, F.lit(2))))) - 1
        turn = ~F.contains(line, F.lit("•")) & s.rlike(r"^[l\-*·‣▪▫] ") & (T.any_of(F.lower(F.array_join(near, "")), words) | (same >= 1))
        indent = F.regexp_extract(line, r"^(\s*)", 1)
        return F.when(turn, F.concat(indent, F.lit("• "), T.strip(F.substring(F.regexp_replace(line, "^[ \t]+", ""), 3, 2147483647)))).otherwise(line)

    return docs.select("doc_id", F.split("text", "\n", -1).alias("ls")).select("doc_id", F.transform("ls", converted).alias("ls"))


def convert_bullets(docs: DataFrame, indicators: list[str] | None = None) -> DataFrame:
    """doc_id, line_no, line, with bullets as bulleted has them."""
    return bulleted(docs, indicators).select("doc_id", F.posexplode("ls").alias("line_no", "line"))


def processed(docs: DataFrame, indicators: list[str] | None = None) -> DataFrame:
    """doc_id, processed: signs fixed, bullets that stand alone joined with their lines, bullets converted."""
    fixed = docs.select("doc_id", T.process_text(F.col("text")).alias("text"))
    return bulleted(fixed, indicators).select("doc_id", F.array_join("ls", "\n").alias("processed"))


def line_flags(line: Column) -> dict[str, Column]:
    s = T.strip(line)
    any_rx = lambda c, ps: reduce(lambda a, b: a | b, [c.rlike(p) for p in ps])
    num = lambda c: F.when(c, 1).otherwise(0)
    left = F.regexp_extract(s, "^([^:]*):", 1)
    listed = any_rx(line, V.STRUCTURE_LISTS)
    return {
        "tables": num(F.regexp_count(line, F.lit(r"\|")) > 2) + num(any_rx(line, V.STRUCTURE_TABLES)),
        "bullets": num(s.startswith("•") | listed),
        "hierarchy": num(any_rx(line, V.STRUCTURE_SECTIONS)),
        "fields": num(F.contains(line, F.lit(":")) & (F.length(s) < 200) & (F.length(left) < 50) & F.regexp_replace(left, "[ .]", "").rlike("^[A-Za-z0-9]+$")),
        "filled": num(s != ""),
    }


def document_structure(docs: DataFrame) -> DataFrame:
    """doc_id, document_type, has_tables, has_lists and the five counters. A null text is an empty one."""
    names = ("tables", "bullets", "hierarchy", "fields", "filled")
    flags = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(*[line_flags(x)[k].alias(k) for k in names]))
    add = lambda a, b: F.struct(*[(a[k] + b[k]).alias(k) for k in names])
    d = docs.select("doc_id", F.aggregate(flags, F.struct(*[F.lit(0).alias(k) for k in names]), add).alias("s")).select("doc_id", "s.*")
    share = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled") * 100).otherwise(0.0)
    table = (F.col("tables") > 3) | (share("tables") > 2)
    field = (F.col("fields") > 10) | (share("fields") > 5)
    bullet = (F.col("bullets") > 5) | (share("bullets") > 3)
    kind = F.when(table | field, "structured_fields").when(bullet, "list_heavy").when(F.col("hierarchy") > 3, "structured_fields").otherwise("narrative")
    return d.select("doc_id", kind.alias("document_type"), table.alias("has_tables"), (~table & ~field & bullet).alias("has_lists"), "tables", "bullets", "hierarchy", "fields", "filled")


#: Fixed values, in natural order.
DEFINITIONS = [r"([A-Z][^:]+):\s*(.+)", r"([A-Z]\w+)\s+([a-z]+\s+\d+)", r"([A-Z0-9]{2,})\s*[-–]\s*(.+)"]


def lines_in_context(docs: DataFrame, around: int = 2) -> DataFrame:
    """doc_id, line_no, line, context: each line with the stripped lines up to `around` before and after it that aren't blank."""
    stripped = docs.select("doc_id", F.split("text", "\n", -1).alias("ls")).select("doc_id", "ls", F.transform("ls", T.strip).alias("ss"))

    def row(line: Column, i: Column) -> Column:
        start = F.greatest(i - around, F.lit(0))
        near = F.filter(F.slice("ss", start + 1, i + around + 1 - start), lambda x: x != "")
        return F.struct(line.alias("line"), F.array_join(near, " ").alias("context"))

    return stripped.select("doc_id", F.posexplode(F.transform("ls", row)).alias("line_no", "x")).select("doc_id", "line_no", "x.*")


def structured_fields(docs: DataFrame, context: bool = False) -> DataFrame:
    """doc_id, line_no, rule (0 colon, 1 definition), name, content, type: a line may give both; with the
    line's context if wanted."""
    more = ["context"] if context else []
    d = (lines_in_context(docs) if context else lines(docs)).withColumn("s", T.strip(F.col("line")))
    name, content = T.strip(F.regexp_extract("s", r"^([^:]*):", 1)), T.strip(F.regexp_extract("s", r"^[^:]*:(.*)$", 1))
    colon = F.when(F.contains("s", F.lit(":")) & (F.length("s") < 500), F.struct(F.lit(0).alias("rule"), name.alias("name"), content.alias("content")))
    hit = lambda p: F.struct(F.lit(1).alias("rule"), T.strip(F.regexp_extract("s", p, 1)).alias("name"), T.strip(F.regexp_extract("s", p, 2)).alias("content"))
    tried = lambda k: F.contains("s", F.lit(":")) & F.col("s").rlike(DEFINITIONS[0]) if k == 0 else F.col("s").rlike(DEFINITIONS[k])
    first = F.when(F.length("s") < 300, reduce(lambda acc, k: acc.when(tried(k), hit(DEFINITIONS[k])), range(1, len(DEFINITIONS)), F.when(tried(0), hit(DEFINITIONS[0]))))
    # tested where they are bound: a test beside the patterns would run them again for each part that it names
    whole = lambda f: f.isNotNull() & (f["name"] != "") & (f["content"] != "") & ((f["rule"] == 0) | (f["name"] != f["content"]))
    out = d.select("doc_id", "line_no", *more, F.explode(F.filter(F.array(colon, first), whole)).alias("f"))
    return out.select("doc_id", "line_no", "f.rule", "f.name", "f.content", T.infer_type(F.col("f.content")).alias("type"), *more)


#: Fixed values, in natural order.
CROSS_REFS = [r"(?i)(see|refer|reference)\s+([A-Z]\w+|\d+\.\d+|Table\s+\d+|Section\s+\d+)", r"(?i)([A-Z]\w+\s+\d+)", r"(?i)(Annex|Appendix)\s+([A-Z])"]


def field_details(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, rule, name, the field's metadata, cross_references and the numbered section in its context."""
    d, c = structured_fields(docs, True), F.col("content")
    two = lambda p: F.zip_with(T.find_all(c, p, 1), T.find_all(c, p, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    refs = F.concat(two(CROSS_REFS[0]), T.find_all(c, CROSS_REFS[1], 0), two(CROSS_REFS[2]))
    section = F.trim(F.nullif(F.regexp_extract("context", r"(\d+\.\d+\s+[A-Z][^:]+)", 1), F.lit("")))
    return d.select("doc_id", "line_no", "rule", "name", *field_metadata(c), F.array_join(refs, ", ").alias("cross_references"), section.alias("section"))


def field_metadata(c: Column) -> list[Column]:
    got = lambda p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    spec, span = r"(?i)([a-zA-Z]+)\s*[\(\[]?(\d+)[\)\]]?", r"(?i)(\d+)\s*[-–to]\s*(\d+)"
    return [
        F.lower(got(r"(?i)(required|optional|conditional|mandatory)", 1)).alias("requirement"), got(spec, 1).alias("format_type"), got(spec, 2).alias("format_size"),
        F.lower(got(r"(?i)(string|integer|boolean|decimal|binary)", 1)).alias("data_type"), got(span, 1).alias("min_value"), got(span, 2).alias("max_value"),
    ]


def list_items(docs: DataFrame) -> DataFrame:
    """doc_id, name (item_N), content: bullet and numbered lines."""
    rx = r"^(?:[•\-*]|\d+[.)])\s+(.+)$"
    found = F.filter(F.transform(F.split("text", "\n", -1), T.strip), lambda x: x.rlike(rx))
    return docs.select("doc_id", F.posexplode(found).alias("k", "line")).select("doc_id", F.concat(F.lit("item_"), (F.col("k") + 1).cast("string")).alias("name"), F.regexp_extract("line", rx, 1).alias("content"))


def generic_content(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, section, content: lines of over ten signs under the last short capital line."""
    d = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), T.strip)).alias("line_no", "line"))
    x = F.col("line")
    head = (x != "") & (F.length(x) < 100) & (T.is_upper(x) | x.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$")) & ~x.rlike(r"^[•\-*]")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("head", head).withColumn("above", F.last(F.when(F.col("head"), x), ignorenulls=True).over(before)).where((F.length(x) > 10) & ~F.col("head"))
    return d.select("doc_id", "line_no", F.coalesce(F.replace(F.lower("above"), F.lit(" "), F.lit("_")), F.lit("content")).alias("section"), x.alias("content"))


def table_fields(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, name, content: pipe rows, first cell and the rest."""
    d = lines(docs).where(F.regexp_count("line", F.lit(r"\|")) > 2)
    cells = F.filter(F.transform(F.split("line", r"\|", -1), T.strip), lambda x: x != "")
    d = d.select("doc_id", "line_no", cells.alias("cells")).where(F.size("cells") >= 2)
    return d.select("doc_id", "line_no", F.element_at("cells", 1).alias("name"), F.array_join(F.slice("cells", F.lit(2), F.size("cells") - 1), " | ").alias("content"))


def code_starts(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, code_type: lines that open code, by themselves or one of the next three."""
    def row(line: Column, i: Column) -> Column:
        opens = T.strip(line).startswith("```") | T.any_of(F.lower(line), V.CODE_WORDS) | F.exists(F.slice("ls", i + 2, F.lit(3)), lambda x: T.any_of(F.lower(x), V.CODE_WORDS))
        return F.when(opens, F.struct(i.alias("line_no"), T.code_type(F.concat_ws(" ", line, F.array_join(F.slice("ls", i + 2, F.lit(5)), " "))).alias("code_type")))

    d = docs.select("doc_id", F.split("text", "\n", -1).alias("ls")).select("doc_id", F.explode(F.array_compact(F.transform("ls", row))).alias("x"))
    return d.select("doc_id", "x.line_no", "x.code_type")


def code_ends(docs: DataFrame) -> DataFrame:
    """doc_id, line_no: lines that end code: those that close a fence, and a blank line before one that is not."""
    def ends(line: Column, i: Column) -> Column:
        after = F.coalesce(T.strip(F.get("ls", i + 1)), F.lit(""))
        return F.when(T.strip(line).endswith("```") | ((T.strip(line) == "") & (after != "")), i)

    return docs.select("doc_id", F.split("text", "\n", -1).alias("ls")).select("doc_id", F.explode(F.array_compact(F.transform("ls", ends))).alias("line_no"))
