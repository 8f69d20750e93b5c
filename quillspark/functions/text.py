"""Scalar text functions: Column in, Column out, whole on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))  # the signs of \s; a pattern would try each blank within the text


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def says(c: Column, words: list[str]) -> Column:
    """any_of in whatever case, for use in a lambda: the text is lowered once and not for each word."""
    return F.exists(F.array(F.lower(c)), lambda low: any_of(low, words))


def first_class(c: Column, classes: list[tuple[str, list[str]]], otherwise: Column | None = None) -> Column:
    """Name of the first class with a word in c."""
    out = reduce(lambda acc, x: acc.when(any_of(c, x[1]), x[0]), classes[1:], F.when(any_of(c, classes[0][1]), classes[0][0]))
    return out if otherwise is None else out.otherwise(otherwise)


#: Marks the ends of matches within a text; one that holds it already is matched in the slower way.
MARK = "\x01"


def starting(pattern: str, first: str | None) -> str:
    """pattern, tried only where one of the signs `first` stands, with which all of its matches begin: without, optional words and
    branches are tried at every sign of a text."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?=[{first}]){pattern[len(flags):]}" if first else pattern


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches, or a group of them. Matches are marked in one replacement and cut out, in time in proportion to the
    text; regexp_extract_all copies the text for each match."""
    marked = F.regexp_replace(c, pattern, f"{MARK}${group}{MARK}")
    return F.when(F.contains(c, F.lit(MARK)), F.regexp_extract_all(c, F.lit(pattern), F.lit(group))).otherwise(F.filter(F.split(marked, MARK, -1), lambda x, i: i % 2 == 1))


def match_starts(c: Column, pattern: str) -> Column:
    """Places, from 0, where the matches of a pattern start: a running sum of the pieces between them and the matches."""
    hits, pieces = find_all(c, pattern), F.split(c, pattern, -1)
    none = F.expr("cast(named_struct('end', 0, 'at', array()) as struct<end: int, at: array<int>>)")
    step = lambda a, x: F.struct((a["end"] + F.length(x["p"]) + F.length(x["h"])).alias("end"), F.array_append(a["at"], a["end"] + F.length(x["p"])).alias("at"))
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(both, none, step)["at"]


def count_literal(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)


def tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def fix_chars(c: Column) -> Column:
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("–", "-"), ("—", "--"), (" ", " "), ("​", ""), ("﻿", ""), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[​-‍﻿]", "")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip(c)


def process_text(c: Column) -> Column:
    """Extraction's clean-up as one step: signs mended, split bullets joined, blanks at line ends gone."""
    from ..operators.lines import repair_bullets

    return repair_bullets(fix_chars(c))


def strip_markdown(c: Column) -> Column:
    for p, r in ((r"#{1,6}\s+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"`(.*?)`", "$1"), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        c = F.regexp_replace(c, p, r)
    return strip(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+\s+", -1), strip), lambda s: s != "")


def keywords(c: Column, least: int = 3) -> Column:
    words = F.transform(find_all(c, rf"\b[A-Za-z]{{{least},}}\b"), F.lower)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, V.STOP_WORDS))))


def rag_keywords(c: Column, most: int = 20) -> Column:
    tech = F.transform(find_all(c, rf"(?i)\b(?:{'|'.join(V.TECH_WORDS)})\b"), F.upper)
    phrases = F.filter(find_all(c, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), lambda p: F.length(p) > 3)
    return F.slice(F.array_sort(F.array_union(tech, phrases)), 1, most)


URL = r'https?://[^\s<>"{}|\\^`\[\]]+|www\.[^\s<>"{}|\\^`\[\]]+'
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def urls(c: Column) -> Column:
    return find_all(c, URL)


def emails(c: Column) -> Column:
    return find_all(c, EMAIL)


def images(c: Column) -> Column:
    p = r"!\[([^\]]*)\]\(([^)]+)\)"
    return F.arrays_zip(find_all(c, p, 1).alias("alt"), find_all(c, p, 2).alias("url"))


def has_toc(c: Column) -> Column:
    return any_of(F.lower(F.left(c, F.lit(1000))), V.TOC_WORDS)


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_header(line: Column) -> Column:
    s = strip(line)
    rules = s.startswith("#") | (is_upper(s) & (F.length(s) < 60)) | s.rlike(r"^\d+\.?\s+[A-Z]") | s.rlike(r"^(?:Chapter|Section|Part)\s+\d+") | s.rlike(r"^[A-Z][^.!?]*$") | s.rlike(r"^\d+\.\d+\s+[A-Z]")
    return (s != "") & rules


def header_level(line: Column) -> Column:
    s = strip(line)
    by_length = F.when(F.length(s) < 30, 2).when(F.length(s) < 50, 3).otherwise(4)
    return F.when(s.startswith("#"), F.least(F.lit(6), F.regexp_count(s, F.lit("#")))).when(s.rlike("^Chapter"), 1).when(s.rlike("^Section"), 2).when(s.rlike(r"^\d+\.\d+"), 3).when(s.rlike(r"^\d+\."), 2).otherwise(by_length).cast("int")


def is_table_row(line: Column) -> Column:
    s = strip(line)
    return (s != "") & ((F.regexp_count(s, F.lit(r"\|")) >= 2) | (F.regexp_count(s, F.lit("\t")) >= 2))


def format_table_row(line: Column) -> Column:
    s = strip(line)
    joined = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    return F.when(s.startswith("|") & s.endswith("|"), s).when(F.contains(s, F.lit("\t")), joined(F.split(s, "\t", -1))).when(F.contains(s, F.lit("  ")), joined(F.split(s, r"\s{2,}", -1))).otherwise(F.concat(F.lit("| "), s, F.lit(" |")))


def code_type(c: Column) -> Column:
    t = F.lower(c)
    # fixed values, in natural order
    rules = [("python", ["python", "def ", "import ", "from "]), ("javascript", ["javascript", "js", "function", "var ", "const ", "let "]), ("java", ["java", "public class", "private class"]), ("cpp", ["c++", "cpp", "#include", "using namespace"])]
    json = F.contains(t, F.lit("json")) | (F.contains(t, F.lit("{")) & F.contains(t, F.lit('"')))
    return F.coalesce(first_class(t, rules), F.when(json, "json"), F.when(any_of(t, ["sql", "select ", "from ", "where "]), "sql"), F.lit("text"))


def safe_filename(c: Column, most: int = 100) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"(?U)[^\w\s-]", ""), r"[-\s]+", "-")
    cut = F.left(s, F.lit(most))
    cut = F.when(F.contains(cut, F.lit("-")), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)
    return F.regexp_replace(F.when(F.length(s) > most, cut).otherwise(s), "^-+|-+$", "")


def sanitize_folder(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?i)\.pdf$", "")
    for p, r in ((r'[\\/:*?"<>|]', "_"), (r"[$()\[\]{}&#@!%^=+;'`~]", ""), (r"(\d)\.(\d)", "$1_$2"), (r"\.", "_"), (r"\s+", "_"), ("_-|-_", "_"), ("_+", "_"), ("-+", "-"), ("^[._-]+|[._-]+$", ""), (r"[^\x00-\x7F]", "")):
        s = F.regexp_replace(s, p, r)
    return F.lower(F.left(F.when(s == "", "converted_pdf").otherwise(s), F.lit(200)))


def anchor(c: Column) -> Column:
    return safe_filename(F.replace(F.lower(c), F.lit(" "), F.lit("-")))


def recommend_model(n: Column) -> Column:
    return reduce(lambda acc, b: acc.when(n <= b[0], b[1]), V.MODEL_BANDS[1:], F.when(n <= V.MODEL_BANDS[0][0], V.MODEL_BANDS[0][1])).otherwise(V.MODEL_REST)


def cost(n: Column, model: str = "gpt-3.5-turbo") -> Column:
    return n / 1000 * F.lit(V.PRICES.get(model, 0.002))


def trim_to_tokens(c: Column, target: int | Column) -> Column:
    target = F.lit(target) if isinstance(target, int) else target
    n = F.floor(target.cast("double") * (F.length(c) / tokens(c)) * F.lit(0.9)).cast("int")
    cut = F.left(c, n)
    dot = F.length(cut) - F.locate(".", F.reverse(cut))  # place of the last full stop, from 0
    cut = F.when(F.contains(cut, F.lit(".")) & (dot > n * 0.8), F.left(cut, dot + 1)).otherwise(cut)
    return F.when(tokens(c) <= target, c).otherwise(F.when(F.length(cut) < F.length(c), F.concat(cut, F.lit("..."))).otherwise(cut))


def context(c: Column, needle: Column, around: int = 50, low: Column | None = None) -> Column:
    """The text around the first occurrence, whatever its case; blank runs collapsed. low: c in lower case, where it is known."""
    pos = F.call_function("instr", F.lower(c) if low is None else low, F.lower(needle))
    start = F.greatest(F.lit(1), pos - around)
    end = F.least(F.length(c), pos + F.length(needle) - 1 + around)
    return F.when(pos > 0, F.regexp_replace(strip(F.substring(c, start, end - start + 1)), r"\s+", " ")).otherwise("")


def infer_type(c: Column) -> Column:
    return (
        F.when(strip(c).rlike(r"^\d+$"), "integer").when(strip(c).rlike(r"^\d*\.\d+$"), "float").when(any_of(F.lower(c), ["true", "false", "yes", "no"]), "boolean").when(c.rlike(r"\d{2,4}[-/]\d{1,2}[-/]\d{1,2}"), "date")
        .when(c.rlike(EMAIL), "email").when(c.startswith("http://") | c.startswith("https://") | c.startswith("www."), "url").otherwise("string")
    )


def quality(c: Column) -> Column:
    """0.5 with seven rules added in their order, between 0 and 1."""
    s, one = strip(c), lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = F.lit(0.5) + one(F.length(c) > 100, 0.1) + one(s.rlike(r"[.!?]$"), 0.1) + one(s.rlike("^[A-Z]"), 0.1) + one(F.regexp_count(c, F.lit(r"\.")) > 1, 0.1) + one(c.rlike(r"\b(?:def|class|function|import|return)\b"), 0.1)
    score = score - one(F.length(c) < 50, 0.2) - one(F.regexp_count(c, F.lit("\n")) / F.greatest(F.length(c), F.lit(1)) > 0.3, 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def cell_kind(c: Column) -> Column:
    s, low = strip(c), F.lower(strip(c))
    return (
        F.when(c.isNull() | (s == ""), "null").when(low.isin(*V.TRUE_CELLS, *V.FALSE_CELLS), "bool").when(s.rlike(r"^\d+$"), "int").when(s.rlike(r"^-?\d+\.?\d*$"), "float")
        .when(s.rlike(r"^\$?[\d,]+\.?\d*$") & s.rlike(r"\d"), "float").when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)%$"), "float").otherwise("str")
    )


def cell_number(c: Column) -> Column:
    s = strip(c)
    percent = s.endswith("%")
    n = F.regexp_replace(s, "[$,%]", "").cast("double")
    return F.when(cell_kind(c).isin("int", "float"), F.when(percent, n / 100).otherwise(n))


def json_text(c: Column) -> Column:
    """A string as JSON; null as null."""
    j = F.to_json(F.struct(c.alias("v")))  # {"v":...}
    return F.when(c.isNull(), "null").otherwise(F.substring(j, F.lit(6), F.length(j) - 6))


def json_number(c: Column) -> Column:
    """A numeric cell as a JSON number with all of its digits: without signs of currency and thousands, percentages as shares."""
    s = F.regexp_replace(strip(c), "[$,]", "")
    whole, part = F.regexp_extract(s, r"^[+-]?(\d*)", 1), F.regexp_extract(s, r"\.(\d*)", 1)
    padded, percent = F.concat(F.lit("00"), whole), s.endswith("%")
    part = F.regexp_replace(F.when(percent, F.concat(F.right(padded, F.lit(2)), part)).otherwise(part), "0+$", "")
    whole = F.regexp_replace(F.when(percent, F.left(padded, F.length(padded) - 2)).otherwise(padded), r"^0+(?=\d)", "")
    value = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.concat(F.when(s.startswith("-") & value.rlike("[1-9]"), "-").otherwise(""), value)


def format_cell(c: Column) -> Column:
    kind, n, s = cell_kind(c), json_number(c), strip(c)
    shown = F.when(F.contains(n, F.lit(".")), F.format_string("%.2f", cell_number(c))).otherwise(n)
    return F.when(kind == "null", "").when(kind == "bool", F.when(F.lower(s).isin(*V.TRUE_CELLS), "Yes").otherwise("No")).when(kind.isin("int", "float"), shown).otherwise(s)
