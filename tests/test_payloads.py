"""JSON of tables, terms and graphs read back; references and what they point to; null texts."""

import json
import random
import re
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analysis, lines, refs, tables, terms
from quillspark.operators.sections import sections_from_markdown


def test_numbers_keep_their_digits(spark):
    getcontext().prec = 60
    cells = ["12345678901234567890", "9007199254740993", "0.12345678", "007", "5.", "-0.50", "-0", "$1,234,567.80", "1,000", "12%", "+2.5%", "-.5%", "100%", "0%", "123456789012345678901234567890.1%", ".75%", "0.000"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(T.json_number(F.col("c"))).collect()]
    for c, g in zip(cells, got):
        plain = Decimal(re.sub("[$,%+]", "", c))
        want = plain.scaleb(-2) if c.endswith("%") else plain
        assert json.loads(g, parse_float=Decimal, parse_int=Decimal) == want and str(json.loads(g, parse_float=Decimal, parse_int=Decimal)) == g, (c, g)


def odd(r, n):
    return "".join(r.choice('ab"\\\t/\x07\x1f\x7fé漢😀{}[]:,  ') for _ in range(n)).strip()


def test_tables_round_trip(spark):
    r = random.Random(3)
    docs, want = [], []
    for d in range(30):
        head = [odd(r, 5) or "h" for _ in range(3)]
        body = [[r.choice([odd(r, 6), "12345678901234567890", "0.1234567890123456789", "yes", ""]) for _ in range(3)] for _ in range(r.randint(1, 4))]
        rows = [head, ["---"] * 3, *body]
        docs.append((d, "\n".join("| " + " | ".join(x) + " |" for x in rows)))
        strip = lambda x: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x)
        want.append((d, [[strip(x) for x in row] for row in rows if row[0] != "---"]))
    got = {x["doc_id"]: x for x in tables.table_json(tables.table_cells(spark.createDataFrame(docs, "doc_id int, text string"))).collect()}
    seen = 0
    for d, (head, *body) in want:
        parsed = json.loads(got[d]["rows"], parse_float=Decimal, object_pairs_hook=list)
        assert len(parsed) == len(body)
        for pairs, cells in zip(parsed, body):
            names = [k for k, _ in pairs]
            assert len(set(names)) == 3 and [n.split(" (")[0] for n in names] == [h.split(" (")[0] for h in head]
            for (_, v), c in zip(pairs, cells):
                seen += 1
                assert v == (None if c == "" else True if c == "yes" else 12345678901234567890 if c == "12345678901234567890" else Decimal(c) if c[:2] == "0." else c)
    assert seen > 100


def test_terms_and_graphs_parse(spark):
    text = "# A\n\nThe Data\tPath is a place\tfor \\ and \"quotes\" of the kind. **Odd\t\\Term**: it holds a \"tab\"\tand more.\n\n## B\n\nThe Data\tPath and the Other\tName come again. The Other\tName is a thing too."
    s = sections_from_markdown(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    t = terms.section_terms(s)
    g = terms.glossary_json(terms.term_facts(t), terms.concept_definitions(s)).first()
    names = {x["term"] for x in json.loads(g["terms"])}
    assert any("\t" in n for n in names) and any("\\" in x["concept"] for x in json.loads(g["concepts"]))
    scores = terms.term_scores(t)
    m = terms.graph_json(scores, terms.document_pairs(terms.contained(scores, s))).first()
    nodes = json.loads(m["nodes"])
    assert any("\t" in x["label"] for x in nodes) and all(0 <= x["source"] < len(nodes) for x in json.loads(m["links"]))


DOC = """# One

See page 3, p. 7 and pp. 9-12; figure 2, fig. 4. Section 02 and section 8. As in table 5.

# Two

On page 003 and p.7 we show Figure 2 and Table 5 again, but nothing of page 11's kind."""


def test_references_point_to_something(spark):
    long = "x" * 300
    s = sections_from_markdown(spark.createDataFrame([(1, DOC), (2, f"# Long Title Here\n\nsee section 1 {long}"), (3, None)], "doc_id int, text string"))
    known = refs.resolution(s).cache()
    ok = {(r["doc_id"], r["type"], r["target"]): r for r in refs.resolved(known).collect()}
    lost = {(r["doc_id"], r["type"], r["target"]) for r in refs.broken(known).collect()}
    assert ok[1, "page", "7"]["sections_on_page"] == "1,2" and ok[1, "page", "003"]["sections_on_page"] == "1,2" and ok[1, "page", "003"]["link"] == "#page-3"
    assert ok[1, "page", "9"]["sections_on_page"] == "1" if (1, "page", "9") in ok else (1, "page", "9") in lost
    assert ok[1, "figure", "2"]["target_section"] == 2 and ok[1, "table", "5"]["target_section"] == 2
    assert ok[1, "section", "02"]["target_title"] == "Two" and ok[1, "section", "02"]["target_anchor"] == "two" and ok[1, "section", "02"]["target_preview"].startswith("On page")
    assert (1, "section", "8") in lost and (1, "figure", "4") in lost
    assert ok[2, "section", "1"]["target_preview"].endswith("...") and len(ok[2, "section", "1"]["target_preview"]) == 203
    assert not any(d == 3 for d, *_ in ok)


def test_null_texts_are_empty(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    a, b = lines.document_structure(d).orderBy("doc_id").collect()
    assert a[1:] == b[1:] and a["filled"] == 0
    a, b = analysis.document_stats(d).orderBy("doc_id").collect()
    assert a[1:] == b[1:] and a["total_words"] == 0


@pytest.mark.parametrize("pattern,group", [(r"a+", 0), (r"(\w)=(\w)?", 2), (r"(?m)^#+\s", 0), (r"x*", 0), (r"\bab(?=c)", 0)])
def test_all_matches_in_linear_time(spark, pattern, group):
    r = random.Random(1)
    texts = ["".join(r.choice("aabc=#x \n$\\") for _ in range(40)) for _ in range(200)] + ["", None, "a\x01a=b"]
    d = spark.createDataFrame([(t,) for t in texts], "c string")
    for x in d.select("c", T.find_all(F.col("c"), pattern, group).alias("a"), F.regexp_extract_all("c", F.lit(pattern), F.lit(group)).alias("b")).collect():
        assert x["a"] == x["b"], x
