"""Scalars and row-local operators on small inputs, awkward ones included."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vocab as V
from quillspark.operators import chunks, lines, refs, sections, summaries, tables, terms


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).collect()[0]["r"]


#: Names of our own, each for a rule of the clean-up: suffix, blanks, forbidden and dropped signs, version
#: dots, joined separators, edges, what isn't ASCII, nothing left, length.
FOLDERS = [
    ("Yearly.PDF", "yearly"), ("two  words\there.pdf", "two_words_here"), ("kept-hyphen.pdf", "kept-hyphen"), ("a/b\\c:d*e?f\"g<h>i|j", "a_b_c_d_e_f_g_h_i_j"),
    ("sum (net) [EUR] 100%.pdf", "sum_net_eur_100"), ("plan 2.5.1 final.pdf", "plan_2_5_1_final"), ("a.b.c.pdf", "a_b_c"), ("x _-_ y.pdf", "x_y"), ("--edge--.pdf", "edge"), ("naïve Übung.pdf", "nave_bung"),
    ("漢字.pdf", "converted_pdf"), (".PDF", "converted_pdf"), ("", "converted_pdf"), ("-._", "converted_pdf"), ("\t \n", "converted_pdf"), ("..start.pdf", "start"), ("NUL.pdf", "nul"), ("z" * 260 + ".pdf", "z" * 200),
]


def test_folder_names(spark):
    got = spark.createDataFrame(FOLDERS, "c string, want string").select("c", "want", T.sanitize_folder(F.col("c")).alias("r"), T.sanitize_folder(T.sanitize_folder(F.col("c"))).alias("again")).collect()
    assert [(r["c"], r["r"]) for r in got] == FOLDERS and all(r["again"] == r["r"] for r in got)


@pytest.mark.parametrize("value,kind,number,shown", [
    (None, "null", None, ""), ("", "null", None, ""), (" ", "null", None, ""), ("1", "bool", None, "Yes"), ("0", "bool", None, "No"), ("Y", "bool", None, "Yes"), ("7", "int", 7.0, "7"), ("-5", "float", -5.0, "-5"),
    ("2.5", "float", 2.5, "2.50"), ("$1,200.50", "float", 1200.5, "1200.50"), ("12%", "float", 0.12, "0.12"), ("2024-01-02", "str", None, "2024-01-02"), ("abc", "str", None, "abc"), ("$", "str", None, "$"),
])
def test_cells(spark, value, kind, number, shown):
    r = spark.createDataFrame([(value,)], "c string").select(T.cell_kind(F.col("c")), T.cell_number(F.col("c")), T.format_cell(F.col("c"))).collect()[0]
    assert tuple(r) == (kind, number, shown)


@pytest.mark.parametrize("value,want", [("42", "integer"), ("4.2", "float"), ("notification", "boolean"), ("2024-01-31", "date"), ("a@b.com", "email"), ("https://x.y", "url"), ("plain", "string")])
def test_field_types(spark, value, want):
    assert one(spark, T.infer_type, value) == want


def test_text_functions(spark):
    assert one(spark, T.clean_text, "  a\n\tb​ ﬁn “q” ") == 'a b fin "q"'
    assert one(spark, T.sentences, "A b. C! \n D? e.") == ["A b", "C", "D? e."] or one(spark, T.sentences, "A b. C! \n D? e.") == ["A b", "C", "D", "e."]
    assert one(spark, T.keywords, "The cat and THE Dog to dog") == ["cat", "dog"]
    assert one(spark, T.rag_keywords, "uses json and rest in Big Data") == ["Big Data", "JSON", "REST"]
    assert one(spark, T.strip_markdown, "# T\n**b** *i* `c` ![x](y) [l](u)") == "T b i c l"
    assert one(spark, T.header_level, "### x") == 3 and one(spark, T.header_level, "1.2 Abc") == 3 and one(spark, T.is_header, "CAPS LINE") and not one(spark, T.is_header, "plain text.")
    assert one(spark, T.format_table_row, "a\tb") == "| a | b |" and one(spark, T.format_table_row, "a   b") == "| a | b |"
    assert one(spark, lambda c: T.trim_to_tokens(c, 5), "x" * 100) == "x" * 18 + "..." and one(spark, lambda c: T.trim_to_tokens(c, 5), "short") == "short"
    assert one(spark, T.recommend_model, "3501") is not None and one(spark, T.safe_filename, "a/b: c") == "a_b_-c"
    assert one(spark, T.clean_text, None) is None


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_bullets(spark):
    assert one(spark, lines.repair_bullets, "l\nfirst\n-\nsecond\nplain") == "l first\n- second\nplain"
    got = [r["line"] for r in lines.convert_bullets(docs(spark, "The following values:\nl alpha\n- beta\nx")).orderBy("line_no").collect()]
    assert got == ["The following values:", "• alpha", "• beta", "x"]
    alone = [r["line"] for r in lines.convert_bullets(docs(spark, "plain\n- beta\nx")).orderBy("line_no").collect()]
    assert alone == ["plain", "- beta", "x"]


def test_structure_and_fields(spark):
    kinds = {r["doc_id"]: r["document_type"] for r in lines.document_structure(docs(spark, "| a | b |\n| c | d |", "just some. prose here", "", None)).collect()}
    assert kinds[0] == "structured_fields" and kinds[1] != "list_heavy" and kinds[2] == "narrative"
    f = {(r["name"], r["content"], r["rule"]) for r in lines.structured_fields(docs(spark, "userId: integer (Required)\nTIMEOUT - 30")).collect()}
    assert ("userId", "integer (Required)", 0) in f and ("TIMEOUT", "30", 1) in f
    assert [r["name"] for r in lines.list_items(docs(spark, "- a\nx\n2. b")).collect()] == ["item_1", "item_2"]
    assert lines.table_fields(docs(spark, "| a | b | c |")).collect()[0]["content"] == "b | c"


MD = "intro\n# One\nSee Section 2 and Table 9. **API** is a way in.\n## Authentication\nUse a token. userId x\n| a | b |\n|---|---|\n| 1 | x |\n"


def test_sections_tables_refs(spark):
    s = sections.with_types(sections.sections_from_markdown(docs(spark, MD, "", None, "# Only")))
    got = [(r["doc_id"], r["section_id"], r["title"], r["section_type"]) for r in s.orderBy("doc_id", "section_id").collect()]
    assert got == [(0, 1, "Introduction", "introduction"), (0, 2, "One", "content"), (0, 3, "Authentication", "authentication"), (3, 1, "Only", "content")]
    assert sections.sections_from_markdown(docs(spark, MD), compat=True).count() == 4
    t = tables.markdown_tables(docs(spark, MD)).collect()
    assert [(r["n_rows"], r["n_cols"]) for r in t] == [(1, 2)]
    known = refs.resolution(s)
    assert {x["target"] for x in refs.broken(known).where("type = 'section'").collect()} == set() and refs.resolved(known).where("type = 'table'").count() > 0
    assert sorted(map(str, known.select("doc_id", "section_id", "type", "text", "target").collect())) == sorted(map(str, refs.references(s).collect()))
    assert terms.section_terms(s).where("term = 'API'").count() == 1
    assert summaries.all_summaries(s).select("summary_type").distinct().count() >= 3
    p = [r["page_num"] for r in sections.pages_fixed(docs(spark, "x" * 6001, "")).orderBy("page_num").collect()]
    assert p == [1, 2, 3]
    text = "# Head\n> kind\n---\n" + "\n".join(["word " * 20] * 50)
    parts = [r["content"] for r in sections.split_large(spark.createDataFrame([(1, 1, text), (2, 1, "short"), (3, 1, None)], "doc_id int, section_id int, content string"), 500, 400).where("doc_id = 1").orderBy("part").collect()]
    assert len(parts) > 1 and all(p.startswith(f"# Head\n> kind\n\n(part {k + 1})\n---\n\n") and len(p) // 4 < 480 for k, p in enumerate(parts))
    assert "\n".join(p.split("---\n\n", 1)[1] for p in parts) == "\n".join(["word " * 20] * 50)


def test_outline(spark):
    o = spark.createDataFrame([(1, [("A", [("B", [("C", None)]), ("D", None)]), ("E", None)])], "doc_id int, nodes array<struct<title: string, kids: array<struct<title: string, kids: array<struct<title: string, kids: string>>>>>>")
    assert [(r["title"], r["level"]) for r in sections.flatten_outline(o).orderBy("ord").collect()] == [("A", 1), ("B", 2), ("C", 3), ("D", 2), ("E", 1)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["alpha", "be", "Gamma.", "\n\n", "\n# H", "delta"]), max_size=120), min_size=1, max_size=3))
def test_packing_keeps_every_word(spark, texts):
    texts = [" ".join(t) for t in texts]
    got = {}
    for r in chunks.pack(docs(spark, *texts), size=30, overlap=0).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for k, t in enumerate(texts):
        assert " ".join(got.get(k, [])).split() == t.split()


def test_payloads_and_splits(spark):
    facts = chunks.chunk_facts(chunks.pack(docs(spark, "Alpha beta. " * 900, "", None), size=200, overlap=32))
    assert facts.count() > 3
    for kind in ("pinecone", "chromadb", "weaviate", "qdrant", "generic"):
        assert chunks.payload(facts, kind).count() >= 1
    s = spark.createDataFrame([(1, 1, "A b c. " * 600), (2, 1, None)], "doc_id int, section_id int, content string")
    for how in ("semantic", "structure", "rows", "tokens"):
        assert chunks.split_sections(s, how, 200).where("doc_id = 1").count() >= 1


def test_concept_definitions_of_header_blocks(spark):
    text = "## Token bucket\n\nA bucket that fills\nat a fixed rate. \n\n### Quota\n\nThe calls allowed in a day.\n# Other\n**Quota**: what remains of calls.\n## Short\n\nNo.\n## Last\n\nUp to the end of it\n"
    s = spark.createDataFrame([(1, 1, "Pages 1-3", text), (1, 2, "Pages 4-6", "`Last`: the later section wins."), (2, 1, "Page 1", None)], "doc_id int, section_id int, title string, content string")
    got = {(r["doc_id"], r["concept"]): r["definition"] for r in terms.concept_definitions(s).collect()}
    assert got == {(1, "token bucket"): "A bucket that fills\nat a fixed rate.", (1, "quota"): "what remains of calls.", (1, "last"): "the later section wins."}
    first = {r["concept"]: r["definition"] for r in terms.concept_definitions(s.where("section_id = 1")).collect()}
    assert first["last"] == "Up to the end of it"
    scores = spark.createDataFrame([(1, "rate")], "doc_id int, term string")
    assert [(r["term"], r["concept"]) for r in terms.definition_links(scores, terms.concept_definitions(s)).collect()] == [("rate", "token bucket")]


def test_sections_from_outline(spark):
    o = spark.createDataFrame([(1, 0, "A", 1, 2), (1, 1, None, None, 1), (1, 2, "C", 2, None), (1, 3, "D", 1, 9), (1, 4, "E", 1, 2), (2, 0, "F", 1, 0), (3, 0, "G", 1, 1)], "doc_id int, ord int, title string, level int, page_num int")
    p = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (1, None, "none"), (2, 0, "zero"), (2, 1, "other"), (4, 1, "unused")], "doc_id int, page_num int, page_text string")
    got = [tuple(r) for r in sections.sections_from_outline(o, p).orderBy("doc_id", "section_id").collect()]
    assert got == [(1, 1, "A", "two", 1, 2), (1, 2, "Untitled Section", "one", 0, 1), (1, 3, "C", "", 2, None), (1, 4, "D", "", 1, 9), (1, 5, "E", "two", 1, 2), (2, 1, "F", "", 1, 0), (3, 1, "G", "", 1, 1)]
    assert sections.with_types(sections.sections_from_outline(o, p)).count() == 7


def test_references_are_located(spark):
    import re

    text = "See Section 2, page 4 and Table 1. GET /api/v1/x\nfig. 3 https://a.b/c." + " filler" * 40 + " see section 2"
    got = refs.located(spark.createDataFrame([(1, 1, text), (1, 2, ""), (2, 1, None)], "doc_id int, section_id int, content string")).collect()
    assert got and all(text[r["position"] : r["position"] + len(r["text"])] == r["text"] for r in got)
    assert all(r["context"] == text[max(0, r["position"] - 50) : r["position"] + 50].strip() for r in got)
    assert {r["method"] for r in got if r["type"] == "api"} == {"GET", None}
    assert sum(r["type"] == "section" for r in got) == sum(len(re.findall(p, text)) for p in (r"(?i)(?:see\s+)?(?:section|chapter|part)\s+\d+", r"(?i)(?:in\s+)?(?:section|chapter)\s+\d+", r"(?i)(?:refer\s+to\s+)?(?:section|chapter)\s+\d+"))


def test_a_long_document_s_lines(spark):
    """Twenty thousand lines of one document, against the rules in Python."""
    text = [("- item" if k % 7 else "The following values:") if k % 3 else "plain words" for k in range(20_000)]
    got = [r["line"] for r in lines.convert_bullets(docs(spark, "\n".join(text))).orderBy("line_no").collect()]
    want = []
    for k, x in enumerate(text):
        near = text[max(0, k - 3) : k + 4]
        want.append("• item" if x.startswith("- ") and (any(w in "".join(near).lower() for w in ("following", "values")) or sum(y.startswith("- ") for y in near) > 1) else x)
    assert got == want
    long = "\n\n".join(f"Para {k}" for k in range(8000))
    assert chunks.boundaries(docs(spark, long)).count() == 7999 and lines.code_starts(docs(spark, "\n".join(["x"] * 20_000))).count() == 0


def test_bullets_of_lists(spark):
    """Lists with split markers, dashes and asterisks, between keys and values."""
    split = "Options of the port:\nl\nopen\nl\nclosed\nl\nbusy\nState: one of\n-\nfirst\n-\nsecond"
    fixed = spark.createDataFrame([(1, split)], "doc_id int, text string").select("doc_id", lines.repair_bullets(F.col("text")).alias("text"))
    got = [r["line"] for r in lines.convert_bullets(fixed).orderBy("line_no").collect()]
    assert got == ["Options of the port:", "• open", "• closed", "• busy", "State: one of", "• first", "• second"]
    assert lines.document_structure(lines_joined(spark, got)).collect()[0]["bullets"] == 5


def lines_joined(spark, rows):
    return spark.createDataFrame([(1, "\n".join(rows))], "doc_id int, text string")


def test_source_pages_of_chunks(spark):
    a, b, c = "Alpha one. " * 10, "Beta two. " * 10, "Gamma three. " * 10
    text = f"{a}\n\n{b}\n\n{c}"
    d = spark.createDataFrame([(1, text, [len(a), len(b), len(c) + 4])], "doc_id int, text string, page_lengths array<int>")
    rows = [(r["chunk_index"], r["source_pages"]) for r in chunks.pack(d, 30, 0).orderBy("chunk_index").collect()]
    # the segments start at 0, len(a) and len(a) + 2 + len(b), of pages that begin at 0, len(a) and len(a) + len(b)
    assert rows[0] == (0, [1]) and rows[-1][1] == [3] and {p for _, ps in rows for p in ps} == {1, 2, 3}
    whole = chunks.pack(d, 10_000, 0).collect()
    assert [r["source_pages"] for r in whole] == [[1, 2, 3]]
    beyond = chunks.pack(spark.createDataFrame([(1, text, [1])], "doc_id int, text string, page_lengths array<int>"), 10_000, 0).collect()
    assert beyond[0]["source_pages"] == [1] and [r["source_pages"] for r in chunks.pack(d.drop("page_lengths"), 10_000, 0, page=100).collect()] == [[1, 2, 3]]


def test_sections_of_any_size_reach_their_files(spark):
    para = "word " * 3000
    text = "\n".join(f"## Part {k}\n{para}" for k in range(40))  # about 150,000 tokens
    s = spark.createDataFrame([(1, 1, "All", text, "content"), (1, 2, "One run", "x" * 500_000, "content"), (1, 3, "Small", "a b", "api_endpoint"), (1, 4, "None", "", "content")], "doc_id int, section_id int, title string, content string, section_type string")
    got = chunks.section_chunks(s.withColumn("token_count", T.tokens(F.col("content"))))
    first = {}
    for r in got.collect():
        assert (r["token_count"] <= dict(chunks.V.TIERS)[r["size"]]) or r["size"] == "xlarge"
        first.setdefault((r["section_id"], r["part"]), r["content"])
    words = lambda k: " ".join(v for (i, _), v in sorted(first.items()) if i == k).split()
    assert words(1) == text.split() and words(2) == ["x" * 500_000] and words(3) == ["a", "b"] and (4, 1) in first
    assert max(p for i, p in first if i == 1) > 10


def test_titles_in_other_sections(spark):
    s = spark.createDataFrame([(1, 1, "Alpha", "speaks of beta"), (1, 2, "Beta", "nothing"), (1, 3, "Gamma", "ALPHA"), (2, 1, "Alpha", "beta"), (3, 1, "X", None)], "doc_id int, section_id int, title string, content string")
    assert sorted(tuple(r) for r in sections.related_by_mention(s).collect()) == [(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 3, 1)]


def test_chosen_sections(spark):
    d = docs(spark, "# A\nx\n# B\ny", "# Only\n" + "z" * 10_000, "", None, "outlined")
    o = spark.createDataFrame([(4, 0, "First", 1, 1), (4, 1, "Second", 1, 2)], "doc_id int, ord int, title string, level int, page_num int")
    p = spark.createDataFrame([(4, 1, "one"), (4, 2, "two")], "doc_id int, page_num int, page_text string")
    got = [(r["doc_id"], r["title"], len(r["content"])) for r in sections.choose_sections(d, o, p).orderBy("doc_id", "section_id").collect()]
    assert got == [(0, "A", 1), (0, "B", 1), (1, "Section 1 (Pages 1-3)", 9000), (1, "Section 2 (Page 4)", 1007), (4, "First", 3), (4, "Second", 3)]


def test_every_table_counts(spark):
    text = "|a|b|\n|-|-|\n|1|x|\n\ntext\n\n|c|\n|-|\n|2|\n||\n"
    cells = tables.table_cells(docs(spark, text, "", None))
    assert [(r["table_no"], r["rows"]) for r in tables.table_json(cells).orderBy("table_no").collect()] == [(1, '[{"a": true, "b": "x"}]'), (2, '[{"c": 2}, {"c": null}]')]
    assert [r["text"] for r in tables.embedding_text(cells).orderBy("table_no").collect()] == ["Table with columns: a, b\na: 1 | b: x", "Table with columns: c\nc: 2\nc: N/A"]

def test_term_facts_in_one_buffer(spark):
    """Term facts need one sum a term, whose rows are neither sorted nor merged for each of them, and a category once."""
    s = spark.createDataFrame([(1, 1, "A", "The authToken is a signed value.  JSON  is given."), (1, 2, "B", "authToken: some opaque string.\tAuthToken"), (1, 3, "A", None)], "doc_id int, section_id int, title string, content string")
    facts = terms.term_facts(terms.section_terms(s))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("endpoint") == 1
    r = facts.where("term = 'authtoken'").first()
    assert (r["frequency"], r["n_sections"], r["n_contexts"], r["n_definitions"], r["definition"], r["sections"]) == (3, 2, 2, 2, "a signed value", "A, B")


def test_term_cues(spark):
    """A cue stands in every match of its pattern: texts without it have none."""
    words = ["restAPI", "myapi", "HTTP", "xhttpx", "useJSON", "xmlText", "authService", "myservice", "aToken", "xtoken", "camelCase", "snake_case", "_x", "AB", "Word", "plain", "x9_", "Ab", "aBC"]
    s = spark.createDataFrame([(k, 1, "t", f"some {w} here") for k, w in enumerate(words)], "doc_id int, section_id int, title string, content string")
    got = {(r["doc_id"], r["term"]) for r in terms.section_terms(s).collect()}
    want = {(k, m.group()) for k, w in enumerate(words) for p, least in zip(V.TERM_PATTERNS, (2, 1, 1, 1, 1, 1, 1, 3)) for m in re.finditer(p, f"some {w} here") if len(m.group()) > least}
    assert got == want


def test_strip_signs(spark):
    c = F.col("c")
    r = spark.createDataFrame([(" \t\n\x0b\f\r a \n b\xa0\r\n ",), ("   ",), ("",), (None,)], "c string").select(T.strip(c).alias("c")).collect()
    assert [x["c"] for x in r] == ["a \n b\xa0", "", "", None]


def test_portions_of_batches():
    import pyarrow as pa

    from quillspark.sources.shared import portions

    b = pa.RecordBatch.from_pydict({"a": list(range(450))})
    got = list(portions([b, b.slice(0, 0)]))
    assert [x.num_rows for x in got] == [200, 200, 50] and sum((x.column(0).to_pylist() for x in got), []) == list(range(450))
