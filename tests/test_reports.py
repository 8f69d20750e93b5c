"""Analyses, reports and the conversion functions on small documents with known results."""

from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import analysis as A
from quillspark.operators import reports as P
from quillspark.functions import vocab as V
from quillspark.operators import summaries as U
from quillspark.operators.sections import flatten_outline, sections_from_markdown, with_types
from quillspark.sources import sinks
from quillspark.sources.tables import markdown

SF = "/root/testdata/sf0.001"
TEXT = "# Guide\nThe API is fast. One. Two. An example is here. Five. Six. You must log in. Eight. Nine.\n## Empty\n## Code\n```python\na = 1\nb = 2\n```\nFor example: see this\n\nParameters: x and y\n\nResponse: none\n\nGET /v1/x and POST /v1/y"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def bodies(df):
    return {r["path"]: r["body"] for r in df.collect()}


def test_section_texts(spark):
    s = sections_from_markdown(docs(spark, TEXT))
    r = {x["title"]: x for x in s.select("title", A.section_summary(F.col("content"), 400).alias("brief"), A.section_summary(F.col("content"), 400, True).alias("long"), A.examples(F.col("content")).alias("ex"), A.technical_details(F.col("content")).alias("tech")).collect()}
    assert r["Guide"]["brief"] == "The API is fast One An example is here"
    assert r["Guide"]["long"] == "The API is fast One Two Eight Nine. An example is here You must log in"
    assert r["Empty"]["brief"] == "This section is empty." and r["Empty"]["tech"] == "Nothing technical here." and r["Empty"]["ex"] == []
    assert r["Code"]["ex"][0] == "Code: a = 1\nb = 2..." and "For instance: see this..." in r["Code"]["ex"]
    assert r["Code"]["tech"] == "**GET** `/v1/x`\n**POST** `/v1/y`\nTakes: x and y\nGives: none"


def test_structure_sections(spark):
    r = A.structure_sections(docs(spark, "INTRO\n1. First part\n- ITEM\nINTRO\n1. First part\nsome running text", None)).collect()
    assert [(x["ord"], x["section"]) for x in r] == [(0, "INTRO"), (1, "1. First part"), (2, "1. First part")]


def test_field_context(spark):
    r = A.field_context(docs(spark, "2.1 Limits here\n\nsize: 4\nx\ny\nz")).collect()
    assert [(x["line_no"], x["context"], x["section"]) for x in r] == [(2, "2.1 Limits here size: 4 x y", "2.1 Limits here size")]


def test_priorities_and_tables(spark):
    f = spark.createDataFrame([(1, "jwt", 30, "security_concepts", "x" * 51), (1, "get", 1, "http_concepts", "y" * 21), (1, "cat", 1, "general", None)], "doc_id bigint, term string, frequency bigint, category string, definition string")
    assert [(x["term"], x["priority"]) for x in A.priority_concepts(f).orderBy("rank").collect()] == [("jwt", 35), ("get", 12), ("cat", 5)]
    t = A.tables_with_text(docs(spark, "|a|b|\n|-|-|\n|status|2|\n|3|4|\n|5|6|\nx\n|a|b|\n|-|-|", ""))
    assert [(x["n_rows"], x["n_cols"]) for x in t.collect()] == [(3, 2)]
    assert A.important_tables(t).collect()[0]["score"] == 14


def test_master_index(spark):
    rows = [(1, f"sections/{i:02d}.md", "") for i in range(12)] + [(1, "summaries/a-summary.md", ""), (1, "x-metadata.json", ""), (1, "book.md", "")]
    b = bodies(P.master_index(spark.createDataFrame(rows, "doc_id bigint, path string, body string")))["README.md"]
    assert "### Sections (12 files)" in b and "- ... (4 others)" in b and "[04.md](sections/04.md)" in b and "[05.md]" not in b and "[09.md](sections/09.md)" in b
    assert "### Summaries (1 files)" in b and "### Metadata (1 files)" in b and "### Main Documents (1 files)" in b


def test_field_response(spark):
    f = spark.createDataFrame([(1, i, 0, f"n{i}", "v" * 301, "string") for i in range(22)], "doc_id bigint, line_no int, rule int, name string, content string, type string")
    r = P.field_response(f).collect()[0]["response"]
    assert r.startswith("Fields (22 in all)\n1. n0 (string): " + "v" * 300 + "...\n2. n1") and r.endswith("and 2 others") and "n20" not in r


def test_convert(spark):
    got = bodies(api.convert(docs(spark, TEXT, "", None)))
    assert {"README.md", "structure-overview.md", "concepts/glossary.md", "chunked/chunk-manifest.md", "summaries/README.md", "summaries/executive-summary.md"} <= set(got)
    assert "Sections: 3" in got["structure-overview.md"] and "### Sections (" in got["README.md"]
    few = bodies(api.convert(markdown(spark, SF).limit(2), tables=False, images=False, concepts=False, summaries=False))
    assert not any(p.startswith(("tables/", "images/", "concepts/", "summaries/")) for p in few)
    assert api.convert(docs(spark, TEXT).where("false")).count() == 0


def test_extract_and_rag(spark, tmp_path):
    d = docs(spark, "Name: x\nAge: 3\nCity: y\nZip: 5", "- a\n- b\n- c\n- d\n- e\n- f", "plain words that run on for a while\n" * 2, None)
    got = api.extract_content(d)
    assert {r["doc_id"]: r["document_type"] for r in got["structure"].collect()}[1] == "list_heavy"
    assert {r["doc_id"] for r in got["fields"].collect()} == {0} and {r["doc_id"] for r in got["items"].collect()} == {1} and {r["doc_id"] for r in got["content"].collect()} <= {2}
    assert api.extract_content(d, ["following"])["structure"].count() >= 3
    facts, layout = api.prepare_for_rag(docs(spark, TEXT), "weaviate", 40, 8, f"{tmp_path}/rag")
    assert facts.count() == layout.count() > 1 and spark.read.json(f"{tmp_path}/rag/weaviate_format").count() == layout.count()
    assert api.analyze(docs(spark, TEXT)).collect()[0]["has_code_blocks"]


def test_outline(spark):
    o = spark.createDataFrame([(1, [("A", [("B", [("C",)])]), ("D", None)])], "doc_id bigint, nodes array<struct<title: string, kids: array<struct<title: string, kids: array<struct<title: string>>>>>>")
    assert [(r["title"], r["level"]) for r in flatten_outline(o).orderBy("ord").collect()] == [("A", 1), ("B", 2), ("C", 3), ("D", 1)]


def test_typed_chunks(spark):
    typed = with_types(sections_from_markdown(docs(spark, "# Login\n" + "x" * 16_000)))
    from quillspark.operators.chunks import section_chunks

    got = bodies(P.chunk_files(section_chunks(typed)))
    assert set(got) == {f"chunked/01-Login-{s}.md" for s in ("medium", "large", "xlarge")}
    assert "- " + dict(V.TYPE_NOTES)["authentication"] in got["chunked/01-Login-large.md"]


def test_summaries_have_their_own_parts(spark):
    text = "# Overview\nThis is a service for orders. It is small.\n## API calls\nGET /orders returns every order that is open today. It is paged.\n## Login security\nUse a token. Keep it secret.\n## Setup\n1. Install it\n2. Start it\n## Error handling\nParameters: code and text\n\nNothing else."
    typed = with_types(sections_from_markdown(docs(spark, text, "# Bare\nplain words only", None)))
    got = {(r["doc_id"], r["summary_type"]): (r["content"], r["token_count"]) for r in U.all_summaries(typed).collect()}
    assert len(got) == 14 and len({c for (d, _), (c, _) in got.items() if d == 0}) == 7
    assert "### 1. Overview" in got[0, "detailed"][0] and "*Kind: Introduction*" in got[0, "detailed"][0] and "Sections: 5" in got[0, "complete"][0]
    assert "| GET | /orders |" in got[0, "api"][0] and "### API calls" in got[0, "api"][0] and "## Login security\nUse a token" in got[0, "security"][0]
    assert got[0, "integration"][0] == "# Getting started\n\n## Setup\n- Install it\n- Start it\n\n" and "### Error handling\nKind: Error Handling\nTakes: code and text" in got[0, "technical"][0]
    assert [got[1, k] for k in ("api", "security", "integration")] == [(V.SUMMARY_MISSING[k], 0) for k in ("api", "security", "integration")]
    long = with_types(sections_from_markdown(docs(spark, "\n".join(f"# S{k}\n" + "Some words are here now. " * 400 for k in range(30)))))
    sizes = {r["summary_type"]: r["token_count"] for r in U.all_summaries(long).collect()}
    assert sizes["executive"] <= 500 and sizes["detailed"] <= 2000 and sizes["technical"] <= 3000


def test_bucketed_files(spark, tmp_path):
    rows = [(k, f"sections/{j}.md", f"body {k} {j}") for k in range(40) for j in range(2)]
    sinks.write_text(spark.createDataFrame(rows, "doc_id bigint, path string, body string"), f"{tmp_path}/out", buckets=4)
    assert len(list(tmp_path.glob("out/bucket=*"))) <= 4
    assert sorted((r["doc_id"], r["path"], r["body"]) for r in spark.read.json(f"{tmp_path}/out").collect()) == rows


def test_metadata_takes_its_time_from_the_caller(spark):
    import json

    f = spark.createDataFrame([(1, "sections/a.md", "x" * 8), (1, "README.md", "y")], "doc_id bigint, path string, body string")
    plain, stamped = (json.loads(P.conversion_metadata(f, t).collect()[0]["body"]) for t in (None, '2020-01-01 "x"'))
    assert stamped.pop("converted") == '2020-01-01 "x"' and stamped == plain and plain["total_files"] == 2


def test_documents_meet_without_a_broadcast(spark):
    """Small estimates of rows made from few columns must not send a side through the driver."""
    from quillspark.operators import refs, terms

    s = spark.createDataFrame([(1, 1, "A", "The Data Model. See Data Model."), (2, 1, "B", "")], "doc_id int, section_id int, title string, content string")
    scores = terms.term_scores(terms.section_terms(s))
    for df in (refs.concept_links(refs.references(s), scores), terms.graph_json(scores, terms.document_pairs(terms.contained(scores, s))), P.concept_map(scores, terms.document_pairs(terms.contained(scores, s)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_glossary_reads_its_facts_once(spark):
    from quillspark.operators import terms

    s = spark.createDataFrame([(1, 1, "A", "The authToken is a signed value. JSON is given."), (1, 2, "B", "authToken and JSON.")], "doc_id int, section_id int, title string, content string")
    g = P.glossary(terms.term_facts(terms.section_terms(s)))
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(array_distinct") == 1 and "Join" not in plan
    body = g.first()["body"]
    assert "Terms: 2\n" in body and body.index("## Weightiest") < body.index("## Of class Data Concepts") < body.index("## Of class Security Concepts") and "Meaning: a signed value" in body
