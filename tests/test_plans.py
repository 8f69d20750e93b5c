"""What is dear is made once: plans of queries that once made it for each use."""

from pyspark.sql import functions as F

from quillspark import api
from quillspark.functions import text as T
from quillspark.functions import vocab
from quillspark.operators import lines, matching, refs, reports, sections, summaries, terms
from quillspark.plans import registry

DOCS = "doc_id bigint, text string"
SECTIONS = "doc_id bigint, section_id int, title string, content string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_split_once(spark):
    docs = spark.createDataFrame([(1, "a\n# B\nb"), (2, "# C\nc"), (3, None), (4, "")], DOCS)
    d = sections.sections_from_markdown(docs)
    assert plan(d).count("split(") == 1
    assert sorted((r["doc_id"], r["section_id"], r["title"], r["content"]) for r in d.collect()) == [(1, 1, "Introduction", "a"), (1, 2, "B", "b"), (2, 1, "C", "c")]


def test_contents_are_lowered_once_for_their_terms(spark):
    s = spark.createDataFrame([(1, 1, "A", "The API is a thing of use.")], SECTIONS)
    assert plan(terms.occurrences(terms.section_terms(s))).count("lower(content") == 1


def test_internal_references_are_summed_once(spark):
    s = spark.createDataFrame([(1, 1, "A", "See section 2, section 1 and page 3."), (1, 2, "B", "On page 3."), (2, 1, "C", "page 4")], SECTIONS)
    d = reports.internal_references(refs.resolved(refs.resolution(s)))
    assert "Join" not in plan(d)
    body = {r["doc_id"]: r["body"] for r in d.collect()}
    assert "**Page: " in body[1] and "### To sections" in body[1] and "### To sections" not in body[2]


def test_definition_patterns_run_once_a_use(spark):
    docs = spark.createDataFrame([(1, "Name: a value\nAB - text\nSize of 12")], DOCS)
    assert plan(lines.structured_fields(docs)).count(lines.DEFINITIONS[2]) <= 3  # a test and two groups


def test_files_are_classed_once(spark):
    d = reports.master_index(spark.createDataFrame([(1, p, "") for p in ("sections/a.md", "README.md", "x//b.md", "tables/", "a/tables/t.md", "tables")], "doc_id int, path string, body string"))
    assert plan(d).count("array_sort(") == 1
    body = d.collect()[0]["body"]
    assert body.count("[t.md](a/tables/t.md)") == 1 and "### Tables (1 files)" in body and "### Main Documents (3 files)" in body and "### Metadata (1 files)" in body


def test_only_crowded_documents_are_joined_for_their_needles(spark):
    texts = spark.createDataFrame([(1, 1, "ab"), (None, 2, "ab")], "doc_id int, item int, text string")
    needles = spark.createDataFrame([(1, "a"), (None, "a")], "doc_id int, needle string")
    d = matching.found_in(texts, needles, "item")
    assert plan(d).count("> 1)") == 2 and [tuple(r) for r in d.collect()] == [(1, 1, "a")]


def test_concept_links_try_concept_patterns_alone(spark):
    s = spark.createDataFrame([(1, 1, "A", "See section 2 of the API at https://a.example.com.")], SECTIONS)
    assert {r["type"] for r in refs.references(s, ("concept",)).select(F.col("type")).collect()} == {"concept"}
    assert "https?" not in plan(registry.queries()["refs_concepts"](spark, "/root/testdata/sf0.001"))


def longest_plan(spark, run):
    """Length of the longest plan that the driver has told of while `run` ran."""
    told = lambda: [x for x in (lambda s: [s.apply(k) for k in range(s.size())])(spark._jsparkSession.sharedState().statusStore().executionsList())]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {x.executionId() for x in told()}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return max(len(x.physicalPlanDescription()) for x in told() if x.executionId() not in before)


def test_no_plan_holds_all_of_a_conversion(spark):
    d = spark.createDataFrame([(1, "# A\nThe API is a thing of use. See section 2.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## B\nThe API is here.")], DOCS)
    assert longest_plan(spark, lambda: api.convert(d).write.format("noop").mode("overwrite").save()) < 250_000


def test_no_plan_holds_all_of_the_summaries(spark):
    assert longest_plan(spark, lambda: registry.queries()["summary_files"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()) < 250_000


def test_literal_titles_are_not_left_to_the_driver(spark):
    files = spark.createDataFrame([(1, "main_a/x.md", ""), (1, "x.md", "")], "doc_id int, path string, body string")
    d = reports.master_index(files)
    assert "initcap" not in d._jdf.queryExecution().analyzed().toString() and "### Main Documents (" in d.collect()[0]["body"]
    s = spark.createDataFrame([(1, 1, "A", "See section 2, section 1 and page 3."), (1, 2, "B", "On page 3.")], SECTIONS)
    assert "initcap" not in reports.internal_references(refs.resolved(refs.resolution(s)))._jdf.queryExecution().analyzed().toString()


def test_bodies_are_not_moved_for_the_index(spark):
    files = spark.createDataFrame([(1, "sections/a.md", "A"), (1, "tables/t.md", "T"), (2, "x.md", None)], "doc_id int, path string, body string")
    d = reports.with_master_index(files)
    assert "Generate" not in plan(d) and plan(d).count("Aggregate") == 1
    got = {(r["doc_id"], r["path"]): r["body"] for r in d.collect()}
    assert len(got) == 5 and got[1, "sections/a.md"] == "A" and {k: got[k, "README.md"] for k in (1, 2)} == {r["doc_id"]: r["body"] for r in reports.master_index(files).collect()}


def test_facts_of_documents_are_summed_once(spark):
    rows = [(1, 1, "Getting started", "The API has a method, a token and JSON. Configuration of the API."), (1, 2, "API", None), (1, 3, "Setup", "how to install; policy and schema"), (2, 1, "A", ""), (3, 1, "", None), (4, 2, "Steps", "database error")]
    typed = sections.with_types(spark.createDataFrame(rows, SECTIONS))
    d = summaries.document_facts(typed)
    assert plan(d).count("Aggregate") == 1
    of = lambda df, c: {r["doc_id"]: r[c] for r in df.collect()}
    named = {}
    for r in sorted(summaries.themes(typed).collect(), key=lambda r: (r["doc_id"], r["rank"])):
        named.setdefault(r["doc_id"], []).append(r["theme"])
    got = d.collect()
    assert {r["doc_id"]: r["document_type"] for r in got} == of(summaries.document_type(typed), "document_type") and {r["doc_id"]: r["depth"] for r in got} == of(summaries.technical_depth(typed), "depth")
    assert {r["doc_id"]: r["structure_type"] for r in got} == of(summaries.structure_type(typed), "structure_type") and {r["doc_id"]: r["themes"] for r in got if r["themes"]} == named


def test_terms_with_defining_words_within_keep_their_definitions(spark):
    s = spark.createDataFrame([(1, 1, "A", "Data Is is a thing of some use. And Truth Means Power: a saying of old times. The userToken means a signed value of it.\nSome Item - a piece of the whole.")], SECTIONS)
    d = terms.occurrences(terms.section_terms(s))
    got = {r["form"]: r["def"] for r in d.collect()}
    assert got["Data Is"] == "a thing of some use" and got["And Truth Means Power"] == "a saying of old times" and got["userToken"] == "a signed value of it" and got["Some Item"] == "a piece of the whole"
    assert plan(terms.term_facts(terms.section_terms(s))).count("lower(term") < 20  # once for each word of each class before


def test_first_signs_of_references_lose_no_match(spark):
    import re

    text = "See Section 2, part 3, IN chapter 4; Refer to section 5 on Page 6, see page 7. As shown in Figure 1, see figure 2, the diagram in figure 3, diagram 9. See table 1, in Table 2, the following table 3, as shown in table 4. GET /a put /b. REST api HTTP JSON xml OAuth JWT SSL TLS CRUD authentication Endpoint middleware payload database query schema index migration transaction framework library module package dependency"
    for (_, p, _), first in zip(vocab.REFERENCES, vocab.REFERENCE_STARTS, strict=True):
        assert [m.group() for m in re.finditer(T.starting(p, first), text)] == [m.group() for m in re.finditer(p, text)]
