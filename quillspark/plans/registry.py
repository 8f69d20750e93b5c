"""All queries of the library proper."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import text as T
from ..operators import analysis as A
from ..operators import chunks as C
from ..operators import intervals as I
from ..operators import lines as L
from ..operators import refs as R
from ..operators import reports as P
from ..operators import sections as S
from ..operators import summaries as U
from ..operators import tables as B
from ..operators import terms as M
from ..operators import trees as N
from ..operators.matching import meet
from ..sources import docx, pdf, sinks
from ..sources.shared import cut
from ..sources.tables import MENTIONS, html_to_markdown, markdown, table
from ..streaming import events as E
from . import oracle


def _docs(s, d):
    return table(s, d, "documents")


def _md(s, d):
    return markdown(s, d)


def _sec(s, d):
    return S.sections_from_markdown(markdown(s, d))


def _typed(s, d):
    return S.with_types(_sec(s, d))


def _text(name, make, source=_docs):
    """A query of doc_id and one column made of text."""
    return name, lambda s, d: source(s, d).select("doc_id", make(F.col("text")).alias(name))


def token_tiers(s, d):
    x = _docs(s, d).select("lang", T.tokens(F.col("text")).alias("n"), F.size(T.sentences(F.col("text"))).alias("k"))
    return x.groupBy("lang", T.recommend_model(F.col("n")).alias("tier")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.sum("k").alias("sentences"))


def _vectors(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return C.chunk_facts(C.pack(_docs(s, d))).join(v, "doc_id", "left")


def _boundary_pages(s, d):
    """The pages, of 300 signs, that boundaries stand on."""
    pages = A.page_offsets(S.pages_fixed(_md(s, d), 300)).select("doc_id", "page_num", "start", F.col("end").alias("stop"))
    return I.points_in_intervals(C.boundaries(_md(s, d)), pages, ["doc_id"], "position", "start", "stop").drop("start", "stop")


def _page_md(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("text"))


def _names(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("My "), "p_name", F.lit(" (v1."), (F.col("p_partkey") % 10).cast("string"), F.lit(") [FINAL]: "), "p_brand", F.lit("/"), "p_type", F.lit(".PDF")).alias("text"))
    return p


def _pairs(s, d):
    return M.cooccurrence(M.section_terms(_sec(s, d)))


def _refs(s, d):
    return R.references(_sec(s, d))


def _known(s, d):
    return R.resolution(_sec(s, d))


def _broken(s, d):
    return R.broken(_known(s, d))


def _resolved(s, d):
    return R.resolved(_known(s, d))


def _scores(s, d):
    return M.term_scores(M.section_terms(_sec(s, d)))


def _facts(s, d):
    return C.chunk_facts(C.pack(_md(s, d)))


def _term_facts(s, d):
    return M.term_facts(M.section_terms(_sec(s, d)))


def _tables(s, d):
    return A.tables_with_text(_md(s, d))


def _links(s, d):
    return R.link_map(_known(s, d).where("known or type = 'url'"))


def _mapped(s, d):
    """Scored terms, derived once, and the pairs of a document's sections."""
    scores = cut(_scores(s, d))
    return scores, M.document_pairs(M.contained(scores, _sec(s, d)))


def _important(s, d):
    t = _tables(s, d)
    return meet(t, A.important_tables(t).select("doc_id", "table_no", "rank"), ["doc_id", "table_no"])


def _summaries(s, d):
    return U.all_summaries(cut(_typed(s, d)), A.priority_concepts(_term_facts(s, d), keep=("definition",)), _important(s, d))


def _outline(s, d):
    """One outline a region: nations, and under them suppliers."""
    kids = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.struct(x["s_name"].alias("title"), F.lit(None).cast("array<struct<title: string>>").alias("kids"))).alias("kids"))
    node = table(s, d, "nation").join(kids, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("title"), "kids")), lambda a, b: a["n_nationkey"] - b["n_nationkey"]).alias("nodes"))
    return node.select("doc_id", F.transform("nodes", lambda x: F.struct(x["title"].alias("title"), x["kids"].alias("kids"))).alias("nodes"))


def _tree(s, d):
    """Outlines as rows: every 60 parts one, deep and with branches; every seventh has a cycle at its top."""
    k, n = F.col("p_partkey").cast("bigint"), F.expr("(p_partkey - 1) % 60").cast("bigint")
    doc = F.expr("(p_partkey - 1) div 60")
    parent = F.when((n == 0) & (doc % 7 == 3), k + 1).when(n == 0, None).when(n % 5 == 4, k - 1 - n % 4).otherwise(k - 1)
    return table(s, d, "part").select(doc.alias("doc_id"), k.alias("node"), parent.alias("parent"), (-k % 3).alias("ord"), F.col("p_name").alias("title"))


def _entries(s, d):
    """An outline of every second page; some of its entries point nowhere."""
    n = F.col("page_num")
    return S.pages_fixed(_docs(s, d)).where(n % 2 == 0).select("doc_id", (n - 1).alias("ord"), F.concat(F.lit("Page "), n.cast("string")).alias("title"), F.lit(1).alias("level"), F.when(n % 5 == 4, 9999).otherwise(n).alias("page_num"))


def _mixed(s, d):
    """Plain documents, and Markdown ones under further numbers."""
    return _docs(s, d).select("doc_id", "text").unionByName(_md(s, d).select((F.col("doc_id") + 100000000).alias("doc_id"), "text"))


def _pdfs(s, d):
    """The documents' pages as PDF files, to be read back."""
    return pdf.pages_as_pdf(S.pages_fixed(_docs(s, d)))


def _numbered(df):
    return df.select(F.col("path").cast("bigint").alias("doc_id"), *[c for c in df.columns if c != "path"])


def _titled(s, d):
    """Sections whose texts name each other's titles: one document for each 150th customer."""
    return s.sql(MENTIONS, customer=table(s, d, "customer"))


def _jsoned(df):
    """Nested columns as the JSON that the stores take."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct") else F.col(f.name) for f in df.schema.fields])


def _sections_with(name, make):
    """A query of one column made of each section's content."""
    return name, lambda s, d: _sec(s, d).select("doc_id", "section_id", make(F.col("content")).alias(name))


QUERIES = {
    "token_tiers": token_tiers,
    **dict([
        _text("clean_text", T.clean_text), _text("fixed_text", T.fix_chars), _text("plain_text", T.strip_markdown, _md), _text("n_sentences", lambda c: F.size(T.sentences(c))), _text("keywords", T.keywords),
        _text("rag_keywords", T.rag_keywords, _md), _text("urls", T.urls, _md), _text("emails", T.emails, _md), _text("has_toc", T.has_toc), _text("safe_name", T.safe_filename, _names), _text("folder_name", T.sanitize_folder, _names),
        _text("anchor", T.anchor, _names), _text("trimmed", lambda c: T.trim_to_tokens(c, 100)), _text("context", lambda c: T.context(c, F.lit("json")), _md), _text("quality", T.quality), _text("repaired", L.repair_bullets, _md),
    ]),
    "processed": lambda s, d: L.processed(_md(s, d)),
    "images": lambda s, d: _md(s, d).select("doc_id", F.explode(T.images(F.col("text"))).alias("i")).select("doc_id", F.col("i.alt").alias("alt"), F.col("i.url").alias("url")),
    "token_costs": lambda s, d: _docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.recommend_model(T.tokens(F.col("text"))).alias("model"), T.cost(T.tokens(F.col("text"))).alias("cost"), (T.tokens(F.col("text")) <= 4000).alias("fits")),
    "document_ids": lambda s, d: _docs(s, d).select("doc_id", F.left(F.md5(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).cast("binary")), F.lit(12)).alias("hash")),
    "page_markdown": lambda s, d: _page_md(s, d),
    "header_lines": lambda s, d: L.lines(_md(s, d)).where(T.is_header(F.col("line"))).select("doc_id", "line_no", T.header_level(F.col("line")).alias("level")),
    "table_rows": lambda s, d: L.lines(_docs(s, d)).where(T.is_table_row(F.col("line"))).select("doc_id", "line_no", T.format_table_row(F.col("line")).alias("row")),
    "code_starts": lambda s, d: L.code_starts(_md(s, d)),
    "code_ends": lambda s, d: L.code_ends(_md(s, d)),
    "bullets": lambda s, d: L.convert_bullets(_md(s, d)),
    "doc_structure": lambda s, d: L.document_structure(_md(s, d)),
    "doc_structure_documents": lambda s, d: L.document_structure(_docs(s, d)),
    "fields_structured": lambda s, d: L.structured_fields(_md(s, d)),
    "field_types": lambda s, d: L.structured_fields(_md(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    "field_metadata": lambda s, d: L.field_details(_md(s, d)),
    "fields_list": lambda s, d: L.list_items(_md(s, d)),
    "fields_generic": lambda s, d: L.generic_content(_docs(s, d)),
    "fields_table": lambda s, d: L.table_fields(_md(s, d)),
    "pages_fixed": lambda s, d: S.pages_fixed(_docs(s, d)),
    "pdf_pages": lambda s, d: _numbered(pdf.pdf_pages(_pdfs(s, d))).drop("images"),
    "pdf_outline": lambda s, d: _numbered(pdf.pdf_outline(_pdfs(s, d))),
    "pdf_facts": lambda s, d: _numbered(pdf.pdf_facts(_pdfs(s, d))),
    "docx_markdown": lambda s, d: _numbered(docx.docx_markdown(docx.markdown_as_docx(_md(s, d)))),
    "sections_by_pages": lambda s, d: S.sections_from_pages(_docs(s, d)),
    "outline_adjacency": lambda s, d: N.flatten_adjacency(_tree(s, d)),
    "outline_cycles": lambda s, d: N.cycles(_tree(s, d)),
    "outline_flat": lambda s, d: S.flatten_outline(_outline(s, d)),
    "sections_outline": lambda s, d: S.sections_from_outline(_entries(s, d), S.pages_fixed(_docs(s, d))),
    "sections_chosen": lambda s, d: S.choose_sections(_mixed(s, d), _entries(s, d).where("doc_id % 2 = 0"), S.pages_fixed(_docs(s, d))),
    "sections_md": lambda s, d: _sec(s, d),
    "sections_headers": lambda s, d: S.sections_from_headers(_md(s, d)),
    "section_types": lambda s, d: _typed(s, d).select("doc_id", "section_id", "section_type", "token_count"),
    "section_filenames": lambda s, d: _typed(s, d).select("doc_id", "section_id", S.file_name(F.col("title"), F.col("section_type"), F.col("section_id")).alias("file")),
    "docx_section_types": lambda s, d: _sec(s, d).select("doc_id", "section_id", S.word_section_type(F.col("title")).alias("kind")),
    "related_by_type": lambda s, d: S.related_by_type(_typed(s, d)),
    "related_by_mention": lambda s, d: S.related_by_mention(_titled(s, d)),
    "document_map": lambda s, d: S.document_map(_typed(s, d)),
    "document_readme": lambda s, d: S.readme(_typed(s, d)),
    "section_chunks": lambda s, d: C.section_chunks(_typed(s, d)),
    "section_files": lambda s, d: S.section_files(_typed(s, d)),
    "section_index": lambda s, d: sinks.index_file(S.section_files(_typed(s, d))),
    "consolidated_summary": lambda s, d: S.consolidated(_typed(s, d)),
    "split_32k": lambda s, d: S.split_large(_docs(s, d).select("doc_id", F.lit(1).alias("section_id"), F.col("text").alias("content")), 1000, 800),
    "md_tables": lambda s, d: B.markdown_tables(_md(s, d)),
    "cell_types": lambda s, d: B.table_cells(_md(s, d)).select("doc_id", "table_no", "row_no", "col_no", "col_name", T.cell_kind(F.col("cell")).alias("kind"), T.cell_number(F.col("cell")).alias("number"), T.format_cell(F.col("cell")).alias("shown")),
    "table_profile": lambda s, d: B.profile(B.table_cells(_md(s, d))),
    "table_notes": lambda s, d: B.table_notes(B.profile(B.table_cells(_md(s, d)))),
    "value_distribution": lambda s, d: B.value_distribution(B.table_cells(_md(s, d))),
    "column_sketches": lambda s, d: B.sketched(B.column_sketches(B.table_cells(_md(s, d)))),
    "corpus_columns": lambda s, d: B.sketched(B.merged(B.column_sketches(B.table_cells(_md(s, d))), "col_name")),
    "value_counts": lambda s, d: B.value_distribution(B.table_cells(_md(s, d)), keys=("doc_id", "table_no", "col_no", "col_name")),
    "table_json": lambda s, d: B.table_json(B.table_cells(_md(s, d))),
    "table_embedding": lambda s, d: B.embedding_text(B.table_cells(_md(s, d))),
    "boundaries": lambda s, d: C.boundaries(_md(s, d)),
    "boundary_pages": _boundary_pages,
    "rag_chunks": lambda s, d: C.chunk_facts(C.pack(_docs(s, d))),
    "chunk_pages": lambda s, d: C.chunk_pages(C.pack(_docs(s, d))),
    "chunk_plan": lambda s, d: C.chunk_plan(_typed(s, d)),
    "chunk_sizes": lambda s, d: C.chunk_sizes(C.chunk_plan(_typed(s, d))),
    "chunk_manifest": lambda s, d: C.manifest(C.chunk_plan(_typed(s, d))),
    **{f"split_{how}": (lambda s, d, how=how: C.split_sections(_docs(s, d).select("doc_id", F.lit(1).alias("section_id"), F.col("text").alias("content")), how, 500).drop("parts")) for how in ("structure", "rows", "tokens")},
    "split_semantic": lambda s, d: C.split_sections(_md(s, d).select("doc_id", F.lit(1).alias("section_id"), F.col("text").alias("content")), "semantic", 60).drop("parts"),
    **{f"fmt_{kind}": (lambda s, d, kind=kind: _jsoned(C.payload(_facts(s, d), kind))) for kind in ("pinecone", "chromadb", "weaviate", "qdrant", "generic")},
    "chunk_embeddings": lambda s, d: _vectors(s, d).select("doc_id", "chunk_id", "embedding"),
    "terms": lambda s, d: M.section_terms(_sec(s, d)).select("doc_id", "section_id", "term", M.category(F.col("term")).alias("category")),
    "term_scores": lambda s, d: _scores(s, d),
    "cooccurrence": lambda s, d: _pairs(s, d),
    "term_in_section": lambda s, d: M.contained(_scores(s, d), _sec(s, d)),
    "document_pairs": lambda s, d: M.document_pairs(M.contained(_scores(s, d), _sec(s, d))),
    "category_terms": lambda s, d: M.category_terms(_scores(s, d)),
    "section_clusters": lambda s, d: M.section_clusters(M.section_terms(_sec(s, d))),
    "graph_json": lambda s, d: M.graph_json(*_mapped(s, d)),
    "glossary_json": lambda s, d: M.glossary_json(_term_facts(s, d), M.concept_definitions(_sec(s, d))),
    "concept_map_md": lambda s, d: P.concept_map(*_mapped(s, d)),
    "term_degrees": lambda s, d: M.degrees(_pairs(s, d)),
    "term_graph_edges": lambda s, d: M.graph(_scores(s, d), _pairs(s, d))[1],
    "term_graph_nodes": lambda s, d: M.graph(_scores(s, d), _pairs(s, d))[0],
    "concept_defs": lambda s, d: M.concept_definitions(_sec(s, d)),
    "definition_links": lambda s, d: M.definition_links(_scores(s, d), M.concept_definitions(_sec(s, d))),
    "glossary_top": lambda s, d: B.most_frequent(_scores(s, d).where("score >= 5"), ["doc_id"], [F.desc("score"), "term"], 20).select("doc_id", "term", "score", "rank"),
    "category_top": lambda s, d: B.most_frequent(_scores(s, d).groupBy("category", "term").agg(F.sum("frequency").alias("n")), ["category"], [F.desc("n"), "term"], 10),
    "references": _refs,
    "refs_urls": lambda s, d: R.url_facts(R.references(_sec(s, d), ("url",))),
    "refs_located": lambda s, d: R.located(_sec(s, d)),
    "refs_external": lambda s, d: R.external(R.references(_sec(s, d), ("url", "api"))),
    "refs_resolved": _resolved,
    "refs_broken": _broken,
    "refs_concepts": lambda s, d: R.concept_links(R.references(_sec(s, d), ("concept",)), _scores(s, d)),
    "link_map": _links,
    "xref_stats": lambda s, d: R.statistics(_known(s, d)),
    "document_type_vote": lambda s, d: U.document_type(_sec(s, d)),
    "themes": lambda s, d: U.themes(_sec(s, d)),
    "technical_depth": lambda s, d: U.technical_depth(_sec(s, d)),
    "structure_type": lambda s, d: U.structure_type(_typed(s, d)),
    "key_sections": lambda s, d: U.key_sections(_typed(s, d)),
    "key_sentence": lambda s, d: _sec(s, d).select("doc_id", "section_id", U.key_sentence(F.col("content")).alias("sentence")),
    "endpoints": lambda s, d: U.endpoints(_sec(s, d)),
    "security_sentences": lambda s, d: U.security_sentences(_sec(s, d)),
    "integration_steps": lambda s, d: U.steps(_sec(s, d)),
    "summaries": lambda s, d: _summaries(s, d),
    "term_facts": lambda s, d: _term_facts(s, d).select("doc_id", "term", "definition", "context", "sections"),
    "priority_concepts": lambda s, d: A.priority_concepts(_term_facts(s, d)),
    "tables_text": _tables,
    "important_tables": lambda s, d: A.important_tables(_tables(s, d)),
    **dict([
        _sections_with("section_examples", A.examples), _sections_with("technical_details", A.technical_details),
        _sections_with("summary_brief", lambda c: A.section_summary(c, 40)), _sections_with("summary_detailed", lambda c: A.section_summary(c, 200, True)),
    ]),
    "top_connected": lambda s, d: A.top_connected(M.degrees(_pairs(s, d))),
    "strong_pairs": lambda s, d: A.strong_pairs(_pairs(s, d)),
    "category_ranks": lambda s, d: A.category_ranks(_scores(s, d)),
    "structure_sections": lambda s, d: A.structure_sections(_docs(s, d)),
    "field_context": lambda s, d: A.field_context(_md(s, d)),
    "document_stats": lambda s, d: A.document_stats(_md(s, d)),
    "page_offsets": lambda s, d: A.page_offsets(S.pages_fixed(_docs(s, d))),
    "table_usage": lambda s, d: A.table_usage(B.profile(B.table_cells(_md(s, d)))),
    "analyze": lambda s, d: api.analyze(_docs(s, d)),
    "convert": lambda s, d: api.convert(_md(s, d)),
    "glossary_md": lambda s, d: P.glossary(_term_facts(s, d)),
    "category_glossaries": lambda s, d: P.category_glossaries(_term_facts(s, d)),
    "xref_internal": lambda s, d: P.internal_references(_resolved(s, d)),
    "xref_external": lambda s, d: P.external_references(R.references(_sec(s, d), ("url", "api"))),
    "xref_broken": lambda s, d: P.broken_references(_broken(s, d)),
    "xref_links": lambda s, d: P.link_mapping(_links(s, d)),
    "table_files": lambda s, d: P.table_files(_tables(s, d)),
    "tables_index": lambda s, d: P.tables_index(_tables(s, d)),
    "chunk_files": lambda s, d: P.chunk_files(C.section_chunks(_typed(s, d))),
    "chunk_manifest_md": lambda s, d: P.chunk_manifest(_typed(s, d), C.section_chunks(_typed(s, d))),
    "summary_files": lambda s, d: P.summary_files(_summaries(s, d)),
    "summary_index": lambda s, d: P.summary_index(_summaries(s, d)),
    "word_sections": lambda s, d: P.word_sections(_sec(s, d), S.word_section_type(F.col("title"))),
    "word_navigation": lambda s, d: P.word_navigation(_sec(s, d)),
    "image_catalog": lambda s, d: P.image_catalog(QUERIES["images"](s, d)),
    "master_index": lambda s, d: P.master_index(S.section_files(_typed(s, d)).unionByName(P.table_files(_tables(s, d)))),
    "conversion_metadata": lambda s, d: P.conversion_metadata(S.section_files(_typed(s, d)).unionByName(P.table_files(_tables(s, d)))),
    "field_response": lambda s, d: P.field_response(L.structured_fields(_md(s, d))),
    "events_hourly": lambda s, d: E.hourly(table(s, d, "events")),
}


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return {k: v for k, v in oracle.sql().items() if k in QUERIES}
