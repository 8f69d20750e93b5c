"""The tools of the library as functions from documents to DataFrames: extract, analyse, convert, prepare for RAG.

docs has doc_id and text (Markdown for the Word-like tools). Nothing runs until a result is used, but for what convert keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analysis as A
from .operators import chunks as C
from .operators import lines as L
from .operators import refs as R
from .operators import reports as P
from .operators import sections as S
from .operators import summaries as U
from .operators import terms as M
from .operators.matching import meet
from .sources import files as named
from .sources import sinks
from .sources.shared import cut


def extract_content(docs: DataFrame, bullet_indicators: list[str] | None = None) -> dict[str, DataFrame]:
    """Structure, typed fields, list items, running text and sections of documents. With indicators,
    bullets are converted by them first."""
    if bullet_indicators:
        lines = L.convert_bullets(docs, bullet_indicators).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        docs = lines.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    kind = L.document_structure(docs)

    def of(t: str, make) -> DataFrame:
        return make(docs).join(kind.where(F.col("document_type") == t).select("doc_id"), "doc_id", "left_semi")

    return {"structure": kind, "sections": A.structure_sections(docs), "fields": of("structured_fields", L.structured_fields), "items": of("list_heavy", L.list_items), "content": of("narrative", L.generic_content)}


def analyze(docs: DataFrame) -> DataFrame:
    """Sizes, flags and the type of each document."""
    return meet(A.document_stats(docs), L.document_structure(docs).select("doc_id", "document_type"), ["doc_id"])


def convert(docs: DataFrame, tables: bool = True, images: bool = True, concepts: bool = True, summaries: bool = True, output: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, path, body of every file that a document turns into, with a README.md that lists them; written under
    their names if `output` is given."""
    # sections, references, terms, tables and summaries are derived once and kept; every file comes from one of them. Reports,
    # small beside the texts, are made and kept kind by kind: the driver plans anew after each shuffle, each time the whole plan
    kept = lambda *reports: cut(reduce(DataFrame.unionByName, reports))
    typed = cut(S.with_types(S.sections_from_markdown(docs)))
    sections = typed.drop("section_type", "token_count")
    known = cut(R.resolution(sections))
    refs, found, pieces = known.drop("known"), R.resolved(known), C.section_chunks(typed)
    parts = [S.section_files(typed), P.chunk_files(pieces), kept(P.internal_references(found), P.external_references(refs), P.broken_references(R.broken(known)), P.link_mapping(R.link_map(known.where("known or type = 'url'"))))]
    overviews = [P.word_navigation(sections), P.chunk_manifest(typed, pieces)]
    t = cut(A.tables_with_text(docs)) if tables or summaries else None
    if tables:
        parts.append(P.table_files(t))
        overviews.append(P.tables_index(t))
    if images:
        i = docs.select("doc_id", F.explode(T.images(F.col("text"))).alias("i")).select("doc_id", "i.alt", "i.url")
        overviews.append(P.image_catalog(i))
    facts = cut(M.term_facts(M.section_terms(sections))) if concepts or summaries else None
    if concepts:
        parts.append(kept(P.glossary(facts), P.category_glossaries(facts), P.concept_map(facts, M.document_pairs(M.contained(facts, sections)))))
    if summaries:
        important = meet(t, A.important_tables(t).select("doc_id", "table_no", "rank"), ["doc_id", "table_no"])
        s = cut(U.all_summaries(typed, A.priority_concepts(facts, keep=("definition",)), important))
        parts.append(P.summary_files(s))
        overviews.append(P.summary_index(s))
    files = reduce(DataFrame.unionByName, [*parts, kept(*overviews)])
    files = P.with_master_index(files)
    if output:
        named.write_files(files, output, buckets=buckets)
    return files


def prepare_for_rag(docs: DataFrame, vector_db_format: str = "generic", chunk_size: int = C.SIZE, chunk_overlap: int = C.OVERLAP, output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk facts and their payload; both are written with the totals if `output` is given."""
    facts = C.chunk_facts(C.pack(docs, chunk_size, chunk_overlap))
    layout = C.payload(facts, vector_db_format)
    if output:
        sinks.write_rag(facts, layout, output, vector_db_format)
    return facts, layout
