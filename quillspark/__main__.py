"""Command line: python -m quillspark convert|analyze|extract|rag INPUT OUTPUT.

INPUT is a folder (or file) of .pdf, .docx, .md, .txt or .html documents; a document's id is its path. Files that can't
be read are listed in OUTPUT/errors. OUTPUT holds named files (convert) or tables as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators.chunks import OVERLAP, SIZE
from .sources import docx, pdf, sinks
from .sources.tables import html_to_markdown, read_binary, read_documents

KINDS = ("pdf", "docx", "md", "txt", "html")


def read(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the documents of a kind under a path, and (doc_id, error) of those that can't be read."""
    if kind == "pdf":
        pages = pdf.pdf_pages(read_binary(spark, path, kind))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_num").isNotNull(), F.struct("page_num", "page_text")))), lambda x: x["page_text"]), "\n\n")
        docs = pages.groupBy(F.col("path").alias("doc_id")).agg(text.alias("text"), F.max("error").alias("error"), F.count("page_num").alias("n"))
        return docs.where("n > 0").select("doc_id", "text"), docs.where("error is not null").select("doc_id", "error")
    if kind == "docx":
        docs = docx.docx_markdown(read_binary(spark, path, kind)).withColumnRenamed("path", "doc_id")
        return docs.where("error is null").select("doc_id", "text"), docs.where("error is not null").select("doc_id", "error")
    docs = read_documents(spark, path, kind).select(F.col("path").alias("doc_id"), (html_to_markdown(F.col("text")) if kind == "html" else F.col("text")).alias("text"))
    return docs, docs.where("false").select("doc_id", F.lit("").alias("error"))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("what", choices=("convert", "analyze", "extract", "rag"))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--kind", choices=KINDS, default="md", help="documents to read")
    p.add_argument("--buckets", type=int, help="convert: folders to group documents in")
    p.add_argument("--format", choices=("generic", "pinecone", "chromadb", "weaviate", "qdrant"), default="generic", help="rag: layout of the payload")
    p.add_argument("--chunk-size", type=int, default=SIZE)
    p.add_argument("--chunk-overlap", type=int, default=OVERLAP)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    docs, errors = read(spark, o.input, o.kind)
    if o.what == "convert":
        api.convert(docs, output=f"{o.output}/files", buckets=o.buckets)
    elif o.what == "analyze":
        sinks.write_json(api.analyze(docs), f"{o.output}/analysis")
        if o.kind == "pdf":
            files = read_binary(spark, o.input, "pdf")
            sinks.write_json(pdf.pdf_facts(files), f"{o.output}/facts")
            sinks.write_json(pdf.pdf_outline(files), f"{o.output}/chapters")
    elif o.what == "extract":
        for name, table in api.extract_content(docs).items():
            sinks.write_json(table, f"{o.output}/{name}")
    else:
        api.prepare_for_rag(docs, o.format, o.chunk_size, o.chunk_overlap, o.output)
    sinks.write_json(errors, f"{o.output}/errors")


if __name__ == "__main__":
    main()
