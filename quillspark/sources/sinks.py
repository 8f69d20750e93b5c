"""Outputs: texts by document, JSON artefacts, vector payloads. Files under their names: files.write_files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(files: DataFrame, path: str, by: str = "doc_id", buckets: int | None = None) -> None:
    """files (by, path, body): one folder for each value of `by`, bodies as text, in path order. For more
    values than folders are good for: `buckets` folders, by hash, of JSON lines of by, path and body."""
    if buckets:
        out = files.select(F.pmod(F.xxhash64(by), F.lit(buckets)).alias("bucket"), by, "path", "body")
        out.repartition("bucket").sortWithinPartitions("bucket", by, "path").write.mode("overwrite").partitionBy("bucket").json(path)
        return
    out = files.repartition(by).sortWithinPartitions(by, "path").select(by, F.col("body").alias("value"))
    out.write.mode("overwrite").partitionBy(by).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: How the payload of each layout goes into its store.
INSTRUCTIONS = {
    "pinecone": "Each line is one vector: fill `values` from your embedding model (1536 numbers), then upsert by `namespace` with `id` and `metadata`.",
    "chromadb": "Each line is one collection: create `collection_name`, then add `ids`, `documents` and `metadatas` together.",
    "weaviate": "Each line is one object of class DocumentChunk: define its properties, then import `properties` under `id` in batches.",
    "qdrant": "Each line is one point: create `collection_name` for your vector size, fill `vector`, then upsert `id`, `vector` and `payload`.",
    "generic": "Each line is one document: read `chunks` in order, embed `text`, and keep `metadata` beside the vector.",
}


def write_rag(chunks: DataFrame, payload: DataFrame, path: str, kind: str) -> None:
    """chunks, the payload in its layout, the totals, and how to load the payload."""
    chunks.sparkSession.createDataFrame([(INSTRUCTIONS[kind],)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/instructions")
    write_json(chunks, f"{path}/chunks")
    write_json(payload, f"{path}/{kind}_format")
    write_json(chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("token_count").alias("tokens")), f"{path}/metadata")


def index_file(files: DataFrame) -> DataFrame:
    """doc_id, index: Markdown bullets of each document's files, in path order."""
    rows = files.groupBy("doc_id").agg(F.array_sort(F.collect_list("path")).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("- ["), x, F.lit("]("), x, F.lit(")"))), "\n").alias("index"))
