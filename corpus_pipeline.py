"""The corpus pipeline: toxicity, SimHash near-dedup, PII, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame in the columns of documents, but for
the last, which gives doc_id, source, ids, n_ids, decoded_sha256 and round_trip. Stages run on all
that their predecessor kept; run() writes each as Parquet in the shared folder, reads it back, and deletes what
the stage before wrote.

Defined cases. A null or empty text isn't toxic, has fingerprint zero (so that one document without words
stays: of smallest doc_id, null last), holds no personal data, isn't in the mix as it has no words, and would
encode as no ids. Repeated rows are one SimHash group, of which one row stays; ties go to the smallest doc_id,
then MD5 of the text, then the other columns, so reruns agree. A null doc_id or source is a value like any
other. Texts are taken whole, whatever their length. Empty tables, labels without both kinds included, give empty results
and reject nothing. Columns beyond those of documents pass through all stages but the last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import remove, shared_dir, table
from quillspark.llm.mixing import mix_documents
from quillspark.llm.pieces import encode_documents
from quillspark.llm.pii import redact_documents
from quillspark.llm.queries import vocabulary
from quillspark.llm.simhash import keep_one
from quillspark.llm.toxicity import drop_toxic


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, vocabulary("piece_bpe_32k.model"), ["doc_id", "source"])


STAGES = [("toxicity", remove_toxic), ("simhash near-dedup", near_dedup), ("pii", remove_pii), ("mixing", mix), ("sentencepiece", tokenize)]

#: The stages learn, hash and merge in ways that SQL cannot express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
