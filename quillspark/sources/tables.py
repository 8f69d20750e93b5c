"""Inputs: parquet tables, whole-file text and binary documents, file listings, and derived corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, extension: str = "md") -> DataFrame:
    """Whole text files of one extension, with the file's facts: path, text, bytes, kb, modified."""
    files = spark.read.option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"), F.round(F.col("_metadata.file_size") / 1024, 2).alias("kb"), F.col("_metadata.file_modification_time").alias("modified"))


def read_binary(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """Binary documents for a parser to follow: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(path)


def parse_documents(files: DataFrame, parser) -> DataFrame:
    """doc (path) and text by parser(bytes) -> str, one Arrow batch at a time; a file that the parser
    rejects has a null text and its error."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text, error = [], []
            for content in b.column(1).to_pylist():
                try:
                    text.append(parser(content))
                    error.append(None)
                except Exception as e:  # one broken file doesn't end the job
                    text.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: One Markdown document for each customer; the text runs in Spark and in DuckDB alike.
MARKDOWN = """SELECT c_custkey AS doc_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'Preface for ' || c_name || ' follows.' || chr(10) ELSE '' END
  || '# ' || c_name || ' Guide' || chr(10) || chr(10)
  || 'Welcome to the ' || c_mktsegment || ' Customer Portal. This overview of the REST API uses JSON. See Section 2 for the Data Model and refer to page 4.' || CASE WHEN c_custkey % 4 = 1 THEN ' Compare p. ' || CAST(c_custkey % 13 AS STRING) || ', page 012 and section 02.' ELSE '' END || chr(10) || chr(10)
  || '## Authentication' || chr(10) || chr(10)
  || 'Use OAuth or a JWT token. The accessToken is a signed value of the Customer Portal.' || chr(10)
  || 'userId: integer value (Required)' || chr(10) || 'timeout: ' || CAST(c_nationkey AS STRING) || chr(10) || 'active: yes' || chr(10)
  || 'range: 0-100 see Section 3' || chr(10) || 'contact: help' || CAST(c_custkey AS STRING) || '@example.com' || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN '## API Endpoints' || chr(10) || chr(10) || 'GET /api/v1/customers/' || CAST(c_custkey AS STRING)
      || ' returns one JSON object. POST /api/v1/orders creates an order.' || chr(10) || '```json' || chr(10) || '["id", ' || CAST(c_custkey AS STRING) || ']' || chr(10) || '```' || chr(10) ELSE '' END
  || '## Data Formats' || chr(10) || chr(10) || '| name | value | share |' || chr(10) || '|---|---|---|' || chr(10)
  || '| alpha | ' || CAST(c_nationkey * 7 AS STRING) || ' | 12% |' || chr(10) || '| beta | $1,200.50 | 50% |' || chr(10) || '| gamma |  | no |' || chr(10) || chr(10)
  || 'As shown in Table 1 and Figure ' || CAST(c_custkey % 3 + 1 AS STRING) || ', rates differ. Visit https://docs' || CAST(c_custkey % 7 AS STRING) || '.example.com/guide?x=1 or section 9.' || chr(10)
  || CASE WHEN c_custkey % 4 = 0 THEN chr(10) || '| region | first | second |' || chr(10) || '|---|---|---|' || chr(10) || '| north | ' || CAST(c_custkey % 11 AS STRING) || ' | 12.5 |' || chr(10) || '| south | yes | $7 |' || chr(10) || '| west |  | 3% |' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 7 = 3 THEN chr(10) || '| path' || chr(92) || 'name | the "id" | small |' || chr(10) || '|---|---|---|' || chr(10) || '| C:' || chr(92) || 'tmp' || chr(9) || 'x | 12345678901234567890 | 0.12345678 |' || chr(10)
      || '| say "hi" | 9007199254740993 | -0.50% |' || chr(10) || '| a ' || chr(92) || 'n b | 007 | 250% |' || chr(10) || chr(10) || 'The Data' || chr(9) || 'Path is a place' || chr(9) || 'that ends in ' || chr(92) || ' or "so" as said.' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 3 = 0 THEN '## Error Handling' || chr(10) || chr(10) || 'The following options are supported:' || chr(10) || '- retry the request' || chr(10) || '* log the error' || chr(10)
      || '-' || chr(10) || 'call support' || chr(10) || '1. Read the message' || chr(10) || '2. Fix the input' || chr(10) ELSE '' END
  || '## Summary' || chr(10) || chr(10) || '**Portal** is the place for all ' || c_mktsegment || ' orders. `accessToken` must be kept secret. ![logo](img/' || CAST(c_custkey AS STRING) || '.png) and [home](https://example.com/home).' AS text
FROM {customer}"""


#: Sections whose contents name the titles of others, in Spark and in DuckDB alike.
MENTIONS = """SELECT c_custkey % 150 AS doc_id, CAST(c_custkey AS INT) AS section_id, c_name AS title, c_mktsegment || ', as for ' || coalesce(lead(c_name) OVER (PARTITION BY c_custkey % 150 ORDER BY c_custkey), 'nobody') || '.' AS content
FROM {customer}"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown corpus. Its rows grow from a few numbers to a document each, so they are spread over as
    many tasks as a shuffle has first; that also puts all rows of a document in one task ever after."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(MARKDOWN, customer=table(spark, sf_dir, "customer").repartition(n, "c_custkey"))


def html_to_markdown(html):
    """Column: page markup to Markdown text."""
    for p, r in ((r"(?is)<(script|style|nav|footer)\b.*?</\1>", ""), (r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\n# $2\n"), (r"(?is)<li[^>]*>(.*?)</li>", "\n- $1"), (r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"), (r"(?is)</p>", "\n"), (r"(?s)<[^>]+>", ""), (r"\n{2,}", "\n")):
        html = F.regexp_replace(html, p, r)
    return F.regexp_replace(html, r"^\s+|\s+$", "")
