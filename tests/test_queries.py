"""Every query of the library proper against its SQL, and the sources, sinks and streams."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.operators.chunks import chunk_facts, pack, payload
from quillspark.operators.lines import document_structure
from quillspark.operators.sections import section_files, sections_from_markdown, with_types
from quillspark.plans import registry
from quillspark.sources import sinks
from quillspark.sources.tables import html_to_markdown, markdown, parse_documents, read_binary, read_documents, table
from quillspark.streaming import events

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.execute(registry.oracles()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == columns
    got = sorted(repr([plain(x[c]) for c in columns]) for x in df.collect())
    assert got == sorted(repr([plain(x[at.index(c)]) for c in columns]) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.queries()) <= set(entry.queries())


def test_files(spark, tmp_path):
    typed = with_types(sections_from_markdown(markdown(spark, SF).limit(3)))
    sinks.write_text(section_files(typed), f"{tmp_path}/sections")
    assert len(list(tmp_path.glob("sections/doc_id=*/*.txt"))) == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\ntext")
    (tmp_path / "in/b.bin").write_bytes(b"\xff\xfe")
    d = read_documents(spark, f"{tmp_path}/in").collect()
    assert len(d) == 1 and d[0]["text"] == "# A\ntext" and d[0]["bytes"] == 8
    p = parse_documents(read_binary(spark, f"{tmp_path}/in", "bin"), lambda b: b.decode("ascii")).collect()
    assert p[0]["text"] is None and p[0]["error"]
    facts = chunk_facts(pack(table(spark, SF, "documents").limit(5)))
    sinks.write_rag(facts, payload(facts, "qdrant"), f"{tmp_path}/rag", "qdrant")
    assert spark.read.json(f"{tmp_path}/rag/metadata").collect()[0]["documents"] == 5


def test_every_chunk_has_its_embedding(spark):
    v = {r["vec_id"]: r["embedding"] for r in table(spark, SF, "embeddings").collect()}
    want = sorted((r["doc_id"], r["chunk_id"], tuple(v[r["doc_id"]]) if r["doc_id"] in v else None) for r in chunk_facts(pack(table(spark, SF, "documents"))).collect())
    got = sorted((r["doc_id"], r["chunk_id"], tuple(r["embedding"]) if r["embedding"] else None) for r in registry.queries()["chunk_embeddings"](spark, SF).collect())
    assert got == want and len(want) > len({w[0] for w in want})


def test_html(spark):
    r = spark.createDataFrame([("<nav>x</nav><h2>T</h2><p>a <a href=\"u\">b</a></p><ul><li>c</li></ul>",), (None,)], "h string").select(html_to_markdown(__import__("pyspark.sql.functions", fromlist=["col"]).col("h")).alias("r")).collect()
    assert r[0]["r"] == "# T\na [b](u)\n- c" and r[1]["r"] is None


def test_streams_equal_tables(spark, tmp_path):
    table(spark, SF, "documents").limit(20).write.parquet(f"{tmp_path}/docs")
    stream = events.stream_table(spark, f"{tmp_path}/docs", table(spark, SF, "documents").schema)
    q = events.run_batches(stream, document_structure, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = document_structure(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    table(spark, SF, "events").write.parquet(f"{tmp_path}/events")
    s = events.hourly(events.stream_table(spark, f"{tmp_path}/events", table(spark, SF, "events").schema))
    q = s.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.sql("SELECT * FROM hourly").collect())) == sorted(map(str, events.hourly(table(spark, SF, "events")).collect()))
