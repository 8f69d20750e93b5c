"""Term facts on streams: any split of the sections, restarts, and terms that are closed."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators.sections import sections_from_markdown
from quillspark.operators.terms import section_terms, term_facts
from quillspark.sources.tables import markdown
from quillspark.streaming.terms import newest, term_facts_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sections(spark):
    return sections_from_markdown(markdown(spark, SF).where("doc_id <= 25")).persist()


def written(spark, folder):
    return spark.read.parquet(folder)


def test_equals_the_batch_after_any_split_and_a_restart(spark, sections, tmp_path):
    """Files of shuffled sections, so that a document's sections lie in several batches; half of them come after a stop."""
    shuffled = sections.orderBy(F.xxhash64("doc_id", "section_id")).repartition(6, F.xxhash64("doc_id", "section_id", F.lit(1)))
    shuffled.where("section_id % 2 = 0").write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(sections.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = term_facts_stream(section_terms(stream), None).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
        q = q.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    def check(part):
        want = term_facts(section_terms(part))
        got = newest(spark.read.parquet(f"{tmp_path}/out")).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50

    run()
    check(sections.where("section_id % 2 = 0"))
    shuffled.where("section_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    check(sections)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().count() > 2


def test_idle_terms_are_closed(spark, sections, tmp_path):
    sections.where("doc_id = 1").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sections.schema).parquet(f"{tmp_path}/in")
    q = term_facts_stream(section_terms(stream), "1 second").writeStream.format("memory").queryName("closed_terms").outputMode("update").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        want = term_facts(section_terms(sections.where("doc_id = 1"))).count()
        while time.time() < until and spark.sql("SELECT * FROM closed_terms WHERE closed").count() < want:
            if spark.sql("SELECT * FROM closed_terms").count() >= want:  # another row wakes the stream, whose clock the timeouts go by
                sections.where("doc_id = 2").limit(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(2)
        got = spark.sql("SELECT * FROM closed_terms WHERE closed AND doc_id = 1")
        assert got.select("term").distinct().count() == want
    finally:
        q.stop()
