"""One automaton a document: the same rows as a search for each needle, in linear time, documents dealt out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators.matching import found_in
from quillspark.operators.sections import related_by_mention


@pytest.mark.parametrize("size", [2000, 3])
def test_equals_a_search_for_each(spark, size):
    r = random.Random(size)
    word = lambda n: "".join(r.choice("abé漢😀 .*") for _ in range(n))
    texts = [(r.choice([1, 2, 3, None, 7]), k, r.choice([word(r.randint(0, 30)), None, ""])) for k in range(200)]
    needles = [(r.choice([1, 2, 3, None, 8]), r.choice([word(r.randint(1, 3)), "", None, "ab", "a"])) for _ in range(80)]
    t = spark.createDataFrame(texts, "doc_id int, item int, text string")
    n = spark.createDataFrame(needles, "doc_id int, needle string")
    want = {(d, k, w) for d, k, x in texts for e, w in needles if d is not None and d == e and x is not None and w is not None and w in x}
    got = [tuple(x) for x in found_in(t, n, "item", size).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert found_in(t.where("false"), n, "item").count() == 0 == found_in(t, n.where("false"), "item").count()


def test_mentions_of_equal_and_empty_titles(spark):
    rows = [(1, 1, "Alpha", "see beta"), (1, 2, "Beta", "x"), (1, 3, "BETA", "alphabet"), (2, 1, "", "q"), (2, 2, "z", "w"), (3, 1, "a", None)]
    got = {tuple(x) for x in related_by_mention(spark.createDataFrame(rows, "doc_id int, section_id int, title string, content string")).collect()}
    want = set()
    for d, i, _, c in rows:
        for e, j, t, _ in rows:
            if d == e and i != j and c is not None and t.lower() in c.lower():
                want |= {(d, i, j), (d, j, i)}
    assert got == want


def test_a_document_of_ten_thousand_sections(spark):
    """Twice the sections with twice the needles take about twice the time, not four times; and no row holds all needles."""
    def timed(n):
        texts = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("item"), F.concat(F.lit("section about term"), F.col("id"), F.lit(" and term"), (F.col("id") * 7) % n, F.lit(". "), F.repeat(F.lit("filler words here "), 20)).alias("text"))
        needles = spark.range(n).select(F.lit(1).alias("doc_id"), F.concat(F.lit("term"), F.col("id"), F.lit(".")).alias("needle")).unionByName(spark.range(n).select(F.lit(1).alias("doc_id"), F.concat(F.lit("term"), F.col("id"), F.lit(" and")).alias("needle")))
        began = time.perf_counter()
        assert found_in(texts, needles, "item").count() == 2 * n
        return time.perf_counter() - began

    timed(1000)
    small, large = timed(10_000), timed(40_000)
    assert large < 10 * small + 2
