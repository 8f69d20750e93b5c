"""Which of a document's own words or phrases its texts contain, by one automaton a document.

Needles and texts of a document meet in one task, needles first: an automaton of them is built once and each text is
read once, whatever their number, so time is in proportion to the texts and what is found. A document of
many texts is dealt to several tasks, each with its needles; no text is moved together with all needles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of rows derived from documents. The planner takes them to be as small as the few columns that they were
    made of and would send one side to the driver and to every task; here both are sorted by their keys, and
    rows of one document mostly stand in one task already."""
    return left.join(right.hint("merge"), on, how)


#: Texts of one document in a task, about.
TEXTS = 2000


def found_in(texts: DataFrame, needles: DataFrame, item: str, size: int = TEXTS) -> DataFrame:
    """doc_id, item, needle: each different needle (doc_id, needle) that occurs in a text (doc_id, item, text) of its
    document, at any place, within words too; the empty one occurs in all. Null texts and needles have no match;
    both sides are compared as they are."""
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("doc_id", item)}
    # only documents of several parts are joined, one in `size` texts at most: the rest is neither sorted nor moved for it
    crowded = texts.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("int").alias("_parts")).where("_parts > 1")
    lone, parts = F.lit(None), F.coalesce("_parts", F.lit(1))
    said = needles.where("doc_id is not null and needle is not null").select("doc_id", "needle").distinct().join(crowded, "doc_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    read = texts.where("doc_id is not null and text is not null").join(crowded, "doc_id", "left").withColumn("_part", F.pmod(F.xxhash64(item), parts).cast("int"))
    both = said.select("doc_id", "_part", F.lit(0).alias("_turn"), "needle", lone.cast(kinds[item]).alias(item), lone.cast("string").alias("text"))
    both = both.unionByName(read.select("doc_id", "_part", F.lit(1).alias("_turn"), lone.cast("string").alias("needle"), item, "text"))
    dealt = both.repartition("doc_id", "_part").sortWithinPartitions("doc_id", "_part", "_turn")

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        now, held, machine, empty = None, [], None, False
        for b in batches:
            ids, parts, turns, own, items, bodies = (b.column(k).to_pylist() for k in range(6))
            at, hit = [], []
            for k, (d, part, turn) in enumerate(zip(ids, parts, turns)):
                if (d, part) != now:
                    now, held, machine = (d, part), [], None
                if turn == 0:
                    held.append(own[k])
                    continue
                if machine is None:
                    machine, empty = ahocorasick.Automaton(), "" in held
                    for w in held:
                        if w:
                            machine.add_word(w, w)
                    machine.make_automaton()
                got = {w for _, w in machine.iter(bodies[k])} if len(machine) else set()
                got |= {""} if empty else set()
                at += [k] * len(got)
                hit += got
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(4).take(take), pa.array(hit, pa.string())], names=["doc_id", item, "needle"])

    return dealt.mapInArrow(run, f"doc_id {kinds['doc_id']}, `{item}` {kinds[item]}, needle string")
