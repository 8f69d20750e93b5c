"""Chunks: boundaries, segments, greedy packing with overlap, plans, splitters and payloads.

The packing folds are sequential within one document, so they run in one Arrow pass over documents,
without a shuffle; everything around them is column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..sources.shared import portions

SIZE, OVERLAP = 768, 128
APPROACHES = {"semantic_split": "semantic", "preserve_structure": "structure", "preserve_rows": "rows", "preserve_context": "tokens"}


def boundaries(docs: DataFrame) -> DataFrame:
    """doc_id, position (from 0), family: the first family in order at a position. One Arrow pass, in
    time in proportion to the text."""
    patterns = V.BOUNDARIES

    def run(batches):
        import re

        import pyarrow as pa

        rx = [(n, re.compile(p, re.MULTILINE)) for n, p in patterns]
        for b in batches:
            ids, at, family = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: dict[int, str] = {}
                for name, r in rx:
                    for m in r.finditer(t or ""):
                        found.setdefault(m.start(), name)
                ids += [d] * len(found)
                at += found.keys()
                family += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(at, pa.int32()), pa.array(family, pa.string())], names=["doc_id", "position", "family"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, position int, family string")


def pack(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, page: int = 3000) -> DataFrame:
    """doc_id, chunk_index, content_type, text, n_segments, source_pages of the semantic chunks of each
    document. A chunk's pages are those in which its segments start, in the text before it is cut: by
    docs' column page_lengths where it has one, else pages of `page` signs; a start beyond the last is page 1."""
    patterns, paged = V.BOUNDARIES, "page_lengths" in docs.columns

    def run(batches):
        import re
        from bisect import bisect_right
        from itertools import accumulate

        import pyarrow as pa

        rx = [(n, re.compile(p, re.MULTILINE)) for n, p in patterns]
        count = lambda s: len(s) // 4

        def segments(text):
            marks = sorted(((m.start(), k) for k, (_, r) in enumerate(rx) for m in r.finditer(text)))
            last = 0
            for at, k in marks:
                if at > last:
                    if piece := text[last:at].strip():
                        yield piece, rx[k][0], last
                    last = at
            if piece := text[last:].strip():
                yield piece, "text", last

        def by_words(s):
            held, n = [], 0
            for w in s.split():
                c = count(w + " ")
                if held and n + c > size:
                    yield " ".join(held)
                    held, n = [], 0
                held.append(w)
                n += c
            if held:
                yield " ".join(held)

        def tail(s):
            held, n = [], 0
            for w in reversed(s.split()):
                n += count(w + " ")
                if n > overlap:
                    break
                held.append(w)
            return " ".join(reversed(held))

        def chunks(text, lengths):
            ends = list(accumulate(lengths)) if lengths is not None else None

            def page_of(at):
                if ends is None:
                    return at // page + 1
                k = bisect_right(ends, at)
                return k + 1 if k < len(ends) else 1

            held, n, done, pages = [], 0, 0, set()
            for s, kind, start in segments(text or ""):
                t, own = count(s), page_of(start)
                if n + t <= size:
                    held.append(s)
                    n += t
                    pages.add(own)
                    continue
                before = "\n\n".join(held)
                if held:
                    yield kind, before, len(held), sorted(pages)
                    done += 1
                if t > size:
                    for piece in by_words(s):
                        yield kind, piece, 1, [own]
                        done += 1
                    held, n, pages = [], 0, set()
                    continue
                if done and overlap > 0:
                    end = tail(before)
                    held, n = [end, s], count(end) + t
                else:
                    held, n = [s], t
                pages = {own}
            if held:
                yield "text", "\n\n".join(held), len(held), sorted(pages)

        for b in portions(batches):
            lengths = b.column(2).to_pylist() if paged else [None] * b.num_rows
            rows = [(d, i, *c) for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lengths) for i, c in enumerate(chunks(t, x))]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.list_(pa.int32()))], names=["doc_id", "chunk_index", "content_type", "text", "n_segments", "source_pages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *(["page_lengths"] if paged else [])).mapInArrow(run, f"doc_id {kind}, chunk_index int, content_type string, text string, n_segments int, source_pages array<int>")


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id, token_count, char_count, keywords, quality and flags."""
    return chunks.select(
        "*", F.format_string("%s_chunk_%04d", F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(12)), F.col("chunk_index")).alias("chunk_id"), T.tokens(F.col("text")).alias("token_count"),
        F.length("text").alias("char_count"), T.rag_keywords(F.col("text")).alias("keywords"), T.quality(F.col("text")).alias("quality"), F.contains("text", F.lit("```")).alias("has_code"), F.contains("text", F.lit("|")).alias("has_table"),
    )


def _planned() -> dict:
    n, kind = F.col("token_count"), F.col("section_type")
    fits = F.array_compact(F.array(*[F.when(n <= limit, name) for name, limit in V.TIERS]))
    approach = F.when(kind.isin("api_endpoint", "code_example"), "preserve_structure").when(kind.isin("table", "data"), "preserve_rows").when(n > V.TIERS[-1][1], "semantic_split").otherwise("preserve_context")
    priority = reduce(lambda acc, x: acc.when(kind == x[0], x[1]), list(V.PRIORITIES.items())[1:], F.when(kind == "introduction", 10)).otherwise(4)
    sizes = F.when(n > V.TIERS[-1][1], F.array(*[F.lit(x) for x, _ in V.TIERS[:3]])).otherwise(fits)
    return {"needs_chunking": n > V.TIERS[0][1], "sizes": F.array_join(sizes, ","), "approach": approach, "priority": priority}


def chunk_plan(typed: DataFrame) -> DataFrame:
    """doc_id, section_id, token_count, needs_chunking, sizes, approach, priority."""
    return typed.select("doc_id", "section_id", "section_type", "token_count", *[c.alias(k) for k, c in _planned().items()])


def section_chunks(typed: DataFrame, limit: int = V.TIERS[1][1]) -> DataFrame:
    """doc_id, section_id, title, section_type, priority, part, parts, token_count, size, content: every
    section by its plan, whole or split by its approach, at each planned size that holds the part. A part
    that none of them holds comes at the first size that does, or the largest, so that no text is lost."""
    plan = typed.select("doc_id", "section_id", "title", "section_type", "content", "token_count", *[c.alias(k) for k, c in _planned().items()])
    small = plan.where("not needs_chunking").withColumns({"part": F.lit(1), "parts": F.lit(1)})
    how = F.element_at(F.create_map(*[F.lit(x) for kv in APPROACHES.items() for x in kv]), F.col("approach"))
    cut = split_sections(plan.where("needs_chunking").withColumn("how", how), None, limit, ["title", "section_type", "sizes", "priority"])
    cut = cut.withColumn("token_count", T.tokens(F.col("content")))
    keep = ["doc_id", "section_id", "title", "section_type", "priority", "sizes", "part", "parts", "token_count", "content"]
    both = small.select(*keep).unionByName(cut.select(*keep))
    n = F.col("token_count")
    fits = F.filter(F.split("sizes", ","), lambda x: reduce(lambda a, b: a | b, [(x == name) & (n <= k) for name, k in V.TIERS]))
    first = reduce(lambda acc, x: acc.when(n <= x[1], x[0]), V.TIERS[1:], F.when(n <= V.TIERS[0][1], V.TIERS[0][0])).otherwise(V.TIERS[-1][0])
    return both.withColumn("size", F.explode(F.when(F.size(fits) > 0, fits).otherwise(F.array(first)))).drop("sizes")


def chunk_sizes(plan: DataFrame) -> DataFrame:
    """One row for each planned section and size that holds it, with the model of the size."""
    d = plan.select("doc_id", "section_id", "token_count", F.explode(F.split("sizes", ",")).alias("size"))
    return d.withColumn("model", T.recommend_model(F.col("token_count")))


def manifest(plan: DataFrame) -> DataFrame:
    return plan.groupBy("section_type").agg(F.count(F.lit(1)).alias("sections"), F.sum("token_count").alias("tokens"), F.sum(F.size(F.split("sizes", ","))).alias("chunks"), F.max("priority").alias("priority"))


def split_sections(sections: DataFrame, approach: str | None, limit: int = 7500, keep: list[str] | None = None) -> DataFrame:
    """doc_id, section_id, part, parts, content by `semantic`, `structure`, `rows` or `tokens`, or by each
    row's own column `how` if approach is None; with the columns `keep`."""
    keep = keep or []

    def run(batches):
        import re

        import pyarrow as pa

        count = lambda s: len(s) // 4

        def semantic(s):
            held = ""
            for piece in re.split(r"\n(#{1,6}\s+[^\n]+)", s):
                if not piece.strip():
                    continue
                new = f"{held}\n\n{piece}" if held else piece
                if held and count(new) > limit:
                    yield held.strip()
                    held = piece
                else:
                    held = new
            if held.strip():
                yield held.strip()

        def guarded(s, least, toggles):
            held, size, inside = [], 0, False
            for line in s.split("\n"):
                held.append(line)
                size += len(line) + 1
                inside = (not inside if line.strip().startswith("```") else inside) if toggles else bool(line.strip()) and (inside or "|" in line)
                if not inside and len(held) > least and (size - 1) // 4 > limit:
                    yield "\n".join(held)
                    held, size = [], 0
            if held:
                yield "\n".join(held)

        def tokens(s):
            held, size = [], 0
            for x in (x.strip() for x in re.split(r"[.!?]+\s+", s)):
                if not x:
                    continue
                if held and (size + len(x)) // 4 > limit:
                    yield " ".join(held)
                    held, size = [], 0
                held.append(x)
                size += len(x) + 1
            if held:
                yield " ".join(held)

        ways = {"semantic": semantic, "structure": lambda s: guarded(s, 10, True), "rows": lambda s: guarded(s, 5, False), "tokens": tokens}
        for b in batches:
            parts = [list(ways[how](c or "")) for how, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            at = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            told = [b.column(j).take(at) for j in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*told, pa.array([k + 1 for p in parts for k in range(len(p))], pa.int32()), pa.array([len(p) for p in parts for _ in p], pa.int32()), pa.array([x for p in parts for x in p], pa.string())], names=[*b.schema.names[2:], "part", "parts", "content"])

    d = sections.select(F.lit(approach).alias("how") if approach else F.col("how"), "content", "doc_id", F.col("section_id").cast("int").alias("section_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[2:])
    return d.mapInArrow(run, f"{schema}, part int, parts int, content string")


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, first_page, last_page of packed chunks."""
    return chunks.select("doc_id", "chunk_index", F.array_min("source_pages").alias("first_page"), F.array_max("source_pages").alias("last_page"))


def payload(facts: DataFrame, kind: str) -> DataFrame:
    """One of the five vector-store layouts of chunk facts."""
    pages = F.concat(F.lit("["), F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ", "), F.lit("]"))
    none = F.expr("cast(array() as array<float>)")
    if kind == "pinecone":
        meta = F.struct(F.left("text", F.lit(1000)).alias("text"), "doc_id", pages.alias("pages"), "token_count", F.array_join(F.slice("keywords", 1, 10), ", ").alias("keywords"), F.col("quality").alias("quality_score"))
        return facts.select(F.col("chunk_id").alias("id"), none.alias("values"), meta.alias("metadata"), F.col("doc_id").cast("string").alias("namespace"), F.lit(1536).alias("dimension"))
    if kind == "chromadb":
        meta = F.struct("doc_id", pages.alias("pages"), "token_count", F.array_join("keywords", ", ").alias("keywords"), F.col("quality").alias("quality_score"))
        rows = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text", meta.alias("meta")))).alias("c"))
        pick = lambda f: F.transform("c", lambda x: x[f])
        return rows.select(F.concat(F.lit("pdf_"), F.col("doc_id").cast("string")).alias("collection_name"), pick("chunk_id").alias("ids"), pick("text").alias("documents"), pick("meta").alias("metadatas"))
    if kind == "weaviate":
        own = F.struct(F.col("text").alias("content"), F.col("doc_id").alias("docId"), F.col("source_pages").alias("sourcePages"), F.col("token_count").alias("tokenCount"), "keywords", F.col("quality").alias("qualityScore"), F.col("content_type").alias("contentType"))
        return facts.select(F.lit("DocumentChunk").alias("class"), F.col("chunk_id").alias("id"), own.alias("properties"))
    if kind == "qdrant":
        own = F.struct("chunk_id", "text", "doc_id", F.col("source_pages").alias("pages"), "token_count", "keywords", F.col("quality").alias("quality_score"))
        return facts.select(F.col("chunk_index").alias("id"), none.alias("vector"), own.alias("payload"), F.concat(F.lit("pdf_"), F.col("doc_id").cast("string")).alias("collection_name"))
    if kind != "generic":
        raise ValueError(f"unknown layout: {kind}")
    meta = F.struct("doc_id", "source_pages", "token_count", "char_count", "keywords", F.col("quality").alias("quality_score"), "content_type", "has_code", "has_table")
    rows = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text", meta.alias("metadata")))).alias("chunks"), F.sum("char_count").alias("chars"), F.sum("token_count").alias("tokens"), F.max(F.array_max("source_pages")).alias("pages"))
    return rows.select("doc_id", "chunks", F.struct("pages", "chars", "tokens").alias("document_metadata"), F.size("chunks").alias("total_chunks"), F.lit("1.0").alias("format_version"))
