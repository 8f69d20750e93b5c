"""Terms, concepts and their graph. Terms are found within each section; only sums shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .matching import found_in, meet


def section_terms(sections: DataFrame) -> DataFrame:
    """doc_id, section_id, title, content, small (in lower case), plain (so, blanks run together), told (plain, with a mark before
    each phrase that defines what it follows), term (as written), distinct within a section."""
    c = F.col("content")

    def over(p: str, k: int, cue: str | list[str] | None):
        found = F.filter(T.find_all(c, p), lambda x: F.length(x) > k)
        return found if cue is None else F.when(c.rlike(cue) if isinstance(cue, str) else T.any_of(c, cue), found).otherwise(F.expr("cast(array() as array<string>)"))

    found = [over(*x) for x in zip(map(T.starting, V.TERM_PATTERNS, V.TERM_STARTS), (2, 1, 1, 1, 1, 1, 1, 3), V.TERM_CUES)]
    # what definitions are looked for in first; of the section, as beside explode it would be made for each term
    d = sections.select("doc_id", "section_id", "title", "content", F.lower("content").alias("small"))
    d = d.select("*", F.regexp_replace("small", r"\s+", " ").alias("plain"))
    # found in a step of its own, which is compiled, as a generator's input isn't
    d = d.select("*", F.regexp_replace("plain", DEFINES, T.MARK).alias("told"), F.concat(*found).alias("found"))
    return d.select("*", F.explode(F.array_distinct("found")).alias("term")).drop("found")


def category(term, low: bool = False):
    """low: the term is in lower case already, and isn't lowered again for each word."""
    return T.first_class(term if low else F.lower(term), V.CONCEPTS, F.lit("general"))


#: Where in a plain text a phrase begins that defines what stands before it; and terms in which, or after which, one may begin.
DEFINES, DEFINES_WITHIN = r"(?=[:-]| (?:is |:|-|refers to |means ))", r"[:-]| (?:[irm]|$)"


def definition(content, term, plain, low, told):
    """First of five definitional phrases whose text has 11 to 199 signs. A pattern of the term is made
    only where its phrase stands in the plain text; low: the term as it stands there; told: the plain text with marks, by which
    one search for the term finds whether any phrase follows it."""
    t = F.concat(F.lit(r"(?i)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    def hit(tail: str, *said: str):
        there = reduce(lambda a, b: a | b, [F.contains(plain, F.concat(low, F.lit(w))) for w in said])
        return F.when(there, F.trim(F.call_function("regexp_extract", content, F.concat(t, F.lit(tail)), F.lit(1))))

    hits = F.array(hit(r"\s+is\s+([^\n]+?)\.", " is "), hit(r"\s*:\s*([^\n]+?)\.", ":", " :"), hit(r"\s*-\s*([^\n]+?)\.", "-", " -"), hit(r"\s+refers to\s+([^\n]+?)\.", " refers to "), hit(r"\s+means\s+([^\n]+?)\.", " means "))
    may = F.contains(told, F.concat(low, F.lit(T.MARK))) | low.rlike(DEFINES_WITHIN)
    return F.when(may, F.get(F.filter(hits, lambda c: (F.length(c) > 10) & (F.length(c) < 200)), F.lit(0)))


def occurrences(terms: DataFrame) -> DataFrame:
    """doc_id, term (in lower case), form, section_id, title, ctx (around its first place), def: what each section says of
    a term."""
    d = terms.withColumn("low", F.regexp_replace(F.lower("term"), r"\s+", " "))
    return d.select("doc_id", F.lower("term").alias("term"), F.col("term").alias("form"), "section_id", "title", F.nullif(T.context(F.col("content"), F.col("term"), low=F.col("small")), F.lit("")).alias("ctx"), definition(F.col("content"), F.col("term"), F.col("plain"), F.col("low"), F.col("told")).alias("def"))


def scored(facts: DataFrame) -> DataFrame:
    """Facts with category and score, kept if they score over 2 or come more than once."""
    g = facts.withColumn("category", F.explode(F.array(category(F.col("term"), low=True))))  # generated, else the filter makes it several times again
    bonus = F.when(F.col("category").isin("api_concepts", "security_concepts", "http_concepts"), 3.0).when(F.col("category") != "general", 1.0).otherwise(0.0)
    score = F.least(F.col("frequency") * 0.5, F.lit(5.0)) + F.least(F.col("n_sections") * 1.0, F.lit(5.0)) + bonus + F.when(F.col("n_definitions") > 0, 2.0).otherwise(0.0) + F.when(F.col("n_contexts") > 1, 1.0).otherwise(0.0)
    return g.withColumn("score", score).where((F.col("score") > 2) | (F.col("frequency") > 1))


def term_facts(terms: DataFrame) -> DataFrame:
    """doc_id, term, frequency, n_sections, category, n_contexts, n_definitions, score, definition (of
    the first section that has one), context (the shortest), sections (titles); kept if it scores over
    2 or comes more than once."""
    g = occurrences(terms).groupBy("doc_id", "term").agg(F.collect_list(F.struct("section_id", "form", "title", "ctx", "def")).alias("xs"))  # one buffer a term; each further aggregate would be sorted and merged with it
    each = lambda make: F.array_compact(F.transform("xs", make))
    titles = F.array_distinct(each(lambda x: x["title"]))
    different = lambda xs: F.size(F.array_distinct(xs)).cast("bigint")
    g = g.select(
        "doc_id", "term", F.size("xs").cast("bigint").alias("frequency"), different(each(lambda x: x["title"])).alias("n_sections"), different(each(lambda x: x["ctx"])).alias("n_contexts"), different(each(lambda x: x["def"])).alias("n_definitions"),
        F.array_min(each(lambda x: F.when(x["def"].isNotNull(), F.struct(x["section_id"], x["form"], x["def"].alias("def")))))["def"].alias("definition"),
        F.array_min(each(lambda x: F.when(x["ctx"].isNotNull(), F.struct(F.length(x["ctx"]).alias("n"), x["ctx"].alias("ctx")))))["ctx"].alias("context"),
        F.array_join(F.sort_array(titles), ", ").alias("sections"),
    )
    return scored(g)


def term_scores(terms: DataFrame) -> DataFrame:
    """Term facts without their texts, which Catalyst then leaves out of the sums."""
    return term_facts(terms).drop("definition", "context", "sections")


def cooccurrence(terms: DataFrame) -> DataFrame:
    """term_a < term_b, weight: sections that have both. A section's own sorted term list gives its pairs."""
    lists = terms.groupBy("doc_id", "section_id").agg(F.sort_array(F.collect_set(F.lower("term"))).alias("ts"))
    after = F.transform("ts", lambda t, i: F.struct(t.alias("a"), F.slice("ts", i + 2, F.size("ts")).alias("bs")))
    pairs = lists.select(F.explode(after).alias("p")).select(F.col("p.a").alias("term_a"), F.explode("p.bs").alias("term_b"))
    return pairs.groupBy("term_a", "term_b").agg(F.count(F.lit(1)).alias("weight"))


def contained(scores: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section_id, term: the kept terms of a document that occur in a section, whatever their case."""
    texts = sections.select("doc_id", "section_id", F.lower("content").alias("text"))
    return found_in(texts, scores.select("doc_id", F.col("term").alias("needle")), "section_id").withColumnRenamed("needle", "term")


def document_pairs(occurrences: DataFrame) -> DataFrame:
    """doc_id, term_a < term_b, weight: sections of the document that hold both."""
    lists = occurrences.groupBy("doc_id", "section_id").agg(F.sort_array(F.collect_set("term")).alias("ts"))
    after = F.transform("ts", lambda t, i: F.struct(t.alias("a"), F.slice("ts", i + 2, F.size("ts")).alias("bs")))
    pairs = lists.select("doc_id", F.explode(after).alias("p")).select("doc_id", F.col("p.a").alias("term_a"), F.explode("p.bs").alias("term_b"))
    return pairs.groupBy("doc_id", "term_a", "term_b").agg(F.count(F.lit(1)).alias("weight"))


def category_terms(scores: DataFrame) -> DataFrame:
    """doc_id, category, terms: the set of terms of each category."""
    return scores.groupBy("doc_id", "category").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"))


def section_clusters(terms: DataFrame) -> DataFrame:
    """doc_id, section (its title), terms: the set of terms found in it."""
    return terms.groupBy("doc_id", F.col("title").alias("section")).agg(F.array_join(F.sort_array(F.collect_set(F.lower("term"))), ",").alias("terms"))


def graph_json(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, nodes, links, categories: a document's concept graph as JSON for drawing. Nodes are numbered
    from 0 by term; links have a weight over 1 and name their ends by number, both ways."""
    node = F.struct("term", "category", F.col("score").cast("decimal(10,2)").cast("string").alias("score"), F.col("frequency").cast("string").alias("frequency"))
    g = scores.groupBy("doc_id").agg(F.sort_array(F.collect_list(node)).alias("ns"))
    strong = pairs.where("weight > 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_a", "term_b", "weight"))).alias("es"))
    g = meet(g, strong, ["doc_id"], "left").withColumn("names", F.transform("ns", lambda x: x["term"]))
    nodes = F.transform("ns", lambda x, i: F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "label": '), T.json_text(F.initcap(x["term"])), F.lit(', "category": "'), x["category"], F.lit('", "importance": '), x["score"], F.lit(', "frequency": '), x["frequency"], F.lit("}")))
    at = lambda t: (F.array_position("names", t) - 1).cast("string")
    link = lambda a, b, w: F.concat(F.lit('{"source": '), at(a), F.lit(', "target": '), at(b), F.lit(', "weight": '), w.cast("string"), F.lit("}"))
    kept = F.filter(F.coalesce("es", F.expr("cast(array() as array<struct<term_a: string, term_b: string, weight: bigint>>)")), lambda e: F.array_contains("names", e["term_a"]) & F.array_contains("names", e["term_b"]))
    links = F.flatten(F.transform(kept, lambda e: F.array(link(e["term_a"], e["term_b"], e["weight"]), link(e["term_b"], e["term_a"], e["weight"]))))
    wrap = lambda xs: F.concat(F.lit("["), F.array_join(xs, ", "), F.lit("]"))
    return g.select("doc_id", wrap(nodes).alias("nodes"), wrap(links).alias("links"), F.array_join(F.sort_array(F.array_distinct(F.transform("ns", lambda x: x["category"]))), ",").alias("categories"))


def glossary_json(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, terms, concepts: a document's glossary as JSON, by term and by concept."""
    t = F.concat(F.lit('{"term": '), T.json_text(F.col("term")), F.lit(', "category": "'), "category", F.lit('", "frequency": '), F.col("frequency").cast("string"), F.lit(', "definition": '), T.json_text(F.col("definition")), F.lit("}"))
    a = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", t.alias("j")))).alias("t"))
    c = F.concat(F.lit('{"concept": '), T.json_text(F.col("concept")), F.lit(', "category": "'), "category", F.lit('", "definition": '), T.json_text(F.col("definition")), F.lit("}"))
    b = concepts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("concept", c.alias("j")))).alias("c"))
    wrap = lambda xs: F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(xs, lambda x: x["j"]), ", "), F.lit("")), F.lit("]"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", wrap("t").alias("terms"), wrap("c").alias("concepts"))


def degrees(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.explode(F.array("term_a", "term_b")).alias("term"))
    return both.groupBy("term").agg(F.count(F.lit(1)).alias("degree"))


def graph(scores: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (term, category, score, frequency over all documents) and edges of weight over 1 both ways."""
    v = scores.groupBy("term").agg(F.max("category").alias("category"), F.max("score").alias("score"), F.sum("frequency").alias("frequency"))
    strong = pairs.where("weight > 1")
    e = strong.select(F.explode(F.array(F.struct(F.col("term_a").alias("source"), F.col("term_b").alias("target"), "weight"), F.struct(F.col("term_b").alias("source"), F.col("term_a").alias("target"), "weight"))).alias("e")).select("e.*")
    return v, e


def concept_definitions(sections: DataFrame) -> DataFrame:
    """doc_id, concept, definition, category: header blocks, and bold or code terms with a sentence; the
    last section wins, and within it the later of these three kinds."""
    both = lambda p: F.arrays_zip(T.find_all(F.col("content"), p, 1).alias("n"), T.find_all(F.col("content"), p, 2).alias("d"))
    found = F.concat(both(r"## ([^#\n]+)\n\n([^#]+?)(?=\n#|\z)"), both(r"\*\*([^*]+)\*\*[:\s]*([^.\n]+\.)"), both(r"`([^`]+)`[:\s]*([^.\n]+\.)"))
    d = sections.select("doc_id", "section_id", F.posexplode(found).alias("k", "c"))
    d = d.select("doc_id", "section_id", "k", T.strip(F.col("c.n")).alias("name"), T.strip(F.col("c.d")).alias("definition")).where((F.length("name") < 50) & (F.length("definition") > 10))
    last = d.groupBy("doc_id", F.lower("name").alias("concept")).agg(F.max_by("definition", F.struct("section_id", "k")).alias("definition"))
    return last.select("doc_id", "concept", F.left("definition", F.lit(500)).alias("definition"), category(F.col("concept"), low=True).alias("category"))


def definition_links(scores: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, term, concept: the term occurs in another concept's definition."""
    texts = concepts.select("doc_id", "concept", F.lower("definition").alias("text"))
    hits = found_in(texts, scores.select("doc_id", F.col("term").alias("needle")), "concept")
    return hits.where("needle <> concept").select("doc_id", F.col("needle").alias("term"), "concept")
