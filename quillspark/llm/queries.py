"""The registered queries of the training-data operators, and the SQL of those that SQL can express.

The vocabulary files' places are parameters; by default public_tokenizers.path gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe_count import token_counts
from .common import table
from .decontaminate import decontaminate
from .divergence import audit
from .forest import forest_components
from .langid import identify
from .mixing import mix_sizes
from .neighbours import nearest_neighbours
from .pieces import encode_documents
from .pii import personal_data
from .search import search
from .simhash import simhash_components
from .substrings import dedup_substrings
from .toxicity import toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), file or vocabulary("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_components(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), file or vocabulary("piece_bpe_32k.model"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_counts, op3_toxicity, op4_language_id, op5_neighbours, op6_embedding_dedup, op7_substring_dedup, op8_sentencepiece, op9_pii, op10_mixing, op11_decontamination, op12_search, op13_divergence)}

ORACLES = {
    "op6_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.x = e.vec_id LEFT JOIN links l ON l.x = e.vec_id""",
    "op7_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
shared AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, i FROM win JOIN shared USING (k) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS ps FROM hit, range(0, 50) AS r(j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap,
  (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= cap / weight AS clamped FROM w),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE
  (total - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / sum(weight) FILTER (NOT clamped) OVER () * weight END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
k AS (SELECT doc_id, d.source, size, ('0x' || substr(md5('mix-1:turn:' || doc_id::VARCHAR), 1, 15))::BIGINT AS turn FROM d),
g AS (SELECT source, turn, sum(size)::BIGINT AS among FROM k GROUP BY source, turn),
c AS (SELECT *, coalesce(sum(among) OVER (PARTITION BY source ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN floor(target)::BIGINT - whole * source_size >= before + among THEN size
    WHEN floor(target)::BIGINT - whole * source_size <= before THEN 0
    ELSE size * (floor(target)::BIGINT - whole * source_size - before) // among END)::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.turn = c.turn""",
    "op11_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
t AS MATERIALIZED (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
cf AS (SELECT w, count(*) AS cf FROM t GROUP BY w),
o AS (SELECT k, item_id, o, least(10, len(ws)) AS width, ws FROM b, unnest(range(greatest(1, len(ws) - 9))) AS u(o) WHERE len(ws) > 0),
x AS (SELECT k, item_id, o, width, j, ws[o + j + 1] AS w FROM o, unnest(range(width)) AS u(j)),
a AS (SELECT k, o, (arg_min(j, (cf, j))) AS j, (arg_min(w, (cf, j))) AS w FROM x JOIN cf USING (w) GROUP BY k, o, width HAVING count(*) = width),
c AS (SELECT a.k, a.o, t.k AS dk, t.p - a.j AS lo FROM a JOIN t USING (w)),
h AS (SELECT x.k, x.item_id, x.o, x.width, dk, lo, j, min(abs(p - lo - j)) AS off FROM c JOIN x USING (k, o) JOIN t ON t.k = dk AND t.w = x.w AND p BETWEEN lo + j - 2 AND lo + j + 2 GROUP BY ALL),
m AS (SELECT dk, item_id, lo, width, max(off) = 0 AS exact FROM h GROUP BY k, item_id, o, width, dk, lo HAVING count(*) = any_value(width)),
hit AS (SELECT dk, count(DISTINCT lo + j) AS n FROM m, unnest(range(width)) AS u(j) WHERE exact GROUP BY dk),
it AS (SELECT dk, item_id, bool_or(exact) AS exact FROM m WHERE item_id IS NOT NULL GROUP BY dk, item_id),
l AS (SELECT dk, count(*) FILTER (exact) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) FILTER (exact) AS items, count(*) FILTER (NOT exact) AS near FROM it GROUP BY dk)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(l.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near, 0)::BIGINT AS n_near FROM d LEFT JOIN hit ON hit.dk = d.k LEFT JOIN l ON l.dk = d.k""",
    "op12_search": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0),
tf AS (SELECT k, doc_id, n, w, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*)::BIGINT AS df FROM tf GROUP BY w),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
m AS (SELECT item_id, k, doc_id, sum(floor(1000.0::DOUBLE * ln((2.0::DOUBLE * s.docs + 2.0::DOUBLE) / (2.0::DOUBLE * df + 1.0::DOUBLE)))::BIGINT
  * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * s.docs) // s.terms))))::BIGINT AS score
  FROM i JOIN df USING (w) JOIN tf USING (w), s GROUP BY item_id, k, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, k)::INT AS rank, doc_id, score FROM m WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
vs AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n)::HUGEINT AS whole FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
cs AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cs USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * kept) AS p,
  1 + (1000000000::HUGEINT * (v.n + 2)) // (whole + 2 * kept) AS q
  FROM g JOIN vs USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10""",
}
