"""SQL of queries that build on others: graphs, links, glossaries, chunk files, payloads."""

from __future__ import annotations

from ..functions import vocab as V
from .oracle_reports import title


def sql(known: dict[str, str]) -> dict[str, str]:
    from .oracle import LINES, MD, SEC, TYPED, first_class, model, q, sentences, strip, tokens

    nl, two = "chr(10)", "chr(10) || chr(10)"
    facts = f"facts AS (SELECT * FROM ({known['term_scores']}) JOIN ({known['term_facts']}) USING (doc_id, term))"
    scores = f"scores AS ({known['term_scores']})"
    inside = f"{scores}, {SEC}, hit AS (SELECT sec.doc_id, section_id, term FROM sec JOIN scores ON scores.doc_id = sec.doc_id AND contains(lower(content), term))"
    pairs = f"{inside}, pair AS (SELECT a.doc_id, a.term AS term_a, b.term AS term_b, count(*) AS weight FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.section_id = b.section_id AND a.term < b.term GROUP BY ALL)"
    json = lambda c: f"to_json(({c})::VARCHAR)::VARCHAR"
    kinds = [r"## ([^#\n]+)\n\n([^#]+?)(?:\n#|\z)", r"\*\*([^*]+)\*\*[:\s]*([^.\n]+\.)", r"`([^`]+)`[:\s]*([^.\n]+\.)"]
    found = " UNION ALL ".join(f"SELECT doc_id, section_id, {k} AS fam, i, n[i] AS n, d[i] AS d FROM (SELECT doc_id, section_id, regexp_extract_all(content, {q(p)}, 1) AS n, regexp_extract_all(content, {q(p)}, 2) AS d FROM sec), unnest(range(1, len(n) + 1)) AS t(i)" for k, p in enumerate(kinds))
    concepts = f"""{SEC}, found AS ({found}), c AS (SELECT doc_id, section_id, fam, i, {strip('n')} AS name, {strip('d')} AS definition FROM found),
concept AS (SELECT doc_id, lower(name) AS concept, left(arg_max(definition, section_id * 1000000 + fam * 100000 + i), 500) AS definition FROM c WHERE length(name) < 50 AND length(definition) > 10 GROUP BY 1, 2),
concepts AS (SELECT *, {first_class('concept', V.CONCEPTS, q('general'))} AS category FROM concept)"""
    rank = "CASE type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in (("section", 0), ("page", 1), ("figure", 2), ("table", 3), ("concept", 4), ("url", 5), ("api", 6))) + " END"
    links = f"""found AS (SELECT doc_id, section_id, type, text, target FROM ({known['refs_resolved']}) UNION ALL SELECT doc_id, section_id, type, text, target FROM ({known['references']}) WHERE type = 'url'),
ranked AS (SELECT doc_id, text, CASE WHEN type = 'url' THEN '[' || text || '](' || target || ')' ELSE '[' || text || '](#' || type || '-' || target || ')' END AS link, row_number() OVER (PARTITION BY doc_id, text ORDER BY {rank} DESC, section_id DESC, target DESC) AS p FROM found),
links AS (SELECT doc_id, text, link FROM ranked WHERE p = 1)"""
    folder, name = "regexp_extract(path, '([^/]+)/[^/]+$', 1)", "regexp_extract(path, '([^/]+)$', 1)"
    named = {"summaries": "summaries", "concepts": "concepts", "tables": "tables", "chunked": "chunks", "references": "references", "sections": "sections"}
    category = "CASE " + " ".join(f"WHEN {folder} = {q(k)} THEN {q(v)}" for k, v in named.items()) + f" WHEN {name} LIKE '%-metadata.json' OR {name} = 'README.md' THEN 'metadata' ELSE 'main_documents' END"
    files = f"files AS (SELECT doc_id, path, body FROM ({known['section_files']}) UNION ALL SELECT doc_id, path, body FROM ({known['table_files']})), filed AS (SELECT *, {category} AS category FROM files)"
    shown = lambda a: f"array_to_string(list_transform({a}, lambda x: '- [' || regexp_extract(x, '([^/]+)$', 1) || '](' || x || ')'), {nl})"
    definition = f"CASE WHEN definition IS NOT NULL THEN 'Meaning: ' || definition || {nl} ELSE '' END"
    high = f"""'### ' || {title('term')} || {nl} || 'Class: ' || {title('category')} || {nl} || 'Found: ' || frequency || ' times' || {nl} || 'In: ' || sections || {nl} || {definition} || CASE WHEN context IS NOT NULL THEN 'Where: ...' || context || '...' || {nl} ELSE '' END"""
    safe = "regexp_replace(category, '[^a-z_]', '', 'g')"
    plan = f"plan AS ({known['chunk_plan']}), tier(size, k) AS (VALUES " + ", ".join(f"({q(n)}, {k})" for n, k in V.TIERS) + "), ch AS (SELECT p.doc_id, p.section_id, t.title, p.section_type, p.priority, 1 AS part, 1 AS parts, p.token_count, tier.size, t.content FROM plan p JOIN typed t USING (doc_id, section_id) JOIN tier ON p.token_count <= tier.k)"
    # every document of the Markdown corpus fits one chunk: its segments, stripped, one paragraph each
    marks = " UNION ALL ".join(f"SELECT doc_id, regexp_extract_all(text, {q(p)}) AS h, regexp_split_to_array(text, {q(p)}) AS s FROM md" for p in [r"\n\n[A-Z]" if n == "paragraph" else p for n, p in V.BOUNDARIES])
    chunk = f"""{MD}, e AS ({marks}), spot AS (SELECT DISTINCT doc_id, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS pos FROM e, unnest(range(1, len(h) + 1)) AS t(i)),
cuts AS (SELECT doc_id, pos FROM spot WHERE pos > 0 UNION SELECT doc_id, 0 FROM md), seg AS (SELECT doc_id, pos, {strip("substr(text, (pos + 1)::BIGINT, (coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) - pos)::BIGINT)")} AS s FROM cuts JOIN md USING (doc_id)),
one AS (SELECT doc_id, string_agg(s, {two} ORDER BY pos) AS text FROM seg WHERE s <> '' GROUP BY 1),
f AS (SELECT o.doc_id, text, left(md5(o.doc_id::VARCHAR), 12) || '_chunk_0000' AS chunk_id, {tokens('text')}::BIGINT AS token_count, length(text)::INT AS char_count, [1]::INT[] AS source_pages, kw, quality FROM one o JOIN kws USING (doc_id) JOIN quals USING (doc_id))"""
    one = lambda cond, v: f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0::DOUBLE END"
    t = strip("text")
    n_of = lambda p: f"len(regexp_extract_all(text, {q(p)}))"
    kws = f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(V.TECH_WORDS)})\\b'), lambda x: upper(x)), list_filter(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda x: length(x) > 3))))[1:20]"
    quality = f"""greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + {one('length(text) > 100', 0.1)} + {one(f"regexp_matches({t}, '[.!?]$')", 0.1)} + {one(f"regexp_matches({t}, '^[A-Z]')", 0.1)} + {one(n_of('[.]') + ' > 1', 0.1)} + {one("regexp_matches(text, '\\b(?:def|class|function|import|return)\\b')", 0.1)} - {one('length(text) < 50', 0.2)} - {one(n_of(chr(10)) + ' / greatest(length(text), 1) > 0.3', 0.1)}))"""
    chunk = chunk.replace("\nf AS (SELECT", f"\nkws AS (SELECT doc_id, {kws} AS kw FROM one), quals AS (SELECT doc_id, {quality} AS quality FROM one),\nf AS (SELECT")
    # the packer on whole documents: segments in order, one after the other; over-long ones by words; what chunks overlap with
    every = " UNION ALL ".join(f"SELECT doc_id, {q(n)} AS kind, {k} AS k, regexp_extract_all(text, {q(p)}) AS h, regexp_split_to_array(text, {q(p)}) AS s FROM documents" for k, (n, p) in enumerate((n, r"\n\n[A-Z]" if n == "paragraph" else p) for n, p in V.BOUNDARIES))
    tail = lambda c: f"(SELECT array_to_string(w[len(w) - len(list_filter(range(1, len(w) + 1), lambda j: list_sum(list_transform(w[len(w) - j + 1:], lambda z: (length(z) + 1) // 4)) <= 128)) + 1:], ' ') FROM (SELECT regexp_split_to_array({strip(c)}, '\\s+') AS w))"
    packed = f"""e AS ({every}), spot AS (SELECT doc_id, kind, k, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS pos FROM e, unnest(range(1, len(h) + 1)) AS t(i)),
mark AS (SELECT doc_id, pos, arg_min(kind, k) AS kind FROM spot WHERE pos > 0 GROUP BY 1, 2), cuts AS (SELECT doc_id, pos FROM mark UNION SELECT doc_id, 0 FROM documents),
part AS (SELECT doc_id, pos, {strip("substr(text, (pos + 1)::BIGINT, (coalesce(lead(pos) OVER w, length(text)) - pos)::BIGINT)")} AS s, lead(pos) OVER w AS upto FROM cuts JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
seg AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS i, s, length(s) // 4 AS t, coalesce(m.kind, 'text') AS kind, (p.pos // 3000 + 1)::INT AS page FROM part p LEFT JOIN mark m ON m.doc_id = p.doc_id AND m.pos = p.upto WHERE s <> ''),
fold AS (SELECT doc_id, 0::BIGINT AS i, '' AS held, 0::BIGINT AS n, 0::BIGINT AS k, []::INT[] AS pages, ''::VARCHAR AS e_kind, ''::VARCHAR AS e_text, 0::BIGINT AS e_k, []::INT[] AS e_pages, false AS big FROM documents UNION ALL
  SELECT doc_id, i, CASE WHEN fits THEN CASE WHEN k > 0 THEN held || {two} || s ELSE s END WHEN big THEN '' ELSE over || {two} || s END, CASE WHEN fits THEN n + t WHEN big THEN 0 ELSE length(over) // 4 + t END, CASE WHEN fits THEN k + 1 WHEN big THEN 0 ELSE 2 END,
    CASE WHEN fits THEN list_append(pages, page) WHEN big THEN []::INT[] ELSE [page] END, kind, CASE WHEN fits THEN '' ELSE held END, CASE WHEN fits THEN 0 ELSE k END, CASE WHEN fits THEN []::INT[] ELSE pages END, big
  FROM (SELECT f.doc_id, x.i, held, n, k, pages, x.s, x.t, x.kind, x.page, n + x.t <= 768 AS fits, x.t > 768 AS big, CASE WHEN n + x.t > 768 AND x.t <= 768 THEN {tail('held')} ELSE '' END AS over FROM fold f JOIN seg x ON x.doc_id = f.doc_id AND x.i = f.i + 1)),
word AS (SELECT doc_id, i, regexp_split_to_array(s, '\\s+') AS ws FROM seg WHERE t > 768), sums AS (SELECT doc_id, i, ws, list(c ORDER BY j) AS ps FROM (SELECT doc_id, i, ws, j, sum((length(ws[j]) + 1) // 4) OVER (PARTITION BY doc_id, i ORDER BY j) AS c FROM word, unnest(range(1, len(ws) + 1)) AS u(j)) GROUP BY doc_id, i, ws),
piece AS (SELECT doc_id, i, ws, ps, 1::BIGINT AS p, 1::BIGINT AS a, greatest(2, len(list_filter(ps, lambda v: v <= 768)) + 1)::BIGINT AS b FROM sums UNION ALL
  SELECT doc_id, i, ws, ps, p + 1, b, greatest(b + 1, len(list_filter(ps, lambda v: v <= ps[b - 1] + 768)) + 1)::BIGINT FROM piece WHERE b <= len(ws)),
told AS (SELECT doc_id, i, 0::BIGINT AS p, e_kind AS content_type, e_text AS text, e_k AS n_segments, e_pages AS pages FROM fold WHERE e_k > 0 UNION ALL
  SELECT piece.doc_id, i, p, kind, array_to_string(ws[a:b - 1], ' '), 1, [page] FROM piece JOIN seg USING (doc_id, i) UNION ALL
  SELECT doc_id, i + 1, 0, 'text', held, k, pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM fold) WHERE r = 1 AND k > 0),
chunk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, p) - 1)::INT AS chunk_index, content_type, text, n_segments::INT AS n_segments, list_sort(list_distinct(pages)) AS source_pages FROM told)"""
    # a word's end is told by letters of all scripts: those beyond ASCII count as letters of no class
    mask = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g')"
    masked = lambda x: x.replace("regexp_extract_all(text, '(?i)\\b", f"regexp_extract_all({mask}, '(?i)\\b").replace("regexp_extract_all(text, '\\b[A-Z]", f"regexp_extract_all({mask}, '\\b[A-Z]").replace("regexp_matches(text, '\\b", f"regexp_matches({mask}, '\\b")
    out = {
        "rag_chunks": f"WITH RECURSIVE {packed} SELECT *, left(md5(doc_id::VARCHAR), 12) || '_chunk_' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id, {tokens('text')}::BIGINT AS token_count, length(text)::INT AS char_count, {masked(kws)} AS keywords, {masked(quality)} AS quality, contains(text, '```') AS has_code, contains(text, '|') AS has_table FROM chunk",
        "chunk_pages": f"WITH RECURSIVE {packed} SELECT doc_id, chunk_index, list_min(source_pages) AS first_page, list_max(source_pages) AS last_page FROM chunk",
        "chunk_embeddings": f"WITH RECURSIVE {packed} SELECT doc_id, left(md5(doc_id::VARCHAR), 12) || '_chunk_' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id, embedding FROM chunk LEFT JOIN embeddings ON vec_id = doc_id",
        "term_in_section": f"WITH {inside} SELECT * FROM hit",
        "document_pairs": f"WITH {pairs} SELECT * FROM pair",
        "category_terms": f"WITH {scores} SELECT doc_id, category, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM scores GROUP BY 1, 2",
        "section_clusters": f"WITH term AS ({known['terms']}), {SEC} SELECT doc_id, title AS section, string_agg(DISTINCT lower(term), ',' ORDER BY lower(term)) AS terms FROM term JOIN sec USING (doc_id, section_id) GROUP BY 1, 2",
        "term_graph_nodes": f"WITH {scores} SELECT term, max(category) AS category, max(score) AS score, sum(frequency)::BIGINT AS frequency FROM scores GROUP BY 1",
        "graph_json": f"""WITH {pairs}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term) - 1 AS i FROM scores), nj AS (SELECT doc_id, string_agg('{{"id": ' || i || ', "label": ' || {json(title('term'))} || ', "category": "' || category || '", "importance": ' || score::DECIMAL(10, 2)::VARCHAR || ', "frequency": ' || frequency || '}}', ', ' ORDER BY i) AS nodes, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM n GROUP BY 1),
          ej AS (SELECT pair.doc_id, string_agg('{{"source": ' || a.i || ', "target": ' || b.i || ', "weight": ' || weight || '}}, {{"source": ' || b.i || ', "target": ' || a.i || ', "weight": ' || weight || '}}', ', ' ORDER BY term_a, term_b) AS links FROM pair JOIN n a ON a.doc_id = pair.doc_id AND a.term = term_a JOIN n b ON b.doc_id = pair.doc_id AND b.term = term_b WHERE weight > 1 GROUP BY 1)
          SELECT doc_id, '[' || nodes || ']' AS nodes, '[' || coalesce(links, '') || ']' AS links, categories FROM nj LEFT JOIN ej USING (doc_id)""",
        "concept_defs": f"WITH {concepts} SELECT doc_id, concept, definition, category FROM concepts",
        "definition_links": f"WITH {concepts}, {scores} SELECT s.doc_id, term, concept FROM scores s JOIN concepts c ON c.doc_id = s.doc_id AND term <> concept AND contains(lower(definition), term)",
        "glossary_json": f"""WITH {facts}, {concepts}, a AS (SELECT doc_id, string_agg('{{"term": ' || {json('term')} || ', "category": "' || category || '", "frequency": ' || frequency || ', "definition": ' || coalesce({json('definition')}, 'null') || '}}', ', ' ORDER BY term) AS t FROM facts GROUP BY 1),
          b AS (SELECT doc_id, string_agg('{{"concept": ' || {json('concept')} || ', "category": "' || category || '", "definition": ' || {json('definition')} || '}}', ', ' ORDER BY concept) AS c FROM concepts GROUP BY 1) SELECT doc_id, '[' || coalesce(t, '') || ']' AS terms, '[' || coalesce(c, '') || ']' AS concepts FROM a FULL JOIN b USING (doc_id)""",
        "concept_map_md": f"""WITH {pairs}, deg AS (SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, term_a AS term FROM pair UNION ALL SELECT doc_id, term_b FROM pair) GROUP BY ALL), dr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, term) AS r FROM deg),
          a AS (SELECT doc_id, string_agg('- **' || {title('term')} || '**: ' || k || ' neighbours', {nl} ORDER BY r) AS a FROM dr WHERE r <= 10 GROUP BY 1), pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term_a, term_b) AS r FROM pair WHERE weight > 2),
          b AS (SELECT doc_id, string_agg('- **' || {title('term_a')} || '** with **' || {title('term_b')} || '** (together ' || weight || ' times)', {nl} ORDER BY r) AS b FROM pr WHERE r <= 15 GROUP BY 1), ct AS (SELECT doc_id, category, list(term ORDER BY term) AS ts FROM scores GROUP BY ALL),
          c AS (SELECT doc_id, string_agg('### ' || {title('category')} || {nl} || 'Terms: ' || len(ts) || {nl} || 'First: ' || array_to_string(ts[1:5], ', ') || {nl}, {nl} ORDER BY category) AS c FROM ct WHERE len(ts) > 1 GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM scores GROUP BY 1)
          SELECT doc_id, 'concepts/concept-map.md' AS path, '# Terms and their company' || {two} || 'Terms: ' || n || {two} || '## Most neighbours' || {two} || coalesce(a, '') || {two} || '## Classes' || {two} || coalesce(c, '') || {two} || '## Often together' || {two} || coalesce(b, '') AS body FROM n LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "glossary_md": f"""WITH {facts}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM facts WHERE score >= 5), hh AS (SELECT doc_id, string_agg({high}, {nl} ORDER BY r) AS high FROM h WHERE r <= 20 GROUP BY 1),
          b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY frequency DESC, term) AS r FROM facts WHERE category <> 'general'), bb AS (SELECT doc_id, category, string_agg('- **' || {title('term')} || '** (' || frequency || 'x)' || coalesce(': ' || left(definition, 100) || '...', ''), {nl} ORDER BY r) AS b FROM b WHERE r <= 10 GROUP BY 1, 2),
          c AS (SELECT doc_id, string_agg('## Of class ' || {title('category')} || {two} || b || {nl}, {nl} ORDER BY category) AS by_ FROM bb GROUP BY 1), n AS (SELECT doc_id, count(*) AS n, count(DISTINCT category) AS k FROM facts GROUP BY 1)
          SELECT doc_id, 'concepts/glossary.md' AS path, '# Terms of this document' || {two} || 'Terms: ' || n || {nl} || 'Classes: ' || k || {two} || '## Weightiest' || {two} || coalesce(high, '') || {nl} || coalesce(by_, '') AS body FROM n LEFT JOIN hh USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "category_glossaries": f"""WITH {facts}, g AS (SELECT doc_id, category, count(*) AS n, string_agg('### ' || {title('term')} || {nl} || 'Found: ' || frequency || {nl} || 'Weight: ' || format('{{:.1f}}', score) || {nl} || {definition} || CASE WHEN context IS NOT NULL THEN 'Where: ' || left(context, 100) || '...' || {nl} ELSE '' END, {nl} ORDER BY score DESC, term) AS b FROM facts GROUP BY 1, 2)
          SELECT doc_id, 'concepts/categories/' || {safe} || '-glossary.md' AS path, '# Terms of class ' || {title('category')} || {two} || 'Terms: ' || n || {two} || '## All of them' || {two} || b AS body FROM g WHERE n >= 3""",
        "refs_concepts": f"WITH {scores} SELECT r.doc_id, section_id, text, target, category FROM ({known['references']}) r JOIN scores s ON s.doc_id = r.doc_id AND s.term = r.target WHERE type = 'concept'",
        "link_map": f"WITH {links} SELECT * FROM links",
        "xref_links": f"WITH {links} SELECT doc_id, 'references/link-mapping.md' AS path, '# Words and their links' || {two} || '## All (' || count(*) || ')' || {two} || string_agg('Words: `' || text || '`' || {nl} || 'Link: `' || link || '`' || {nl}, {nl} ORDER BY text) AS body FROM links GROUP BY 1",
        "section_chunks": f"WITH {TYPED}, {plan} SELECT * FROM ch",
        "chunk_manifest_md": f"""WITH {TYPED}, {plan}, k AS (SELECT doc_id, section_id, title, token_count, priority, count(*) AS k FROM ch GROUP BY ALL) SELECT doc_id, 'chunked/chunk-manifest.md' AS path, '# Chunks of this document' || {two} || 'Sections: ' || count(*) || {nl} || 'Chunks: ' || sum(k) || {two} || '| No. | Begins | Tokens | Files |' || {nl} || '|---|---|---|---|' || {nl}
          || string_agg('| ' || section_id || ' | ' || left(title, 30) || '... | ' || token_count || ' | ' || k || ' |', {nl} ORDER BY priority DESC, section_id) AS body FROM k GROUP BY 1""",
        "document_readme": f"WITH m AS ({known['document_map']}), c AS ({known['consolidated_summary']}) SELECT doc_id, 'README.md' AS path, '# Map of the document' || {two} || summary || {two} || '## Sections' || {two} || map || {nl} AS body FROM m JOIN c USING (doc_id)",
        "analyze": f"WITH s AS ({known['document_stats'].replace('FROM md', 'FROM documents').replace('WITH ' + MD + ' ', '')}) SELECT s.*, document_type FROM s JOIN ({known['doc_structure_documents']}) USING (doc_id)",
        "master_index": f"""WITH {files}, g AS (SELECT doc_id, category, list(path ORDER BY path) AS p FROM filed GROUP BY 1, 2), l AS (SELECT doc_id, category, '### ' || {title('category')} || ' (' || len(p) || ' files)' || {two} || CASE WHEN len(p) <= 10 THEN {shown('p')} ELSE {shown('p[1:5]')} || {nl} || '- ... (' || (len(p) - 8) || ' others)' || {nl} || {shown('p[-3:]')} END || {nl} AS b FROM g)
          SELECT doc_id, 'README.md' AS path, '# What came of this document' || {two} || '## Files by kind' || {two} || string_agg(b, {nl} ORDER BY category) AS body FROM l GROUP BY 1""",
        "conversion_metadata": f"""WITH {files}, g AS (SELECT doc_id, category, count(*) AS f, sum(length(body)) AS n, sum({tokens('body')}) AS k FROM filed GROUP BY 1, 2) SELECT doc_id, 'conversion-metadata.json' AS path, '{{"total_files": ' || sum(f) || ', "categories": {{' || string_agg('"' || category || '": {{"files": ' || f || ', "characters": ' || n || ', "tokens": ' || k || '}}', ', ' ORDER BY category) || '}}}}' AS body FROM g GROUP BY 1""",
        "field_response": f"""WITH f AS ({known['fields_structured']}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, rule, name) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM f) SELECT doc_id, 'Fields (' || any_value(n) || ' in all)' || {nl} || string_agg(i || '. ' || name || ' (' || type || '): ' || left(content, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END, {nl} ORDER BY i) FILTER (i <= 20)
          || CASE WHEN any_value(n) > 20 THEN {nl} || 'and ' || (any_value(n) - 20) || ' others' ELSE '' END AS response FROM r GROUP BY 1""",
        "fmt_pinecone": f"WITH {chunk} SELECT chunk_id AS id, '[]' AS values, to_json({{'text': left(text, 1000), 'doc_id': doc_id, 'pages': '[1]', 'token_count': token_count, 'keywords': array_to_string(kw[1:10], ', '), 'quality_score': quality}})::VARCHAR AS metadata, doc_id::VARCHAR AS namespace, 1536 AS dimension FROM f",
        "fmt_chromadb": f"WITH {chunk} SELECT 'pdf_' || doc_id AS collection_name, to_json([chunk_id])::VARCHAR AS ids, to_json([text])::VARCHAR AS documents, to_json([{{'doc_id': doc_id, 'pages': '[1]', 'token_count': token_count, 'keywords': array_to_string(kw, ', '), 'quality_score': quality}}])::VARCHAR AS metadatas FROM f",
        "fmt_weaviate": f"WITH {chunk} SELECT 'DocumentChunk' AS class, chunk_id AS id, to_json({{'content': text, 'docId': doc_id, 'sourcePages': source_pages, 'tokenCount': token_count, 'keywords': kw, 'qualityScore': quality, 'contentType': 'text'}})::VARCHAR AS properties FROM f",
        "fmt_qdrant": f"WITH {chunk} SELECT 0::INT AS id, '[]' AS vector, to_json({{'chunk_id': chunk_id, 'text': text, 'doc_id': doc_id, 'pages': source_pages, 'token_count': token_count, 'keywords': kw, 'quality_score': quality}})::VARCHAR AS payload, 'pdf_' || doc_id AS collection_name FROM f",
        "fmt_generic": f"WITH {chunk} SELECT doc_id, to_json([{{'chunk_index': 0::INT, 'chunk_id': chunk_id, 'text': text, 'metadata': {{'doc_id': doc_id, 'source_pages': source_pages, 'token_count': token_count, 'char_count': char_count, 'keywords': kw, 'quality_score': quality, 'content_type': 'text', 'has_code': contains(text, '```'), 'has_table': contains(text, '|')}}}}])::VARCHAR AS chunks, to_json({{'pages': 1::INT, 'chars': char_count::BIGINT, 'tokens': token_count}})::VARCHAR AS document_metadata, 1::INT AS total_chunks, '1.0' AS format_version FROM f",
    }
    # greedy folds over sentences, lines or pieces, one after the other: recursion within each document
    def fold(source: str, pieces: str, start: str, state: dict[str, tuple[str, str]], full: str, result: str, where: str = "true") -> str:
        """state: name -> (value of the first piece, value after the next piece x); full: whether a part ends
        before x; the last row of a part holds it."""
        first = ", ".join(f"{v[0]} AS {k}" for k, v in state.items())
        after = ", ".join(f"{v[1]} AS {k}" for k, v in state.items())
        return f"""WITH RECURSIVE {start}d AS (SELECT doc_id, {pieces} AS ps FROM {source} WHERE {where}), fold AS (SELECT doc_id, ps, 1::BIGINT AS i, 1::BIGINT AS part, {first} FROM (SELECT *, ps[1] AS x FROM d WHERE len(ps) > 0) UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN part + 1 ELSE part END, {after} FROM (SELECT *, {full} AS full_ FROM (SELECT *, ps[i + 1] AS x FROM fold WHERE i < len(ps)))),
parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY i DESC) AS p FROM fold) SELECT doc_id, 1::INT AS section_id, part::INT AS part, {result} AS content FROM parts WHERE p = 1"""

    held = lambda sep: ("x", f"CASE WHEN full_ THEN x ELSE held || {sep} || x END")
    grown = lambda n: (f"{n}::BIGINT", f"(CASE WHEN full_ THEN 0 ELSE size END + {n})::BIGINT")
    out["split_tokens"] = fold("documents", sentences("text"), "", {"held": held("' '"), "size": grown("length(x) + 1")}, "(size + length(x)) // 4 > 500", "held")
    fence, pipe = f"starts_with({strip('x')}, '```')", f"{strip('x')} <> ''"
    lines_of = f"string_split(text, {nl})"
    counted = {"held": held(nl), "size": grown("length(x) + 1"), "k": ("1::BIGINT", "(CASE WHEN full_ THEN 0 ELSE k END + 1)::BIGINT")}
    out["split_structure"] = fold("documents", lines_of, "", counted | {"inside": (fence, f"CASE WHEN {fence} THEN NOT inside ELSE inside END")}, "NOT inside AND k > 10 AND (size - 1) // 4 > 500", "held")
    out["split_rows"] = fold("documents", lines_of, "", counted | {"inside": (f"{pipe} AND contains(x, '|')", f"{pipe} AND (inside OR contains(x, '|'))")}, "NOT inside AND k > 5 AND (size - 1) // 4 > 500", "held")
    marked = f"list_filter(string_split(regexp_replace(text, '\\n(#{{1,6}}\\s+[^\\n]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda v: {strip('v')} <> '')"
    out["split_semantic"] = fold("md", marked, f"{MD}, ", {"held": held(two)}, f"length(held || {two} || x) // 4 > 60", strip("held"))
    large = fold("documents", lines_of, "", {"held": held(nl), "size": (f"{tokens('x')}::BIGINT", f"(CASE WHEN full_ THEN 50 ELSE size END + {tokens('x')})::BIGINT")}, f"size + {tokens('x')} > 800", f"{nl} || '(part ' || part || ')' || {nl} || '---' || {nl} || {nl} || held", f"{tokens('text')} > 1000")
    out["split_32k"] = f"{large} UNION ALL SELECT doc_id, 1::INT, 1::INT, text FROM documents WHERE {tokens('text')} <= 1000"
    known = known | out
    parts = ["section_files", "word_navigation", "chunk_files", "chunk_manifest_md", "xref_internal", "xref_external", "xref_broken", "xref_links", "table_files", "tables_index", "image_catalog", "glossary_md", "category_glossaries", "concept_map_md", "summary_files", "summary_index"]
    everything = " UNION ALL ".join(f"SELECT doc_id, path, body FROM ({known[p]})" for p in parts)
    out["convert"] = out["master_index"].replace(files, f"files AS MATERIALIZED ({everything}), filed AS (SELECT *, {category} AS category FROM files)") + " UNION ALL SELECT doc_id, path, body FROM files"
    out["outline_flat"] = """SELECT r AS doc_id, (row_number() OVER (PARTITION BY r ORDER BY n, s NULLS FIRST) - 1)::INT AS ord, title, level FROM (
  SELECT n_regionkey AS r, n_nationkey AS n, NULL AS s, n_name AS title, 1::INT AS level FROM nation UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, s_name, 2::INT FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
    pages = "p AS (SELECT doc_id, (pos // 3000 + 1)::INT AS page_num, substr(text, pos + 1, 3000) AS page_text FROM documents, unnest(range(0, length(text), 3000)) AS t(pos))"
    entries = "SELECT doc_id, (page_num - 1)::INT AS ord, 'Page ' || page_num AS title, 1::INT AS level, CASE WHEN page_num % 5 = 4 THEN 9999 ELSE page_num END::INT AS page_num FROM p WHERE page_num % 2 = 0"
    outline = f"{pages}, o AS ({entries})"
    out["sections_outline"] = f"WITH {outline} SELECT o.doc_id, (ord + 1)::INT AS section_id, title, coalesce(page_text, '') AS content, level, o.page_num FROM o LEFT JOIN p ON p.doc_id = o.doc_id AND p.page_num = o.page_num"
    short = f"{pages}, o AS (SELECT * FROM ({entries}) WHERE doc_id % 2 = 0), own AS (SELECT o.doc_id, (ord + 1)::INT AS section_id, title, coalesce(page_text, '') AS content, level FROM o LEFT JOIN p ON p.doc_id = o.doc_id AND p.page_num = o.page_num), several AS (SELECT doc_id FROM own GROUP BY 1 HAVING count(*) > 1)"
    at = "(least(9000, length(text) - pos) + 2999) // 3000"
    out["sections_chosen"] = f"""WITH {short}, {SEC} SELECT doc_id + 100000000 AS doc_id, section_id, title, content, level FROM sec UNION ALL SELECT own.* FROM own SEMI JOIN several USING (doc_id) UNION ALL
SELECT doc_id, (pos // 9000 + 1)::INT, 'Section ' || (pos // 9000 + 1) || CASE WHEN {at} = 1 THEN ' (Page ' || (pos // 3000 + 1) || ')' ELSE ' (Pages ' || (pos // 3000 + 1) || '-' || (pos // 3000 + {at}) || ')' END, substr(text, pos + 1, 9000), 1::INT
FROM (SELECT * FROM documents ANTI JOIN several USING (doc_id)), unnest(range(0, length(text), 9000)) AS t(pos)"""
    return out
