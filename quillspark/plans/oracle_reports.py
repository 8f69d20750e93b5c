"""SQL of the analyses and reports."""

from __future__ import annotations

from ..functions import vocab as V


def title(c: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def sql() -> dict[str, str]:
    from .oracle import KNOWN, MD, REFS, SAFE_CUT, SEC, TERMS, TYPED, any_of, count, first_class, model, q, sentences, strip, tokens

    nl = "chr(10)"
    # the definition's five phrases around a term that differs from row to row
    hit = lambda tail: f"trim(regexp_extract(content, '(?i)' || regexp_escape(term) || {q(tail)}, 1))"
    defs = "coalesce(" + ", ".join(f"CASE WHEN length({hit(p)}) BETWEEN 11 AND 199 THEN {hit(p)} END" for p in (r"\s+is\s+([^\n]+?)\.", r"\s*:\s*([^\n]+?)\.", r"\s*-\s*([^\n]+?)\.", r"\s+refers to\s+([^\n]+?)\.", r"\s+means\s+([^\n]+?)\.")) + ")"
    pos = "instr(lower(content), lower(term))"
    ctx = f"regexp_replace({strip(f'substr(content, greatest(1, {pos} - 50), least(length(content), {pos} + length(term) + 49) - greatest(1, {pos} - 50) + 1)')}, '\\s+', ' ', 'g')"
    facts = f"""{TERMS}, occ AS (SELECT doc_id, lower(term) AS t, term AS form, section_id, title, nullif({ctx}, '') AS ctx, {defs} AS def FROM term),
tg AS (SELECT doc_id, t AS term, count(*) AS frequency, count(DISTINCT title) AS n_sections, count(DISTINCT ctx) AS n_contexts, count(DISTINCT def) AS n_definitions,
  first(def ORDER BY section_id, form) FILTER (def IS NOT NULL) AS definition, first(ctx ORDER BY length(ctx), ctx) FILTER (ctx IS NOT NULL) AS context, string_agg(DISTINCT title, ', ' ORDER BY title) AS sections FROM occ GROUP BY 1, 2),
tc AS (SELECT *, {first_class('term', V.CONCEPTS, q('general'))} AS category FROM tg),
facts AS (SELECT * FROM (SELECT *, least(frequency * 0.5::DOUBLE, 5::DOUBLE) + least(n_sections::DOUBLE, 5::DOUBLE) + CASE WHEN category IN ('api_concepts', 'security_concepts', 'http_concepts') THEN 3::DOUBLE WHEN category <> 'general' THEN 1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN n_definitions > 0 THEN 2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN n_contexts > 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM tc) WHERE score > 2 OR frequency > 1)"""
    rank = "CASE category " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.CATEGORY_PRIORITIES.items()) + " ELSE 3 END"
    tables = rf"""{MD}, runs AS (SELECT doc_id, regexp_extract_all(chr(10) || text || chr(10), '(?:\n[^\n]*[|][^\n]*){{3,}}') AS rs FROM md),
tab AS (SELECT doc_id, i::INT AS table_no, rs[i][2:] AS markdown, ({count('rs[i][2:]', chr(10))} - 1)::INT AS n_rows, ({count("string_split(rs[i][2:], chr(10))[1]", '[|]')} - 1)::INT AS n_cols FROM runs, unnest(range(1, len(rs) + 1)) AS t(i))"""
    after = lambda p: f"list_transform(regexp_extract_all(content, {q(p)}, 1), lambda m: {strip('m')})"
    inner = f"array_to_string(string_split(b, {nl})[2:-2], {nl})"
    example = "list_concat(list_concat(list_transform(list_filter(regexp_extract_all(content, '```[\\s\\S]*?```')[1:2], lambda b: len(string_split(b, chr(10))) > 2), lambda b: 'Code: ' || left(" + inner + ", 200) || '...')"
    for k, p in enumerate(V.EXAMPLE_PATTERNS):
        example += f", list_transform({after(p)}[1:2], lambda m: 'For instance: ' || left(m, 150) || '...'))"
    http = r"(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w\-{}.:]+)"
    detail = f"""list_concat(list_concat(list_transform(range(1, least(3, len(m)) + 1), lambda i: '**' || m[i] || '** `' || p[i] || '`'), list_transform(a[1:2], lambda x: 'Takes: ' || left(x, 100))), list_transform(r[1:1], lambda x: 'Gives: ' || left(x, 100)))"""
    # trimming as the column function has it: 0.9 of the proportional size, back to a late full stop
    size = lambda t: f"floor({t}::DOUBLE * (length(b)::DOUBLE / {tokens('b')}) * 0.9::DOUBLE)::INT"
    trim = lambda t: f"CASE WHEN {tokens('b')} <= {t} THEN b ELSE (SELECT CASE WHEN length(z) < length(b) THEN z || '...' ELSE z END FROM (SELECT CASE WHEN contains(c, '.') AND length(c) - instr(reverse(c), '.') > n * 0.8::DOUBLE THEN left(c, length(c) - instr(reverse(c), '.') + 1) ELSE c END AS z FROM (SELECT left(b, {size(t)}) AS c, {size(t)} AS n))) END"
    brief = f"list_concat(s[1:2], CASE WHEN len(s) > 3 THEN list_filter(s[3:6], lambda x: {any_of('lower(x)', V.BRIEF_WORDS)})[1:1] ELSE [] END)"
    last = "CASE WHEN len(s) > 6 THEN s[-2:] ELSE [] END"
    long = f"list_concat(list_concat(s[1:3], {last}), list_filter(CASE WHEN len(s) > 5 THEN s[4:len(s) - 2] ELSE [] END, lambda x: {any_of('lower(x)', V.DETAIL_WORDS)})[1:CASE WHEN len(s) > 6 THEN 3 ELSE 5 END])"
    summary = lambda name, keep, t: f"WITH {SEC}, s AS (SELECT doc_id, section_id, {sentences('content')} AS s FROM sec), k AS (SELECT doc_id, section_id, len(s) AS n, array_to_string({keep}, ' ') AS b FROM s) SELECT doc_id, section_id, CASE WHEN n > 0 THEN {trim(t)} ELSE 'This section is empty.' END AS {name} FROM k"
    listed = "(" + " OR ".join(f"regexp_matches(line, {q(p)})" for p in V.STRUCTURE_LISTS) + ")"
    numbered = "(" + " OR ".join(f"regexp_matches(line, {q(p)})" for p in V.STRUCTURE_SECTIONS) + ")"
    cased = r"(upper(s) = s AND lower(s) <> s OR regexp_matches(s, '^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$'))"
    from .oracle import LINES

    file = lambda path, body, src: f"SELECT doc_id, {path} AS path, {body} AS body FROM {src}"
    agg = lambda line, order: f"string_agg({line}, {nl} ORDER BY {order})"
    method = "upper(regexp_extract(text, '(?i)^(GET|POST|PUT|DELETE|PATCH)\\s', 1))"
    domain = "regexp_extract(target, '^https?://([^/?#]+)', 1)"
    notes = "list_filter([CASE size " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.SIZE_NOTES) + " END, CASE section_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.TYPE_NOTES) + f" END, CASE WHEN token_count < 1000 THEN {q(V.TOKEN_NOTES[0])} WHEN token_count > 5000 THEN {q(V.TOKEN_NOTES[1])} END], lambda x: x IS NOT NULL)"
    from .oracle import PAIRS

    priority = "CASE section_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.PRIORITIES.items()) + " ELSE 4 END"
    tier = ", ".join(f"({q(n)}, {k})" for n, k in V.TIERS)
    two = "lpad(section_id::VARCHAR, 2, '0')"
    return {
        "term_scores": f"WITH {facts} SELECT doc_id, term, frequency, n_sections, n_contexts, n_definitions, category, score FROM facts",
        "term_facts": f"WITH {facts} SELECT doc_id, term, definition, context, sections FROM facts",
        "priority_concepts": f"WITH {facts}, p AS (SELECT doc_id, term, (least(frequency * 2, 20) + {rank} + CASE WHEN length(definition) > 50 THEN 5 WHEN length(definition) > 20 THEN 2 ELSE 0 END)::BIGINT AS priority FROM facts) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, term)::INT AS rank FROM p) WHERE rank <= 15",
        "category_ranks": f"WITH {facts} SELECT doc_id, category, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY score DESC, term)::INT AS rank, count(*) OVER (PARTITION BY doc_id, category) AS k FROM facts) WHERE k >= 3",
        "glossary_top": f"WITH {facts} SELECT doc_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INT AS rank FROM facts WHERE score >= 5) WHERE rank <= 20",
        "category_top": f"WITH {facts}, n AS (SELECT category, term, sum(frequency)::BIGINT AS n FROM facts GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term)::INT AS rank FROM n) WHERE rank <= 10",
        "tables_text": f"WITH {tables} SELECT * FROM tab",
        "important_tables": f"WITH {tables}, v AS (SELECT doc_id, table_no, CASE WHEN n_rows BETWEEN 3 AND 10 AND n_cols BETWEEN 2 AND 6 THEN 8 WHEN n_rows > 0 AND n_cols > 0 THEN 3 ELSE 0 END + CASE WHEN {any_of('lower(markdown)', V.TABLE_WORDS)} THEN 6 ELSE 0 END AS score FROM tab) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_no)::INT AS rank FROM v) WHERE rank <= 5",
        "section_examples": f"WITH {SEC} SELECT doc_id, section_id, {example} AS section_examples FROM sec",
        "technical_details": f"WITH {SEC}, x AS (SELECT doc_id, section_id, regexp_extract_all(content, {q(http)}, 1) AS m, regexp_extract_all(content, {q(http)}, 2) AS p, {after(V.PARAMETER_PATTERN)} AS a, {after(V.RESPONSE_PATTERN)} AS r, {sentences('content')}[1:2] AS s FROM sec), y AS (SELECT *, {detail} AS d FROM x) SELECT doc_id, section_id, CASE WHEN len(d) > 0 THEN array_to_string(d, chr(10)) WHEN len(s) > 0 THEN array_to_string(s, ' ') ELSE 'Nothing technical here.' END AS technical_details FROM y",
        "summary_brief": summary("summary_brief", brief, 40),
        "summary_detailed": summary("summary_detailed", long, 200),
        "top_connected": f"WITH {PAIRS} SELECT t AS term, count(*) AS degree FROM (SELECT term_a AS t FROM pair UNION ALL SELECT term_b FROM pair) GROUP BY 1 ORDER BY degree DESC, term LIMIT 10",
        "strong_pairs": f"WITH {PAIRS} SELECT * FROM pair WHERE weight > 2 ORDER BY weight DESC, term_a, term_b LIMIT 15",
        "structure_sections": f"WITH {LINES.format('documents')}, h AS (SELECT doc_id, line_no, s, {numbered} AS num, s <> '' AND length(s) < 60 AND {cased} AND NOT starts_with(s, '•') AND NOT {listed} AS head FROM line), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY line_no) AS r FROM h WHERE num OR head) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS ord, s AS section FROM k WHERE num OR r = 1",
        "field_context": f"WITH {MD}, {LINES.format('md')}, n AS (SELECT doc_id, line_no, array_to_string(list_filter(list_transform(l[greatest(1, line_no - 1):line_no + 3], lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS context FROM line WHERE contains(s, ':')) SELECT *, trim(nullif(regexp_extract(context, '(\\d+\\.\\d+\\s+[A-Z][^:]+)', 1), '')) AS section FROM n",
        "document_stats": f"WITH {MD} SELECT doc_id, length(text)::INT AS total_characters, {count('text', chr(92) + 'S+')}::INT AS total_words, {count('text', '(?m)^#{1,6}[ ' + chr(92) + 't]+' + chr(92) + 'S')}::INT AS total_headers, len(regexp_extract_all(chr(10) || text || chr(10), '(?:\\n[^\\n]*[|][^\\n]*){{3,}}'))::INT AS total_tables, len(regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)'))::INT AS total_images, {any_of('lower(left(text, 1000))', V.TOC_WORDS)} AS has_toc, greatest(1, length(text) // 3000)::INT AS estimated_pages, regexp_matches(text, '(?m)^#{{1,6}}\\s+') AS has_headers, regexp_matches(text, '(?m)^[*\\-+]\\s+') AS has_lists, contains(text, '```') AS has_code_blocks FROM md",
        "page_offsets": "WITH p AS (SELECT doc_id, (pos // 3000 + 1)::INT AS page_num, length(substr(text, pos + 1, 3000)) AS n FROM documents, unnest(range(0, length(text), 3000)) AS t(pos)) SELECT doc_id, page_num, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS \"end\" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)",
        "xref_internal": f"WITH {KNOWN}, ok AS (SELECT n.doc_id, n.section_id, n.type, n.text, n.target FROM numbered n JOIN known USING (doc_id, type, number)), c AS (SELECT doc_id, {agg(f'''{chr(39)}- **{chr(39)} || {title('type')} || ': ' || k || ' resolved{chr(39)}''', 'type')} AS b FROM (SELECT doc_id, type, count(*) AS k FROM ok GROUP BY 1, 2) GROUP BY 1), r AS (SELECT doc_id, count(*) AS k, {agg(chr(39) + '| §' + chr(39) + ' || section_id || ' + chr(39) + ' | §' + chr(39) + ' || target || ' + chr(39) + ' | ' + chr(39) + ' || text || ' + chr(39) + ' |' + chr(39), 'section_id, target, text')} AS b FROM ok WHERE type = 'section' GROUP BY 1) "
        + file("'references/internal-references.md'", f"'# References within the document' || {nl} || {nl} || '## Counts' || {nl} || {nl} || c.b || coalesce({nl} || {nl} || '### To sections (' || r.k || ')' || {nl} || {nl} || '| From | To | Words |' || {nl} || '|---|---|---|' || {nl} || r.b, '')", "c LEFT JOIN r USING (doc_id)"),
        "xref_external": f"WITH {REFS}, l AS (SELECT doc_id, type, section_id, CASE WHEN type = 'url' THEN '| ' || target || ' | ' || {domain} || ' | §' || section_id || ' |' ELSE '| ' || CASE WHEN {method} = '' THEN '–' ELSE {method} END || ' | ' || target || ' | §' || section_id || ' |' END AS line FROM refs WHERE type IN ('url', 'api')), g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'url') AS u, string_agg(line, {nl} ORDER BY section_id, line) FILTER (type = 'url') AS ub, string_agg(line, {nl} ORDER BY section_id, line) FILTER (type = 'api') AS ab FROM l GROUP BY 1) "
        + file("'references/external-references.md'", f"'# References to other places' || {nl} || {nl} || '- All: ' || n || {nl} || '- Web addresses: ' || u || {nl} || '- Interface paths: ' || (n - u) || {nl} || {nl} || '## Web addresses' || {nl} || {nl} || '| Address | Host | From |' || {nl} || '|---|---|---|' || {nl} || coalesce(ub, '') || {nl} || {nl} || '## Interface paths' || {nl} || {nl} || '| Call | Path | From |' || {nl} || '|---|---|---|' || {nl} || coalesce(ab, '')", "g"),
        "xref_broken": f"WITH {KNOWN}, l AS (SELECT doc_id, section_id, '| ' || type || ' | ' || text || ' | §' || section_id || ' | ' || upper(type[1]) || type[2:] || ' ' || target || ' not found |' AS line FROM missing), g AS (SELECT doc_id, count(*) AS n, {agg('line', 'section_id, line')} AS b FROM l GROUP BY 1) "
        + file("'references/broken-references.md'", f"'# References without a target' || {nl} || {nl} || '- All: ' || n || {nl} || {nl} || '| Family | Words | From | Why |' || {nl} || '|---|---|---|---|' || {nl} || b", "g"),
        "table_files": f"WITH {tables} " + file("'tables/table-' || lpad(table_no::VARCHAR, 3, '0') || '.md'", f"'# Table ' || table_no || {nl} || {nl} || 'Size: ' || n_rows || ' rows by ' || n_cols || ' columns' || {nl} || {nl} || markdown", "tab"),
        "tables_index": f"WITH {tables}, g AS (SELECT doc_id, count(*) AS n, sum(n_rows) AS r, sum(n_cols) AS c, sum({tokens('markdown')}) AS t, string_agg('- [Table ' || table_no || '](table-' || lpad(table_no::VARCHAR, 3, '0') || '.md) - ' || n_rows || ' rows by ' || n_cols || ' columns', {nl} ORDER BY table_no) AS b FROM tab GROUP BY 1) "
        + file("'tables/tables-index.md'", f"'# Tables of this document' || {nl} || {nl} || 'Tables: ' || n || {nl} || 'In all: ' || r || ' rows, ' || c || ' columns' || {nl} || 'Tokens: ' || t || {nl} || {nl} || b", "g"),
        "chunk_files": f"WITH {TYPED}, tier(size, k) AS (VALUES {tier}), c AS (SELECT typed.*, size, {notes} AS notes FROM typed, tier WHERE token_count <= k) "
        + file(f"'chunked/' || {two} || '-' || {SAFE_CUT('title')} || '-' || size || '.md'", f"'# ' || title || {nl} || {nl} || 'Part: 1 of 1' || {nl} || 'Tier: ' || size || ' (' || token_count || ' tokens)' || {nl} || 'Kind: ' || section_type || {nl} || 'Rank: ' || {priority} || {nl} || 'Fits: ' || {model('token_count')} || {nl} || {nl} || '---' || {nl} || {nl} || CASE WHEN len(notes) > 0 THEN '## Advice' || {nl} || {nl} || array_to_string(list_transform(notes, lambda x: '- ' || x), {nl}) || {nl} || {nl} || '---' || {nl} || {nl} ELSE '' END || content", "c"),
        "word_sections": f"WITH {SEC} " + file(f"'sections/' || {two} || '-' || {SAFE_CUT('title')} || '.md'", f"'# ' || title || {nl} || {nl} || 'Kind: ' || {first_class('lower(title)', V.WORD_SECTION_TITLES, q('content'))} || {nl} || 'Depth: ' || level || {nl} || 'Tokens: ' || {tokens('content')} || {nl} || 'Minutes to read: ' || greatest(1, {tokens('content')} // 250) || {nl} || {nl} || '---' || {nl} || {nl} || content", "sec"),
        "word_navigation": f"WITH {SEC}, g AS (SELECT doc_id, count(*) AS n, string_agg(repeat('  ', level - 1) || '- **[' || title || '](sections/' || {two} || '-' || {SAFE_CUT('title')} || '.md)**' || {nl} || repeat('  ', level - 1) || '  Begins: ' || {strip('left(content, 200)')} || CASE WHEN length(content) > 200 THEN '...' ELSE '' END || {nl}, {nl} ORDER BY section_id) AS b FROM sec GROUP BY 1) "
        + file("'structure-overview.md'", f"'# Way through the document' || {nl} || {nl} || 'Sections: ' || n || {nl} || {nl} || '---' || {nl} || {nl} || '## Sections in order' || {nl} || {nl} || b", "g"),
        "image_catalog": f"WITH {MD}, a AS (SELECT doc_id, regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS a, regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS u FROM md), i AS (SELECT doc_id, unnest(a) AS alt, unnest(u) AS url FROM a), g AS (SELECT doc_id, count(*) AS n, string_agg('- Says: ' || alt || {nl} || '- File: ' || url || {nl}, {nl} ORDER BY url, alt) AS b FROM i GROUP BY 1) "
        + file("'images/image-catalog.md'", f"'# Pictures' || {nl} || {nl} || 'Pictures: ' || n || {nl} || {nl} || b", "g"),
    }


def points(s: str, detailed: bool = False) -> str:
    from .oracle import any_of

    last = f"CASE WHEN len({s}) > 6 THEN {s}[-2:] ELSE [] END"
    if detailed:
        keep = f"list_concat(list_concat({s}[1:3], {last}), list_filter(CASE WHEN len({s}) > 5 THEN {s}[4:len({s}) - 2] ELSE [] END, lambda x: {any_of('lower(x)', V.DETAIL_WORDS)})[1:CASE WHEN len({s}) > 6 THEN 3 ELSE 5 END])"
    else:
        keep = f"list_concat({s}[1:2], CASE WHEN len({s}) > 3 THEN list_filter({s}[3:6], lambda x: {any_of('lower(x)', V.BRIEF_WORDS)})[1:1] ELSE [] END)"
    return f"CASE WHEN len({s}) > 0 THEN array_to_string({keep}, ' ') END"


def summaries(known: dict[str, str]) -> dict[str, str]:
    """The seven summaries, from the queries that they are made of."""
    from .oracle import ENDPOINTS, TYPED, any_of, q, sentences, tokens, trimmed

    nl, two = "chr(10)", "chr(10) || chr(10)"
    cut = lambda c, t: f"coalesce({trimmed(c, t)}, 'This section is empty.')"
    kind, depth = title("document_type"), title("depth")
    head = f"'# Section by section' || {two} || 'A ' || {kind} || ' in ' || {title('structure_type')} || ' form, of ' || n || ' sections.' || {two} || '## What each says' || {two}"
    top = f"'# The whole in short' || {two} || '## What it is' || {two} || 'Kind: ' || {kind} || {nl} || 'Depth: ' || {depth} || {nl} || 'Themes: ' || coalesce(themes, '') || {nl} || 'Sections: ' || n || {two} || '## All sections' || {two}"
    agg = lambda line, where="true", order="section_id": f"string_agg({line}, '' ORDER BY {order}) FILTER ({where})"
    missing = "CASE k " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.SUMMARY_MISSING.items()) + " END"
    own = f"""WITH {TYPED}, {ENDPOINTS}, dt AS ({known['document_type_vote']}), dp AS ({known['technical_depth']}), st AS ({known['structure_type']}),
th AS (SELECT doc_id, string_agg(theme, ', ' ORDER BY rank) AS themes, string_agg(theme, ', ' ORDER BY rank) FILTER (rank <= 3) AS three FROM ({known['themes']}) GROUP BY 1),
ky AS (SELECT doc_id, string_agg('- **' || title || '**: ' || sentence || {nl}, '' ORDER BY rank) AS keys FROM ({known['key_sections']}) JOIN ({known['key_sentence']}) USING (doc_id, section_id) JOIN typed USING (doc_id, section_id) WHERE rank <= 3 GROUP BY 1),
co AS (SELECT doc_id, string_agg('- **' || term || '**' || coalesce(': ' || CASE WHEN length(definition) > 100 THEN left(definition, 100) || '...' ELSE nullif(definition, '') END, '') || {nl}, '' ORDER BY rank) AS concepts FROM ({known['priority_concepts']}) JOIN ({known['term_facts']}) USING (doc_id, term) WHERE rank <= 5 GROUP BY 1),
ta AS (SELECT doc_id, string_agg('**Table ' || table_no || '** (' || n_rows || ' rows)' || {nl} || left(markdown, 500) || CASE WHEN length(markdown) > 500 THEN '...' ELSE '' END || {two}, '' ORDER BY rank) AS tables FROM ({known['important_tables']}) JOIN ({known['tables_text']}) USING (doc_id, table_no) WHERE rank <= 3 GROUP BY 1),
d AS (SELECT *, {head} AS head, {top} AS top FROM (SELECT doc_id, count(*) AS n FROM typed GROUP BY 1) JOIN dt USING (doc_id) JOIN dp USING (doc_id) JOIN st USING (doc_id) LEFT JOIN th USING (doc_id) LEFT JOIN ky USING (doc_id) LEFT JOIN co USING (doc_id) LEFT JOIN ta USING (doc_id)),
x AS (SELECT doc_id, section_id, title, section_type, content, {sentences('content')} AS ss, row_number() OVER (PARTITION BY doc_id ORDER BY section_id) AS i, head, top, n,
  {any_of('lower(title)', V.SECURITY_TITLES)} AS whole, {any_of('lower(content)', V.SECURITY_CONTENT)} AS may, contains(lower(title), 'api') OR section_type = 'api_endpoint' AS api, {any_of('lower(title)', V.INTEGRATION_TITLES)} AS step,
  section_examples[1:2] AS ex, technical_details, security, steps FROM typed JOIN d USING (doc_id) JOIN ({known['section_examples']}) USING (doc_id, section_id) JOIN ({known['technical_details']}) USING (doc_id, section_id)
  LEFT JOIN ({known['security_sentences']}) USING (doc_id, section_id) LEFT JOIN ({known['integration_steps']}) USING (doc_id, section_id)),
y AS (SELECT *, {points('ss')} AS brief, {points('ss', True)} AS full_, least(200, (2000 - {tokens('head')}) // n) AS share, (8000 - {tokens('top')}) // n AS part,
  CASE WHEN whole THEN ss WHEN may AND security IS NOT NULL THEN {sentences('security')} END AS se FROM x),
e AS (SELECT doc_id, count(*) AS calls, string_agg('| ' || method || ' | ' || path || ' | ' || left(description, 100) || ' |' || {nl}, '' ORDER BY j) FILTER (j <= 20) AS lines
  FROM (SELECT endpoint.*, row_number() OVER (PARTITION BY endpoint.doc_id ORDER BY endpoint.section_id, endpoint.i) AS j FROM endpoint JOIN x USING (doc_id, section_id) WHERE api) GROUP BY 1),
z AS (SELECT doc_id, {agg(f"'### ' || i || '. ' || title || {two} || {cut('brief', 'share')} || {two} || CASE WHEN section_type <> 'content' THEN '*Kind: ' || {title('section_type')} || '*' || {two} ELSE '' END")} AS detailed,
  {agg(f"'### ' || i || '. ' || title || {two} || {cut('full_', 'part')} || {two} || CASE WHEN len(ex) > 0 THEN 'Examples:' || {nl} || array_to_string(list_transform(ex, lambda v: '- ' || v || {nl}), '') || {nl} ELSE '' END")} AS complete,
  {agg(f"'### ' || title || {nl} || 'Kind: ' || {title('section_type')} || {nl} || technical_details || {two}", f"section_type IN ({', '.join(map(q, V.TECHNICAL_TYPES))})")} AS technical,
  {agg(f"'### ' || title || {nl} || {cut('brief', '150')} || {two}", 'api')} AS api,
  count(*) FILTER (se IS NOT NULL) AS k, {agg(f"'## ' || CASE WHEN whole THEN title ELSE lower(title) END || {nl} || {cut(points('se'), '200')} || {two}", 'se IS NOT NULL')} AS security,
  {agg(f"'## ' || title || {nl} || coalesce(steps, array_to_string(list_transform(list_filter(ss[1:5], lambda v: length(v) > 30)[1:4], lambda v: '- ' || v), {nl})) || {two}", 'step')} AS steps FROM y GROUP BY 1),
body AS (SELECT d.doc_id, '## At a glance' || {two} || 'A ' || {kind} || ' ' || coalesce('on ' || three || '.', 'of mixed content.') || {two} || '## Main sections' || {two} || keys
  || CASE WHEN depth <> 'unknown' THEN {two} || '## Depth' || {two} || {depth} ELSE '' END || coalesce({two} || '## Main terms' || {two} || concepts, '') AS executive,
  head || detailed AS detailed, top || complete || coalesce('## Main tables' || {two} || tables, '') AS complete, '# Technical side' || {two} || '## How deep' || {two} || 'Depth: ' || {depth} || {two} || coalesce('## Where' || {two} || technical, '') AS technical,
  '# The interface' || {two} || coalesce('## Calls (' || calls || ')' || {two} || '| Call | Path | What it does |' || {nl} || '|---|---|---|' || {nl} || lines, '') || {nl} || '## Sections on it' || {two} || api AS api,
  '# Security' || {two} || k || ' sections speak of it.' || {two} || security AS security, '# Getting started' || {two} || steps AS integration FROM d JOIN z USING (doc_id) LEFT JOIN e USING (doc_id)),
f AS (SELECT doc_id, 'executive' AS k, {trimmed('executive', '500')} AS c FROM body UNION ALL SELECT doc_id, 'detailed', {trimmed('detailed', '2000')} FROM body UNION ALL SELECT doc_id, 'complete', complete FROM body UNION ALL SELECT doc_id, 'technical', {trimmed('technical', '3000')} FROM body
  UNION ALL SELECT doc_id, 'api', api FROM body UNION ALL SELECT doc_id, 'security', security FROM body UNION ALL SELECT doc_id, 'integration', integration FROM body),
summary AS (SELECT doc_id, k AS summary_type, coalesce(c, {missing}) AS content, coalesce({tokens('c')}, 0)::BIGINT AS token_count FROM f)"""
    note = "CASE summary_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.SUMMARY_NOTES.items()) + " END"
    return {
        "summaries": f"{own} SELECT * FROM summary",
        "summary_files": f"{own} SELECT doc_id, 'summaries/' || summary_type || '-summary.md' AS path, '---' || {nl} || 'title: ' || {title('summary_type')} || {nl} || 'type: ' || summary_type || {nl} || 'token_count: ' || token_count || {nl} || '---' || {two} || content AS body FROM summary",
        "summary_index": f"{own} SELECT doc_id, 'summaries/README.md' AS path, '# Summaries of this document' || {two} || '## Which there are' || {two} || string_agg('- [' || {title('summary_type')} || '](' || summary_type || '-summary.md) - ' || {note}, {nl} ORDER BY summary_type) AS body FROM summary GROUP BY 1",
    }
