"""The same results in SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions import vocab as V
from ..sources.tables import MARKDOWN, MENTIONS
from . import oracle_more, oracle_reports


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def first_class(c: str, classes, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_of(c, ws)} THEN {q(n)}" for n, ws in classes) + f" ELSE {otherwise} END"


def count(c: str, rx: str) -> str:
    return f"len(regexp_extract_all({c}, {q(rx)}))"


def tokens(c: str) -> str:
    return f"(length({c}) // 4)"


def model(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {k} THEN {q(m)}" for k, m in V.MODEL_BANDS) + f" ELSE {q(V.MODEL_REST)} END"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[.!?]+\\s+'), lambda s: {strip('s')}), lambda s: s <> '')"


MD = "md AS (" + MARKDOWN.replace("{customer}", "customer") + ")"
BULLETS = rf"""n AS (SELECT doc_id, line_no, line, s, l[greatest(line_no - 3, 0) + 1:line_no + 4] AS near FROM line),
t AS (SELECT *, NOT contains(line, '•') AND regexp_matches(s, '^[l\-*·‣▪▫] ') AND ({any_of("lower(array_to_string(near, ''))", V.BULLET_INDICATORS)} OR len(list_filter(near, lambda x: starts_with({strip('x')}, left(s, 2)))) > 1) AS turn FROM n)"""
BULLET = rf"""CASE WHEN turn THEN regexp_extract(line, '^(\s*)', 1) || '• ' || {strip("regexp_replace(line, '^[ \t]+', '')[3:]")} ELSE line END"""
PURPOSE = "CASE section_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.PURPOSES.items()) + f" ELSE {q(V.PURPOSE_REST)} END"
_AREAS = "list_filter([" + ", ".join(f"CASE WHEN list_contains(ks, {q(k)}) THEN {q(v)} END" for k, v in V.AREAS) + "], lambda x: x IS NOT NULL)"
_LEAD = "CASE " + " ".join(f"WHEN list_contains(ks, {q(k)}) THEN {q(v)}" for k, v in V.ABOUT) + " ELSE 'A technical text in ' || n_sections || ' sections.' END"
ABOUT = f"""kinds AS (SELECT doc_id, count(*) AS n_sections, sum(token_count)::BIGINT AS n_tokens, list(DISTINCT section_type) AS ks FROM typed GROUP BY doc_id),
about AS (SELECT doc_id, n_sections, n_tokens, array_to_string(list_sort(ks), ',') AS kinds, {_LEAD} || CASE WHEN len({_AREAS}) > 0 THEN ' It covers ' || array_to_string({_AREAS}, ', ') || '.' ELSE '' END AS summary FROM kinds)"""
TREE = """n AS (SELECT (p_partkey - 1) // 60 AS doc_id, p_partkey::BIGINT AS node, (p_partkey - 1) % 60 AS i, (-p_partkey % 3)::BIGINT AS ord, p_name AS title,
  CASE WHEN i = 0 AND doc_id % 7 = 3 THEN node + 1 WHEN i = 0 THEN NULL WHEN i % 5 = 4 THEN node - 1 - i % 4 ELSE node - 1 END AS parent FROM part),
t AS (SELECT n.*, 0 AS level, [{'o': ord, 'n': node}] AS way FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n m WHERE m.doc_id = n.doc_id)
  UNION ALL SELECT n.*, level + 1, list_append(way, {'o': n.ord, 'n': n.node}) FROM t JOIN n ON n.doc_id = t.doc_id AND n.parent = t.node)"""
PAGES = "SELECT doc_id, (pos // 3000 + 1)::INT AS page_num, substr(text, pos + 1, 3000) AS page_text FROM documents, unnest(range(0, length(text), 3000)) AS t(pos)"
LINES = "ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {0}), line AS (SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line, " + strip("l[i]") + " AS s, l FROM ls, unnest(range(1, len(l) + 1)) AS t(i))"
SEC = rf"""{MD},
parts AS (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n(#{{1,6}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM md),
cut AS (SELECT doc_id, i - 1 AS pos, ps[i] AS part, {strip('ps[1]')} <> '' AS opens FROM parts, unnest(range(1, len(ps) + 1)) AS t(i)),
sec AS (SELECT doc_id, (pos + CASE WHEN opens THEN 1 ELSE 0 END)::INT AS section_id,
  CASE WHEN pos = 0 THEN 'Introduction' ELSE {strip("regexp_extract(part, '^#{1,6}[ \\t]+([^\\n]+)', 1)")} END AS title,
  {strip("CASE WHEN pos = 0 THEN part ELSE regexp_replace(part, '^[^\\n]*\\n?', '') END")} AS content,
  (CASE WHEN pos = 0 THEN 1 ELSE length(regexp_extract(part, '^(#{{1,6}})', 1)) END)::INT AS level FROM cut WHERE pos > 0 OR opens)"""
KIND = f"""coalesce({first_class('lower(title)', V.SECTION_TITLES)}, CASE WHEN {any_of('lower(content)', V.SECTION_API_CONTENT)} THEN 'api_endpoints'
  WHEN {count('content', '```')} >= 2 THEN 'code_examples' WHEN {count('content', '[|]')} > 5 THEN 'data_formats' ELSE 'content' END)"""
TYPED = f"{SEC}, typed AS (SELECT *, {KIND} AS section_type, {tokens('content')} AS token_count FROM sec)"
SAFE = lambda c: f"""regexp_replace(regexp_replace(regexp_replace({c}, '[<>:"/\\\\|?*]', '_', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g')"""
SAFE_CUT = lambda c: f"regexp_replace(CASE WHEN length({SAFE(c)}) > 100 THEN regexp_replace(left({SAFE(c)}, 100), '-[^-]*$', '') ELSE {SAFE(c)} END, '^-+|-+$', '', 'g')"
NAMES = "names AS (SELECT p_partkey AS doc_id, 'My ' || p_name || ' (v1.' || (p_partkey % 10)::VARCHAR || ') [FINAL]: ' || p_brand || '/' || p_type || '.PDF' AS text FROM part)"
FILE = "CASE section_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.FILE_NAMES.items()) + f" ELSE {SAFE_CUT('title')} END"
PATH = f"lpad(section_id::VARCHAR, 2, '0') || '-' || {FILE} || '.md'"
CELLS = rf"""{MD},
runs AS (SELECT doc_id, regexp_extract_all(chr(10) || text || chr(10), '(?:\n[^\n]*[|][^\n]*){{3,}}') AS rs FROM md),
run AS (SELECT doc_id, k AS table_no, string_split(substr(rs[k], 2), chr(10)) AS r FROM runs, unnest(range(1, len(rs) + 1)) AS t(k)),
body AS (SELECT doc_id, table_no, i - 2 AS row_no, string_split(regexp_replace(r[1], '^\s*[|]|[|]\s*$', '', 'g'), '|') AS h, string_split(regexp_replace(r[i], '^\s*[|]|[|]\s*$', '', 'g'), '|') AS c
  FROM run, unnest(range(3, len(r) + 1)) AS t(i)),
cell AS (SELECT doc_id, table_no::INT AS table_no, row_no::INT AS row_no, j::INT AS col_no, {strip('h[j]')} AS col_name, {strip('c[j]')} AS cell FROM body, unnest(range(1, len(c) + 1)) AS t(j)),
kinds AS (SELECT *, CASE WHEN cell = '' THEN 'null' WHEN lower(cell) IN ({', '.join(map(q, V.TRUE_CELLS + V.FALSE_CELLS))}) THEN 'bool' WHEN regexp_full_match(cell, '\d+') THEN 'int'
  WHEN regexp_full_match(cell, '-?\d+\.?\d*') OR (regexp_full_match(cell, '\$?[\d,]+\.?\d*') AND regexp_matches(cell, '\d')) OR regexp_full_match(cell, '[+-]?(\d+\.?\d*|\.\d+)%') THEN 'float' ELSE 'str' END AS kind FROM cell),
prof AS (SELECT doc_id, table_no, col_no, col_name, count(*) AS n, count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT cell) FILTER (kind <> 'null') AS n_unique,
  concat_ws(',', {', '.join(f"'{k}:' || nullif(count(*) FILTER (kind = '{k}'), 0)" for k in ('bool', 'int', 'float', 'str', 'null'))}) AS kinds, bool_or(kind = 'bool') AS has_bool,
  bool_or(kind IN ('bool', 'int', 'float')) AS has_number FROM kinds GROUP BY doc_id, table_no, col_no, col_name)"""
NUMBER = "CASE WHEN kind IN ('int', 'float') THEN CASE WHEN cell LIKE '%\\%' ESCAPE '\\' THEN regexp_replace(cell, '[$,%]', '', 'g')::DOUBLE / 100 ELSE regexp_replace(cell, '[$,%]', '', 'g')::DOUBLE END END"
_W, _F = "regexp_extract(regexp_replace(cell, '[$,+%-]', '', 'g'), '^([0-9]*)', 1)", "regexp_extract(cell, '[.]([0-9]*)', 1)"
_WHOLE = f"ltrim(CASE WHEN suffix(cell, '%') THEN left({_W}, greatest(length({_W}) - 2, 0)::BIGINT) ELSE {_W} END, '0')"
_PART = f"rtrim(CASE WHEN suffix(cell, '%') THEN right('00' || {_W}, 2) || {_F} ELSE {_F} END, '0')"
DIGITS = f"""CASE WHEN kind IN ('int', 'float') THEN CASE WHEN prefix(cell, '-') AND {_WHOLE} || {_PART} <> '' THEN '-' ELSE '' END || CASE WHEN {_WHOLE} = '' THEN '0' ELSE {_WHOLE} END || CASE WHEN {_PART} = '' THEN '' ELSE '.' || {_PART} END END"""


def _refs() -> str:
    rows = []
    for kind, p, g in V.REFERENCES:
        target = f"regexp_extract_all(content, {q(p)}, {g})"
        t = "lower(v[i])" if kind == "concept" else "v[i]"
        rows.append(f"SELECT doc_id, section_id, {q(kind)} AS type, t[i] AS text, CASE WHEN {q(kind)} = 'table' AND v[i] = '' THEN '0' ELSE {t} END AS target FROM (SELECT doc_id, section_id, regexp_extract_all(content, {q(p)}) AS t, {target} AS v FROM sec), unnest(range(1, len(t) + 1)) AS r(i)")
    return f"{SEC}, refs AS ({' UNION ALL '.join(rows)})"


def _located() -> str:
    rows = []
    for kind, p, g in V.REFERENCES:
        t = "lower(v[i])" if kind == "concept" else "v[i]"
        at = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x))), 0)"
        rows.append(f"SELECT doc_id, section_id, content, {q(kind)} AS type, t[i] AS text, CASE WHEN {q(kind)} = 'table' AND v[i] = '' THEN '0' ELSE {t} END AS target, ({at})::INT AS position FROM (SELECT doc_id, section_id, content, regexp_extract_all(content, {q(p)}) AS t, regexp_extract_all(content, {q(p)}, {g}) AS v, regexp_split_to_array(content, {q(p)}) AS s FROM sec), unnest(range(1, len(t) + 1)) AS r(i)")
    return f"{SEC}, located AS ({' UNION ALL '.join(rows)})"


CODE_RULES = [("python", ["python", "def ", "import ", "from "]), ("javascript", ["javascript", "js", "function", "var ", "const ", "let "]), ("java", ["java", "public class", "private class"]), ("cpp", ["c++", "cpp", "#include", "using namespace"])]


def repaired(c: str) -> str:
    """A marker alone on its line joins the next; matches don't overlap, so the next line is captured, not looked at."""
    joined = f"regexp_replace(chr(10) || {c} || chr(10), '\\n[ \\t]*([l•*·‣▪▫-])[ \\t]*\\n[ \\t]*([^\\s][^\\n]{{0,198}})\\n', chr(10) || '\\1 \\2' || chr(10), 'g')"
    cleaned = f"regexp_replace({joined}, '[ \\t]+\\n', chr(10), 'g')"
    return f"({cleaned})[2:-2]"


def trimmed(c: str, target: str) -> str:
    """Trimming as the column function has it: 0.9 of the proportional size, back to a late full stop."""
    n = f"floor(({target})::DOUBLE * (length({c})::DOUBLE / {tokens(c)}) * 0.9::DOUBLE)::INT"
    cut = f"left({c}, {n})"
    dot = f"(length({cut}) - instr(reverse({cut}), '.'))"
    late = f"CASE WHEN contains({cut}, '.') AND {dot} > {n} * 0.8::DOUBLE THEN left({cut}, {dot} + 1) ELSE {cut} END"
    return f"CASE WHEN {tokens(c)} <= {target} THEN {c} WHEN length({late}) < length({c}) THEN {late} || '...' ELSE {late} END"


HTTP = r"(?i)(GET|POST|PUT|DELETE|PATCH)\s+([/\w\-{}.:]+)"
ENDPOINTS = f"""calls AS (SELECT doc_id, section_id, content, regexp_extract_all(content, {q(HTTP)}) AS h, regexp_extract_all(content, {q(HTTP)}, 1) AS m, regexp_extract_all(content, {q(HTTP)}, 2) AS p, regexp_split_to_array(content, {q(HTTP)}) AS s FROM sec),
call AS (SELECT *, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS pos FROM calls, unnest(range(1, len(h) + 1)) AS t(i)),
endpoint AS (SELECT doc_id, section_id, i, upper(m[i]) AS method, p[i] AS path, coalesce(list_filter({sentences("substr(content, (greatest(pos - 200, 0) + 1)::BIGINT, (pos + length(h[i]) + 200 - greatest(pos - 200, 0))::BIGINT)")}, lambda x: length(x) > 20 AND length(x) < 200)[1], 'Not described') AS description FROM call)"""
REFS, LOCATED = _refs(), _located()
KNOWN = REFS + rf""", said AS (SELECT doc_id, 'section' AS type, section_id::VARCHAR AS target, section_id FROM sec UNION
  SELECT doc_id, 'page', unnest(regexp_extract_all(lower(content), 'page\s+0*(\d+)', 1)), section_id FROM sec UNION
  SELECT doc_id, 'page', unnest(regexp_extract_all(lower(content), 'p\.\s*0*(\d+)', 1)), section_id FROM sec UNION
  SELECT doc_id, 'figure', unnest(regexp_extract_all(lower(content), 'figure\s+0*(\d+)', 1)), section_id FROM sec UNION
  SELECT doc_id, 'table', unnest(regexp_extract_all(lower(content), 'table\s+0*(\d+)', 1)), section_id FROM sec),
known AS (SELECT doc_id, type, target AS number, string_agg(section_id, ',' ORDER BY section_id) AS places, max(section_id) AS last FROM said GROUP BY ALL),
numbered AS (SELECT *, regexp_replace(target, '^0+([0-9])', '\1') AS number FROM refs),
missing AS (SELECT doc_id, section_id, type, text, target FROM numbered ANTI JOIN known USING (doc_id, type, number) WHERE type IN ('section', 'page', 'figure', 'table'))"""
TERMS = SEC + ", term AS (SELECT DISTINCT doc_id, section_id, title, content, term FROM (" + " UNION ALL ".join(f"SELECT doc_id, section_id, title, content, unnest(list_filter(regexp_extract_all(content, {q(p)}), lambda x: length(x) > {k})) AS term FROM sec" for p, k in zip(V.TERM_PATTERNS, (2, 1, 1, 1, 1, 1, 1, 3))) + "))"
PAIRS = TERMS + ", low AS (SELECT DISTINCT doc_id, section_id, lower(term) AS t FROM term), pair AS (SELECT a.t AS term_a, b.t AS term_b, count(*) AS weight FROM low a JOIN low b ON a.doc_id = b.doc_id AND a.section_id = b.section_id AND a.t < b.t GROUP BY 1, 2)"
BOTH = SEC + ", both_ AS (SELECT *, lower(content) || ' ' || lower(title) AS b FROM sec)"


def _scored_sections() -> str:
    title = " + ".join(f"CASE WHEN {any_of('lower(title)', ws)} THEN {v} ELSE 0 END" for v, ws in V.KEY_TITLES)
    kind = "CASE section_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.KEY_TYPES.items()) + " ELSE 3 END"
    return f"""{TYPED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS k FROM typed),
scored AS (SELECT doc_id, section_id, {title} + {kind} + CASE WHEN length(content) BETWEEN 500 AND 3000 THEN 3 WHEN length(content) > 100 THEN 1 ELSE 0 END + CASE WHEN i < k * 0.3::DOUBLE THEN 2 ELSE 0 END AS score FROM numbered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section_id) AS rank FROM scored)"""


def _structure(source: str) -> str:
    any_rx = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in ps) + ")"
    left = "regexp_extract(s, '^([^:]*):', 1)"
    return f"""WITH {MD + ', ' if source == 'md' else ''}{LINES.format(source)}, flag AS (SELECT doc_id,
  (CASE WHEN {count('line', '[|]')} > 2 THEN 1 ELSE 0 END) + (CASE WHEN {any_rx('line', V.STRUCTURE_TABLES)} THEN 1 ELSE 0 END) AS t,
  (s LIKE '•%' OR {any_rx('line', V.STRUCTURE_LISTS)})::INT AS b, {any_rx('line', V.STRUCTURE_SECTIONS)}::INT AS h,
  (contains(line, ':') AND length(s) < 200 AND length({left}) < 50 AND regexp_full_match(regexp_replace({left}, '[ .]', '', 'g'), '[A-Za-z0-9]+'))::INT AS f, (s <> '')::INT AS n FROM line),
tot AS (SELECT doc_id, sum(t)::INT AS tables, sum(b)::INT AS bullets, sum(h)::INT AS hierarchy, sum(f)::INT AS fields, sum(n)::INT AS filled FROM flag GROUP BY doc_id),
d AS (SELECT *, tables > 3 OR (filled > 0 AND tables / filled * 100 > 2) AS ht, fields > 10 OR (filled > 0 AND fields / filled * 100 > 5) AS hf, bullets > 5 OR (filled > 0 AND bullets / filled * 100 > 3) AS hb FROM tot)
SELECT doc_id, CASE WHEN ht OR hf THEN 'structured_fields' WHEN hb THEN 'list_heavy' WHEN hierarchy > 3 THEN 'structured_fields' ELSE 'narrative' END AS document_type,
  ht AS has_tables, NOT ht AND NOT hf AND hb AS has_lists, tables, bullets, hierarchy, fields, filled FROM d"""


def sql() -> dict[str, str]:
    plan_sizes = "array_to_string(CASE WHEN token_count > 95000 THEN ['small', 'medium', 'large'] ELSE list_filter([" + ", ".join(f"CASE WHEN token_count <= {k} THEN {q(n)} END" for n, k in V.TIERS) + "], lambda x: x IS NOT NULL) END, ',')"
    priority = "CASE section_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.PRIORITIES.items()) + " ELSE 4 END"
    plan = f"{TYPED}, plan AS (SELECT doc_id, section_id, section_type, token_count, token_count > 3500 AS needs_chunking, {plan_sizes} AS sizes, CASE WHEN section_type IN ('api_endpoint', 'code_example') THEN 'preserve_structure' WHEN section_type IN ('table', 'data') THEN 'preserve_rows' WHEN token_count > 95000 THEN 'semantic_split' ELSE 'preserve_context' END AS approach, {priority} AS priority FROM typed)"
    depth = " + ".join(f"(length(lower(content)) - length(replace(lower(content), {q(w)}, ''))) / {len(w)}" for w in V.DEPTH_WORDS)
    one = lambda cond, v: f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0::DOUBLE END"
    t = strip("text")
    fields = rf"""{MD}, {LINES.format('md')},
colon AS (SELECT doc_id, line_no, 0 AS rule, {strip("regexp_extract(s, '^([^:]*):', 1)")} AS name, {strip("regexp_extract(s, '^[^:]*:(.*)$', 1)")} AS content FROM line WHERE contains(s, ':') AND length(s) < 500),
def AS (SELECT doc_id, line_no, 1 AS rule, s, CASE {' '.join(f"WHEN regexp_matches(s, {q(p)}) THEN {k}" for k, p in enumerate(DEFS))} END AS k FROM line WHERE length(s) < 300),
named AS (SELECT doc_id, line_no, rule, {strip("CASE k " + " ".join(f"WHEN {k} THEN regexp_extract(s, {q(p)}, 1)" for k, p in enumerate(DEFS)) + " END")} AS name, {strip("CASE k " + " ".join(f"WHEN {k} THEN regexp_extract(s, {q(p)}, 2)" for k, p in enumerate(DEFS)) + " END")} AS content FROM def WHERE k IS NOT NULL),
field AS (SELECT *, CASE WHEN regexp_full_match({strip('content')}, '\d+') THEN 'integer' WHEN regexp_full_match({strip('content')}, '\d*\.\d+') THEN 'float' WHEN {any_of('lower(content)', ['true', 'false', 'yes', 'no'])} THEN 'boolean'
  WHEN regexp_matches(content, '\d{{2,4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') THEN 'date' WHEN regexp_matches(content, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b') THEN 'email' WHEN content LIKE 'http://%' OR content LIKE 'https://%' OR content LIKE 'www.%' THEN 'url' ELSE 'string' END AS type
  FROM (SELECT * FROM colon WHERE name <> '' AND content <> '' UNION ALL SELECT * FROM named WHERE name <> '' AND content <> '' AND name <> content))"""
    two = lambda k: f"list_transform(list_zip(regexp_extract_all(content, {q(CROSS[k])}, 1), regexp_extract_all(content, {q(CROSS[k])}, 2)), lambda z: z[1] || ' ' || z[2])"
    meta = lambda p, g: f"nullif(regexp_extract(content, {q(p)}, {g}), '')"
    head_rules = r"(s LIKE '#%' OR (upper(s) = s AND lower(s) <> s AND length(s) < 60) OR regexp_matches(s, '^\d+\.?\s+[A-Z]|^(?:Chapter|Section|Part)\s+\d+|^[A-Z][^.!?]*$|^\d+\.\d+\s+[A-Z]'))"
    votes = " UNION ALL ".join(f"SELECT doc_id, section_id, {k} AS k, {q(n)} AS name FROM both_ WHERE {any_of('b', ws)}" for k, (n, ws) in enumerate(V.DOCUMENT_TYPES))
    theme = " UNION ALL ".join(f"SELECT doc_id, section_id, {k} AS k, {q(n)} AS theme FROM both_ WHERE {any_of('b', ws)}" for k, (n, ws) in enumerate(V.THEMES))
    score = " + ".join(f"contains(lower(s), {q(w)})::INT" for w in V.SENTENCE_WORDS)
    generic = " OR ".join(f"starts_with(lower(s), {q(g)})" for g in V.GENERIC_STARTS)
    rel = ", ".join(f"({q(a)}, {q(b)})" for a, bs in V.RELATED.items() for b in bs)
    folder = "regexp_replace(text, '(?i)\\.pdf$', '')"
    for p, r in ((r'[\\/:*?"<>|]', "_"), (r"[$()\[\]{}&#@!%^=+;''`~]", ""), (r"(\d)\.(\d)", r"\1_\2"), (r"\.", "_"), (r"\s+", "_"), ("_-|-_", "_"), ("_+", "_"), ("-+", "-"), ("^[._-]+|[._-]+$", "")):
        folder = f"regexp_replace({folder}, '{p}', '{r}', 'g')"
    fixes = "text"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("–", "-"), ("—", "--"), ("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"')):
        fixes = f"replace({fixes}, '{a}', '{b}')"
    plain = "text"
    for p, r in ((r"#{1,6}\s+", ""), (r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"`(.*?)`", r"\1"), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\s+", " ")):
        plain = f"regexp_replace({plain}, {q(p)}, '{r}', 'g')"
    page_text = "html"
    for p, r in ((r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>", ""), *[(rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", "\n# \\1\n") for k in range(1, 7)], (r"(?is)<li[^>]*>(.*?)</li>", "\n- \\1"), (r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"), (r"(?is)</p>", "\n"), (r"(?s)<[^>]+>", ""), (r"\n{2,}", "\n")):
        page_text = f"regexp_replace({page_text}, {q(p)}, {q(r)}, 'g')"
    page_text = strip(page_text)
    url = r'https?://[^\s<>"{}|\\^`\[\]]+|www\.[^\s<>"{}|\\^`\[\]]+'
    edges = " UNION ALL ".join(f"SELECT doc_id, {name!r} AS family, {k} AS k, regexp_extract_all(text, {q(p)}) AS h, regexp_split_to_array(text, {q(p)}) AS s FROM md" for k, (name, p) in enumerate([(n, r"\n\n[A-Z]" if n == "paragraph" else p) for n, p in V.BOUNDARIES]))
    own = {
        "token_tiers": f"WITH d AS (SELECT lang, {tokens('text')} AS n, len({sentences('text')}) AS k FROM documents) SELECT lang, {model('n')} AS tier, count(*) AS documents, sum(n)::BIGINT AS tokens, sum(k)::BIGINT AS sentences FROM d GROUP BY 1, 2",
        "clean_text": f"SELECT doc_id, trim(regexp_replace({fixes.replace(chr(8211), 'zzqx').replace(chr(8212), 'zzqy')}, '\\s+', ' ', 'g')) AS clean_text FROM documents",
        "fixed_text": f"SELECT doc_id, {fixes} AS fixed_text FROM documents",
        "plain_text": f"WITH {MD} SELECT doc_id, trim({plain}) AS plain_text FROM md",
        "n_sentences": f"SELECT doc_id, len({sentences('text')})::INT AS n_sentences FROM documents",
        "rag_keywords": f"WITH {MD} SELECT doc_id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(V.TECH_WORDS)})\\b'), lambda x: upper(x)), list_filter(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda x: length(x) > 3))))[1:20] AS rag_keywords FROM md",
        "urls": f"WITH {MD} SELECT doc_id, regexp_extract_all(text, {q(url)}) AS urls FROM md",
        "emails": f"WITH {MD} SELECT doc_id, regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b') AS emails FROM md",
        "has_toc": f"SELECT doc_id, {any_of('lower(left(text, 1000))', V.TOC_WORDS)} AS has_toc FROM documents",
        "safe_name": f"WITH {NAMES} SELECT doc_id, {SAFE_CUT('text')} AS safe_name FROM names",
        "folder_name": f"WITH {NAMES} SELECT doc_id, lower({folder}) AS folder_name FROM names",
        "anchor": f"WITH {NAMES}, a AS (SELECT doc_id, replace(lower(text), ' ', '-') AS t FROM names) SELECT doc_id, {SAFE_CUT('t')} AS anchor FROM a",
        "context": f"WITH {MD}, p AS (SELECT *, instr(lower(text), 'json') AS pos FROM md) SELECT doc_id, regexp_replace({strip('substr(text, greatest(1, pos - 50), least(length(text), pos + 53) - greatest(1, pos - 50) + 1)')}, '\\s+', ' ', 'g') AS context FROM p",
        "quality": f"""SELECT doc_id, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + {one('length(text) > 100', 0.1)} + {one(f"regexp_matches({t}, '[.!?]$')", 0.1)} + {one(f"regexp_matches({t}, '^[A-Z]')", 0.1)} + {one(count('text', '[.]') + ' > 1', 0.1)}
          + {one("regexp_matches(text, '\\b(?:def|class|function|import|return)\\b')", 0.1)} - {one('length(text) < 50', 0.2)} - {one(count('text', chr(10)) + ' / greatest(length(text), 1) > 0.3', 0.1)})) AS quality FROM documents""",
        "images": f"WITH {MD}, i AS (SELECT doc_id, regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS a, regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS u FROM md) SELECT doc_id, unnest(a) AS alt, unnest(u) AS url FROM i",
        "token_costs": f"WITH d AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents) SELECT doc_id, tokens, {model('tokens')} AS model, tokens / 1000 * 0.0015::DOUBLE AS cost, tokens <= 4000 AS fits FROM d",
        "document_ids": "SELECT doc_id, left(md5('doc-' || doc_id::VARCHAR), 12) AS hash FROM documents",
        "header_lines": rf"""WITH {MD}, {LINES.format('md')} SELECT doc_id, line_no, (CASE WHEN s LIKE '#%' THEN least(6, {count('s', '#')}) WHEN s LIKE 'Chapter%' THEN 1 WHEN s LIKE 'Section%' THEN 2 WHEN regexp_matches(s, '^\d+\.\d+') THEN 3
          WHEN regexp_matches(s, '^\d+\.') THEN 2 WHEN length(s) < 30 THEN 2 WHEN length(s) < 50 THEN 3 ELSE 4 END)::INT AS level FROM line WHERE s <> '' AND {head_rules}""",
        "sections_headers": f"WITH {MD}, {LINES.format('md')}, h AS (SELECT doc_id, line_no, s, l, len(l) AS n FROM line WHERE s <> '' AND {head_rules}) SELECT doc_id, row_number() OVER w::INT AS section_id, s AS title, (coalesce(lead(line_no) OVER w, n) - line_no - 1)::INT AS n_lines, {strip("array_to_string(l[line_no + 2:coalesce(lead(line_no) OVER w, n)], chr(10))")} AS content FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)",
        "code_starts": rf"""WITH {MD}, {LINES.format('md')}, c AS (SELECT doc_id, line_no, s LIKE '```%' OR {any_of('lower(line)', V.CODE_WORDS)} OR len(list_filter(l[line_no + 2:line_no + 4], lambda x: {any_of('lower(x)', V.CODE_WORDS)})) > 0 AS opens, lower(line || ' ' || coalesce(array_to_string(l[line_no + 2:line_no + 6], ' '), '')) AS t FROM line)
          SELECT doc_id, line_no, coalesce({first_class('t', CODE_RULES)}, CASE WHEN contains(t, 'json') OR contains(t, '{{') AND contains(t, '"') THEN 'json' END, CASE WHEN {any_of('t', ['sql', 'select ', 'from ', 'where '])} THEN 'sql' END, 'text') AS code_type FROM c WHERE opens""",
        "code_ends": f"WITH {MD}, {LINES.format('md')} SELECT doc_id, line_no FROM line WHERE s LIKE '%```' OR s = '' AND coalesce({strip('l[line_no + 2]')}, '') <> ''",
        "bullets": rf"""WITH {MD}, {LINES.format('md')}, {BULLETS} SELECT doc_id, line_no, {BULLET} AS line FROM t""",
        "fields_generic": rf"""WITH {LINES.format('documents')}, h AS (SELECT doc_id, line_no, s, s <> '' AND length(s) < 100 AND (upper(s) = s AND lower(s) <> s OR regexp_matches(s, '^[^\p{{L}}]*\p{{Lu}}\p{{Ll}}*(?:[^\p{{L}}]+\p{{Lu}}\p{{Ll}}*)*[^\p{{L}}]*$')) AND NOT regexp_matches(s, '^[•\-*]') AS head FROM line),
          a AS (SELECT *, last_value(CASE WHEN head THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM h)
          SELECT doc_id, line_no, coalesce(replace(lower(above), ' ', '_'), 'content') AS section, s AS content FROM a WHERE length(s) > 10 AND NOT head""",
        "keywords": f"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}')), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(map(q, V.STOP_WORDS))})))) AS keywords FROM documents",
        "repaired": f"WITH {MD} SELECT doc_id, {repaired('text')} AS repaired FROM md",
        "processed": f"WITH {MD}, fixed AS (SELECT doc_id, {repaired(fixes)} AS text FROM md), {LINES.format('fixed')}, {BULLETS} SELECT doc_id, string_agg({BULLET}, chr(10) ORDER BY line_no) AS processed FROM t GROUP BY doc_id",
        "trimmed": f"SELECT doc_id, {trimmed('text', '100')} AS trimmed FROM documents",
        "page_markdown": f"SELECT page_id AS doc_id, {page_text} AS text FROM pages",
        "table_rows": f"WITH {LINES.format('documents')} SELECT doc_id, line_no, CASE WHEN s LIKE '|%|' THEN s WHEN contains(s, chr(9)) THEN '| ' || array_to_string(string_split(s, chr(9)), ' | ') || ' |' WHEN contains(s, '  ') THEN '| ' || array_to_string(regexp_split_to_array(s, '\\s{{2,}}'), ' | ') || ' |' ELSE '| ' || s || ' |' END AS row FROM line WHERE {count('s', '[|]')} >= 2 OR {count('s', chr(9))} >= 2",
        "doc_structure": _structure("md"),
        "doc_structure_documents": _structure("documents"),
        "fields_structured": f"WITH {fields} SELECT * FROM field",
        "field_types": f"WITH {fields} SELECT type, count(*) AS n FROM field GROUP BY type",
        "field_metadata": f"""WITH {fields}, near AS (SELECT doc_id, line_no, array_to_string(list_filter(list_transform(l[greatest(1, line_no - 1):line_no + 3], lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS context FROM line)
          SELECT doc_id, line_no, rule, name, lower({meta('(?i)(required|optional|conditional|mandatory)', 1)}) AS requirement, {meta(SPEC, 1)} AS format_type, {meta(SPEC, 2)} AS format_size,
          lower({meta('(?i)(string|integer|boolean|decimal|binary)', 1)}) AS data_type, {meta(SPAN, 1)} AS min_value, {meta(SPAN, 2)} AS max_value,
          array_to_string(list_concat(list_concat({two(0)}, regexp_extract_all(content, {q(CROSS[1])})), {two(2)}), ', ') AS cross_references, trim(nullif(regexp_extract(context, '(\\d+\\.\\d+\\s+[A-Z][^:]+)', 1), '')) AS section FROM field JOIN near USING (doc_id, line_no)""",
        "fields_list": rf"WITH {MD}, {LINES.format('md')} SELECT doc_id, 'item_' || row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS name, regexp_extract(s, '^(?:[•\-*]|\d+[.)])\s+(.+)$', 1) AS content FROM line WHERE regexp_matches(s, '^(?:[•\-*]|\d+[.)])\s+(.+)$')",
        "fields_table": rf"WITH {MD}, {LINES.format('md')}, c AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(line, '|'), lambda x: {strip('x')}), lambda x: x <> '') AS c FROM line WHERE {count('line', '[|]')} > 2) SELECT doc_id, line_no, c[1] AS name, array_to_string(c[2:], ' | ') AS content FROM c WHERE len(c) >= 2",
        "pages_fixed": PAGES,
        "outline_adjacency": f"WITH RECURSIVE {TREE} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1)::INT AS ord, node, title, level FROM t",
        "outline_cycles": f"WITH RECURSIVE {TREE} SELECT doc_id, node FROM n WHERE node NOT IN (SELECT node FROM t)",
        "pdf_pages": f"WITH p AS ({PAGES}) SELECT doc_id, page_num, array_to_string(list_transform(list_filter(string_split(page_text, chr(10)), lambda x: x <> ''), lambda x: regexp_replace(x, '[ \\t]+$', '')), chr(10)) AS page_text, NULL::VARCHAR AS error FROM p",
        "pdf_outline": f"WITH p AS ({PAGES}) SELECT doc_id, page_num - 1 AS ord, 'Page ' || page_num AS title, 0 AS level, page_num, NULL::VARCHAR AS error FROM p",
        "pdf_facts": f"WITH p AS ({PAGES}) SELECT doc_id, max(page_num) AS pages, true AS has_toc, 'Document ' || doc_id AS title, '' AS author, '' AS subject, '' AS creator, NULL::VARCHAR AS error FROM p GROUP BY doc_id",
        "docx_markdown": rf"""WITH {MD}, {LINES.format('md')}, k AS (SELECT doc_id, line_no, s, CASE WHEN regexp_full_match(s, '[|].*[|]') THEN 'table' WHEN regexp_matches(s, '^[-*]\s+\S') THEN 'list' ELSE '' END AS kind FROM line),
          j AS (SELECT *, CASE WHEN kind <> '' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = kind THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM k)
          SELECT doc_id, substr(string_agg(sep || CASE WHEN kind = 'list' THEN '- ' || {strip('substr(s, 2)')} ELSE s END, '' ORDER BY line_no), 3) AS text, NULL::VARCHAR AS error FROM j WHERE s <> '' GROUP BY doc_id""",
        "sections_by_pages": "SELECT doc_id, (pos // 9000 + 1)::INT AS section_id, (pos // 3000 + 1)::INT AS first_page, (pos // 3000 + ceil(least(9000, length(text) - pos) / 3000))::INT AS last_page, least(9000, length(text) - pos)::INT AS n_chars FROM documents, unnest(range(0, length(text), 9000)) AS t(pos)",
        "sections_md": f"WITH {SEC} SELECT * FROM sec",
        "section_types": f"WITH {TYPED} SELECT doc_id, section_id, section_type, token_count FROM typed",
        "section_filenames": f"WITH {TYPED} SELECT doc_id, section_id, {PATH} AS file FROM typed",
        "docx_section_types": f"WITH {SEC} SELECT doc_id, section_id, {first_class('lower(title)', V.WORD_SECTION_TITLES, q('content'))} AS kind FROM sec",
        "related_by_type": f"WITH {TYPED}, rel(a, b) AS (VALUES {rel}) SELECT x.doc_id, x.section_id, y.section_id AS related_id FROM typed x JOIN rel ON x.section_type = a JOIN typed y ON y.doc_id = x.doc_id AND y.section_type = b AND y.section_id <> x.section_id",
        "related_by_mention": f"WITH typed AS ({MENTIONS.replace('{customer}', 'customer')}) SELECT x.doc_id, x.section_id, y.section_id AS related_id FROM typed x JOIN typed y ON y.doc_id = x.doc_id AND y.section_id <> x.section_id WHERE contains(lower(y.content), lower(x.title)) OR contains(lower(x.content), lower(y.title))",
        "document_map": f"WITH {TYPED} SELECT doc_id, string_agg('- [' || title || '](sections/' || {PATH} || ') - ' || {PURPOSE} || ', ' || token_count || ' tokens', chr(10) ORDER BY section_id) AS map FROM typed GROUP BY doc_id",
        "section_files": f"WITH {TYPED} SELECT doc_id, 'sections/' || {PATH} AS path, '# ' || title || chr(10) || chr(10) || '> ' || section_type || ', ' || token_count || ' tokens' || chr(10) || chr(10) || content || chr(10) AS body FROM typed",
        "section_index": f"WITH {TYPED}, f AS (SELECT doc_id, 'sections/' || {PATH} AS path FROM typed) SELECT doc_id, string_agg('- [' || path || '](' || path || ')', chr(10) ORDER BY path) AS index FROM f GROUP BY doc_id",
        "consolidated_summary": f"WITH {TYPED}, {ABOUT} SELECT * FROM about",
        "md_tables": rf"""WITH {MD}, r AS (SELECT doc_id, regexp_extract_all(chr(10) || text || chr(10), '(?:\n[^\n]*[|][^\n]*){{3,}}') AS rs FROM md) SELECT doc_id, i::INT AS table_no, ({count('rs[i]', chr(10))} - 2)::INT AS n_rows, ({count("regexp_extract(rs[i], '^\\n([^\\n]*)', 1)", '[|]')} - 1)::INT AS n_cols FROM r, unnest(range(1, len(rs) + 1)) AS t(i)""",
        "cell_types": f"WITH {CELLS}, v AS (SELECT *, {NUMBER} AS number, {DIGITS} AS digits FROM kinds) SELECT doc_id, table_no, row_no, col_no, col_name, kind, number, CASE kind WHEN 'null' THEN '' WHEN 'bool' THEN CASE WHEN lower(cell) IN ({', '.join(map(q, V.TRUE_CELLS))}) THEN 'Yes' ELSE 'No' END WHEN 'str' THEN cell ELSE CASE WHEN contains(digits, '.') THEN format('{{:.2f}}', number) ELSE digits END END AS shown FROM v",
        "table_profile": f"""WITH {CELLS} SELECT *, CASE WHEN has_bool THEN 'boolean' WHEN has_number THEN 'number' WHEN n_unique <= 10 THEN 'categorical' ELSE 'text' END AS column_type,
          col_name || ': ' || concat_ws(' ', CASE WHEN has_bool THEN 'Boolean values' WHEN has_number THEN 'Numeric values' ELSE 'Text values' END, CASE WHEN n_unique <= 5 THEN '(low cardinality)' WHEN n_unique > 50 THEN '(high cardinality)' END, CASE WHEN nulls > 0 THEN 'with null values' END) AS description FROM prof""",
        "table_notes": f"""WITH {CELLS}, t AS (SELECT doc_id, table_no, max(n) AS r, count(*) AS c, count(*) FILTER (has_number) AS k, count(*) FILTER (n_unique <= 10) AS g FROM prof GROUP BY doc_id, table_no)
          SELECT doc_id, table_no, CASE WHEN r * c <= 50 THEN 'simple' WHEN r * c <= 200 THEN 'moderate' WHEN r * c <= 1000 THEN 'complex' ELSE 'very_complex' END AS complexity,
          concat_ws(';', CASE WHEN r > 100 THEN 'large' WHEN r < 5 THEN 'small' END, CASE WHEN c > 10 THEN 'wide' END, CASE WHEN k > 0 THEN 'numeric:' || k END, CASE WHEN g > 0 THEN 'grouping:' || g END) AS notes FROM t""",
        "table_usage": f"WITH {CELLS}, t AS (SELECT doc_id, table_no, max(n) AS r, count(*) FILTER (has_number) AS k, count(*) FILTER (n_unique <= 10) AS g FROM prof GROUP BY ALL) SELECT doc_id, table_no, concat_ws('; ', CASE WHEN k >= 2 THEN {q(V.USAGE_NOTES[0])} END, CASE WHEN g > 0 THEN {q(V.USAGE_NOTES[1])} END, CASE WHEN r > 20 THEN {q(V.USAGE_NOTES[2])} ELSE {q(V.USAGE_NOTES[3])} END) AS usage FROM t",
        "table_embedding": f"WITH {CELLS}, l AS (SELECT doc_id, table_no, row_no, string_agg(col_name || ': ' || CASE WHEN cell = '' THEN 'N/A' ELSE cell END, ' | ' ORDER BY col_no) AS line, string_agg(col_name, ', ' ORDER BY col_no) AS names FROM cell GROUP BY ALL) SELECT doc_id, table_no, 'Table with columns: ' || first(names ORDER BY row_no) || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS text FROM l GROUP BY ALL",
        "table_json": f"""WITH {CELLS}, v AS (SELECT *, {DIGITS} AS number FROM kinds),
          p AS (SELECT *, to_json(col_name)::VARCHAR || ': ' || CASE kind WHEN 'null' THEN 'null' WHEN 'bool' THEN CASE WHEN lower(cell) IN ({', '.join(map(q, V.TRUE_CELLS))}) THEN 'true' ELSE 'false' END WHEN 'str' THEN to_json(cell)::VARCHAR ELSE number END AS j FROM v),
          r AS (SELECT doc_id, table_no, row_no, '{{' || string_agg(j, ', ' ORDER BY col_no) || '}}' AS j, string_agg(col_name, ',' ORDER BY col_no) AS h FROM p GROUP BY ALL) SELECT doc_id, table_no, first(h ORDER BY row_no) AS headers, count(*)::INT AS n_rows, '[' || string_agg(j, ', ' ORDER BY row_no) || ']' AS rows FROM r GROUP BY ALL""",
        **{name: f"""WITH {CELLS}, v AS (SELECT {keys}, cell, kind, count(*) AS k FROM kinds GROUP BY ALL), w AS (SELECT {keys}, cell, sum(k) AS k FROM v WHERE kind <> 'null' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY k DESC, cell) AS r FROM w),
          t AS (SELECT {keys}, count(*) AS u, string_agg(cell || ':' || k, ',' ORDER BY r) FILTER (r <= 3) AS top FROM r GROUP BY ALL), c AS (SELECT {keys}, kind, sum(k) AS k FROM v GROUP BY ALL),
          m AS (SELECT {keys}, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (kind = 'null'), 0)::BIGINT AS nulls, first(kind ORDER BY k DESC, list_position(['bool', 'int', 'float', 'str', 'null'], kind)) AS mode_kind FROM c GROUP BY ALL)
          SELECT m.*, coalesce(u, 0)::BIGINT AS n_unique, coalesce(top, '') AS top FROM m LEFT JOIN t USING ({keys})""" for name, keys in (("column_sketches", "doc_id, table_no, col_no, col_name"), ("corpus_columns", "col_name"))},
        "value_counts": f"WITH {CELLS}, v AS (SELECT doc_id, table_no, col_no, col_name, cell, count(*) AS n FROM cell WHERE cell <> '' GROUP BY ALL) SELECT v.* FROM v JOIN (SELECT doc_id, table_no, col_no, col_name FROM v GROUP BY ALL HAVING count(*) <= 20) USING (doc_id, table_no, col_no, col_name)",
        "value_distribution": f"WITH {CELLS}, v AS (SELECT col_name, cell, count(*) AS n FROM cell WHERE cell <> '' GROUP BY 1, 2) SELECT * FROM v WHERE col_name IN (SELECT col_name FROM v GROUP BY 1 HAVING count(*) <= 20)",
        "boundaries": f"WITH {MD}, e AS ({edges}), p AS (SELECT doc_id, family, k, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS position FROM e, unnest(range(1, len(h) + 1)) AS t(i)) SELECT doc_id, position::INT AS position, arg_min(family, k) AS family FROM p GROUP BY 1, 2",
        "boundary_pages": f"SELECT b.*, pos // 300 + 1 AS page_num FROM (WITH {MD}, e AS ({edges}), p AS (SELECT doc_id, family, k, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS position FROM e, unnest(range(1, len(h) + 1)) AS t(i)) SELECT doc_id, position::INT AS position, arg_min(family, k) AS family FROM p GROUP BY 1, 2) b JOIN (WITH {MD} SELECT doc_id, pos, length(text) AS n FROM md, unnest(range(0, length(text), 300)) AS t(pos)) p ON p.doc_id = b.doc_id AND position >= pos AND position < least(pos + 300, n)",
        "chunk_plan": f"WITH {plan} SELECT * FROM plan",
        "chunk_sizes": f"WITH {plan} SELECT doc_id, section_id, token_count, unnest(string_split(sizes, ',')) AS size, {model('token_count')} AS model FROM plan",
        "chunk_manifest": f"WITH {plan} SELECT section_type, count(*) AS sections, sum(token_count)::BIGINT AS tokens, sum(len(string_split(sizes, ',')))::BIGINT AS chunks, max(priority) AS priority FROM plan GROUP BY 1",
        "terms": f"WITH {TERMS} SELECT doc_id, section_id, term, {first_class('lower(term)', V.CONCEPTS, q('general'))} AS category FROM term",
        "cooccurrence": f"WITH {PAIRS} SELECT * FROM pair",
        "term_degrees": f"WITH {PAIRS} SELECT t AS term, count(*) AS degree FROM (SELECT term_a AS t FROM pair UNION ALL SELECT term_b FROM pair) GROUP BY 1",
        "term_graph_edges": f"WITH {PAIRS} SELECT term_a AS source, term_b AS target, weight FROM pair WHERE weight > 1 UNION ALL SELECT term_b, term_a, weight FROM pair WHERE weight > 1",
        "references": f"WITH {REFS} SELECT * FROM refs",
        "refs_urls": f"WITH {REFS} SELECT doc_id, section_id, target AS url, regexp_extract(target, '^https?://([^/?#]+)', 1) AS domain FROM refs WHERE type = 'url'",
        "refs_located": f"WITH {LOCATED} SELECT doc_id, section_id, type, text, target, position, {strip('substr(content, greatest(position - 50, 0) + 1, position + 50 - greatest(position - 50, 0))')} AS context, CASE WHEN type = 'api' THEN nullif(upper(regexp_extract(text, '(?i)^(GET|POST|PUT|DELETE|PATCH)\\s', 1)), '') END AS method FROM located",
        "refs_external": f"WITH {REFS} SELECT doc_id, section_id, type, text, target, CASE WHEN type = 'url' THEN regexp_extract(target, '^https?://([^/?#]+)', 1) END AS domain, CASE WHEN type = 'api' AND contains(target, '/api/') THEN '#api-docs' || replace(target, '/', '-') END AS documentation FROM refs WHERE type IN ('url', 'api')",
        "refs_resolved": f"""WITH {KNOWN} SELECT n.doc_id, n.section_id, n.type, n.text, n.target, sec.title AS target_title, {SAFE_CUT("replace(lower(sec.title), ' ', '-')")} AS target_anchor, left(sec.content, 200) || CASE WHEN length(sec.content) > 200 THEN '...' ELSE '' END AS target_preview,
          CASE WHEN n.type = 'page' THEN places END AS sections_on_page, CASE WHEN n.type IN ('figure', 'table') THEN last END AS target_section, '#' || n.type || '-' || number AS link
          FROM numbered n JOIN known USING (doc_id, type, number) LEFT JOIN sec ON n.type = 'section' AND sec.doc_id = n.doc_id AND sec.section_id::VARCHAR = number""",
        "refs_broken": f"WITH {KNOWN} SELECT *, upper(type[1]) || type[2:] || ' ' || target || ' not found' AS reason FROM missing",
        "xref_stats": f"WITH {KNOWN}, n AS (SELECT doc_id, count(*) FILTER (type NOT IN ('url', 'api')) AS internal, count(*) FILTER (type IN ('url', 'api')) AS external FROM refs GROUP BY 1), m AS (SELECT doc_id, count(*) AS broken FROM missing GROUP BY 1) SELECT doc_id, internal, external, coalesce(broken, 0) AS broken FROM n LEFT JOIN m USING (doc_id)",
        "document_type_vote": f"WITH {BOTH}, v AS ({votes}), n AS (SELECT doc_id, name, k, count(*) AS n, min(section_id) AS f FROM v GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, k) AS p FROM n) SELECT d.doc_id, coalesce(name, 'general_document') AS document_type FROM (SELECT DISTINCT doc_id FROM sec) d LEFT JOIN r ON r.doc_id = d.doc_id AND p = 1",
        "themes": f"WITH {BOTH}, v AS ({theme}), n AS (SELECT doc_id, theme, k, count(*) AS n, min(section_id) AS f FROM v GROUP BY 1, 2, 3) SELECT doc_id, theme, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, k)::INT AS rank FROM n) WHERE rank <= 5",
        "technical_depth": f"WITH {SEC}, d AS (SELECT doc_id, sum({depth}) AS h, sum(length(content)) AS n FROM sec GROUP BY 1) SELECT doc_id, h::BIGINT AS hits, CASE WHEN n = 0 THEN 'unknown' WHEN h / (n / 1000) > 10 THEN 'highly_technical' WHEN h / (n / 1000) > 5 THEN 'moderately_technical' WHEN h / (n / 1000) > 2 THEN 'somewhat_technical' ELSE 'non_technical' END AS depth FROM d",
        "structure_type": f"WITH {TYPED}, d AS (SELECT doc_id, bool_or(contains(lower(title), 'getting started')) AS a, bool_or(contains(lower(title), 'api')) AS b, avg((section_type = 'api_endpoint')::INT) AS c, bool_or({any_of('lower(title)', ['install', 'setup', 'config'])}) AS i, bool_or({any_of('lower(title)', ['tutorial', 'how to', 'step'])}) AS t FROM typed GROUP BY 1) SELECT doc_id, CASE WHEN a AND b THEN 'tutorial_with_reference' WHEN c > 0.4 THEN 'api_reference' WHEN i THEN 'installation_guide' WHEN t THEN 'tutorial' ELSE 'general_documentation' END AS structure_type FROM d",
        "key_sections": f"WITH {_scored_sections()} SELECT doc_id, section_id, score, rank::INT AS rank FROM ranked WHERE rank <= 10",
        "key_sentence": f"""WITH {SEC}, s AS (SELECT doc_id, section_id, {sentences('content')}[1:10] AS ss FROM sec), e AS (SELECT doc_id, section_id, i, ss[i] AS s FROM s, unnest(range(1, len(ss) + 1)) AS t(i)),
          v AS (SELECT *, {score} + CASE WHEN length(s) BETWEEN 50 AND 200 THEN 2 WHEN length(s) BETWEEN 20 AND 300 THEN 1 ELSE 0 END + CASE WHEN {generic} THEN 0 ELSE 1 END AS k FROM e),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY k DESC, i) AS p FROM v)
          SELECT sec.doc_id, sec.section_id, CASE WHEN s IS NULL THEN 'This section is empty.' WHEN length(s) > 200 THEN left(s, 200) || '...' ELSE s END AS sentence FROM sec LEFT JOIN r ON r.doc_id = sec.doc_id AND r.section_id = sec.section_id AND p = 1""",
        "endpoints": f"WITH {SEC}, {ENDPOINTS} SELECT doc_id, section_id, method, path, description FROM endpoint",
        "security_sentences": f"WITH {SEC}, f AS (SELECT doc_id, section_id, list_filter({sentences('content')}, lambda s: {any_of('lower(s)', V.SECURITY_WORDS)})[1:5] AS s FROM sec) SELECT doc_id, section_id, array_to_string(s, ' ') AS security FROM f WHERE len(s) > 0",
        "integration_steps": rf"WITH {SEC}, f AS (SELECT doc_id, section_id, list_concat(list_concat(regexp_extract_all(content, '(?m)^\d+\.\s+(.+)', 1)[1:5], regexp_extract_all(content, '(?m)^[-*]\s+(.+)', 1)[1:5]), regexp_extract_all(content, '(?i)step\s+\d+[:\s]+(.+)', 1)[1:5])[1:8] AS s FROM sec) SELECT doc_id, section_id, array_to_string(list_transform(s, lambda x: '- ' || x), chr(10)) AS steps FROM f WHERE len(s) > 0",
        "events_hourly": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    }
    own |= oracle_reports.sql()
    own |= oracle_reports.summaries(own)
    return own | oracle_more.sql(own)


CROSS = [r"(?i)(see|refer|reference)\s+([A-Z]\w+|\d+\.\d+|Table\s+\d+|Section\s+\d+)", r"(?i)([A-Z]\w+\s+\d+)", r"(?i)(Annex|Appendix)\s+([A-Z])"]
DEFS = [r"([A-Z][^:]+):\s*(.+)", r"([A-Z]\w+)\s+([a-z]+\s+\d+)", r"([A-Z0-9]{2,})\s*[-–]\s*(.+)"]
SPEC, SPAN = r"(?i)([a-zA-Z]+)\s*[\(\[]?(\d+)[\)\]]?", r"(?i)(\d+)\s*[-–to]\s*(\d+)"
