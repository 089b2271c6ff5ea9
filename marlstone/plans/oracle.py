"""DuckDB statements that compute the registry's queries from the same tables, written independently."""

from __future__ import annotations

from marlstone.functions import kinds
from marlstone.functions.text import BLOCK_TAGS, CODE_STARTS, CONTROL_STARTS, ENTITIES
from marlstone.operators import audit
from marlstone.plans import literals

WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NL = "chr(10)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines(t: str) -> str:
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) END"


def trim(t: str) -> str:
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def blank(t: str) -> str:
    return f"NOT regexp_matches({t}, '[^{WS}]')"


def tokens_of(t: str) -> str:
    cheap = rf"[\x00-\x7F{WS}]+"
    return f"CAST(greatest(1, coalesce(list_sum(list_transform(regexp_extract_all({t}, '{cheap}'), lambda r: (length(r) + 3) // 4)), 0) + length(regexp_replace({t}, '{cheap}', '', 'g'))) AS BIGINT)"


def words(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents)"


def numbered(docs: str, name: str = "numbered") -> str:
    return f"{name} AS (SELECT path, unnest(l) AS content, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line FROM (SELECT path, {lines('text')} AS l FROM {docs}))"


def findings(docs: str, name: str = "findings") -> str:
    low = f"translate(content, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    value = trim(r"CASE WHEN contains(low, '=') THEN regexp_extract(low, '(?s)^[^=]*=(.*)$', 1) WHEN contains(low, ': ') THEN regexp_extract(low, '(?s)^.*?: (.*)$', 1) END")
    value = f"regexp_replace(regexp_replace({value}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
    edges = r"[,;:\"''()\[\]{}]"
    email = rf"list_bool_or(list_transform(regexp_split_to_array(content, '[{WS}]+'), lambda w: NOT contains(regexp_replace(regexp_replace(w, '^{edges}+|{edges}+$', '', 'g'), '(?s)^.*=', ''), '/') AND regexp_matches(regexp_replace(regexp_replace(w, '^{edges}+|{edges}+$', '', 'g'), '(?s)^.*=', ''), '(?s)^[^@]+@[^.].*\.')))"
    digits = "length(regexp_replace(content, '[^0-9]', '', 'g'))"
    rules = [
        (f"regexp_matches(low, '{audit.DATABASES}')", "'Database URL'", "'High'", "'database connection string'"),
        ("contains(low, 'begin ') AND contains(low, 'private key')", "'Private key'", "'High'", "'private key block marker'"),
        (f"regexp_matches(low, '{audit.SECRET_NAMES}') AND octet_length(encode(value)) >= 8", "'API key'", f"CASE WHEN regexp_matches(value, '{audit.PLACEHOLDERS}') THEN 'Low' ELSE 'High' END", f"CASE WHEN regexp_matches(value, '{audit.PLACEHOLDERS}') THEN 'placeholder credential assignment' ELSE 'sensitive key assignment' END"),
        (f"regexp_matches(low, '{audit.TOKEN_PARAMETERS}') AND octet_length(encode(content)) >= 16", "'URL token'", "'Medium'", "'token-like URL parameter'"),
        (f"regexp_matches(low, '{audit.OVERRIDES}')", "'Instruction override'", "'Medium'", "'instruction override pattern'"),
        (f"contains(content, '@') AND {email}", "'Email address'", "'Low'", "'email address'"),
        (f"regexp_matches(content, '(^|[^0-9])1[3-9][0-9]{{9}}([^0-9]|$)') OR ((contains(content, '+') OR regexp_matches(low, '{audit.PHONE_WORDS}')) AND {digits} BETWEEN 7 AND 15)", "'Phone number'", "'Medium'", "'phone number'"),
    ]
    unions = " UNION ALL ".join(f"SELECT path, line, {kind} AS kind, {severity} AS severity, {evidence} AS evidence FROM valued_{name} WHERE {rule}" for rule, kind, severity, evidence in rules)
    return f"{numbered(docs, 'lines_' + name)}, lowered_{name} AS (SELECT *, {low} AS low FROM lines_{name}), valued_{name} AS (SELECT *, {value} AS value FROM lowered_{name}), {name} AS ({unions})"


def scores(terms: list[str], where: str = "TRUE", name: str = "scored") -> str:
    n = len(terms)
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = {quoted(t)})) AS BIGINT) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(n))
    part = [f"CASE WHEN tf{i} = 0 THEN 0.0::DOUBLE ELSE ln(1.0::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * (tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (greatest(dl, 1)::DOUBLE / mean)))) END" for i in range(n)]
    count = lambda c: " + ".join(f"(length({c}) - length(replace({c}, {quoted(t)}, ''))) // {len(t)}" for t in terms)
    covered = " + ".join(f"CASE WHEN tf{i} > 0 OR contains(lower(path), {quoted(t)}) OR contains(name, {quoted(t)}) THEN 1 ELSE 0 END" for i, t in enumerate(terms))
    return f"""
base_{name} AS (SELECT doc_id, text, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(doc_id AS VARCHAR) || '.txt' AS name, len({lines('text')}) AS end_line, {words('text')} AS w FROM documents WHERE {where}),
tf_{name} AS (SELECT *, len(w) AS dl, {tf} FROM base_{name}),
stats_{name} AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(1.0, avg(dl)) AS mean, {df} FROM tf_{name}),
matched_{name} AS (SELECT *, {' + '.join(f'tf{i}' for i in range(n))} AS text_matches, {' + '.join(f'CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END' for i in range(n))} AS matched, {covered} AS covered, {count('lower(path)')} AS path_matches, {count('name')} AS name_matches, {' + '.join(part)} AS bm25 FROM tf_{name}, stats_{name}),
parts_{name} AS (SELECT doc_id, path, text, end_line, CAST(round(bm25 * 10) AS BIGINT) AS lexical_score, CAST(matched * 3 AS BIGINT) AS text_match_score, CAST(covered * 6 AS BIGINT) AS term_coverage_score,
  CAST(CASE WHEN {n} > 1 AND covered = {n} THEN 18 ELSE 0 END AS BIGINT) AS full_coverage_score, CAST(path_matches * 2 AS BIGINT) AS path_match_score, CAST(0 AS BIGINT) AS title_match_score, CAST(name_matches * 3 AS BIGINT) AS file_name_match_score,
  CAST(1 AS BIGINT) AS file_kind_score, CAST(CASE WHEN text_matches < {n} THEN 0 ELSE least(text_matches * 2, 8) END AS BIGINT) AS density_score, text_matches, matched, covered FROM matched_{name} WHERE text_matches + path_matches + name_matches > 0),
{name} AS (SELECT *, lexical_score + text_match_score + term_coverage_score + full_coverage_score + path_match_score + title_match_score + file_name_match_score + file_kind_score + density_score AS score FROM parts_{name})"""


PARTS = "lexical_score, text_match_score, term_coverage_score, full_coverage_score, path_match_score, title_match_score, file_name_match_score, file_kind_score, density_score"
FOLDERED = "foldered AS (SELECT doc_id, string_split(path, '/')[1] AS file, doc_id + 1 AS start_line, end_line, text, score, path_match_score, file_name_match_score FROM scored)"
FLOORED = """
topped AS (SELECT *, max(score) OVER () AS top, max(score) OVER (PARTITION BY file) AS best FROM foldered),
named AS (SELECT *, max(CASE WHEN score = best THEN path_match_score > 0 OR file_name_match_score > 0 END) OVER (PARTITION BY file) AS named, (top + 3) // 4 AS least, (top + 1) // 2 AS dominant, (best + 9) // 10 AS local FROM topped),
floored AS (SELECT *, best >= least AND (named OR best >= dominant) AND score >= local AS kept FROM named)"""


def document_form(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x09\x0B-\x1F\x7F-\x{{9F}}]', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(t)


def markup(t: str) -> str:
    for name in ("script", "style"):
        t = rf"regexp_replace({t}, '(?is)<\s*{name}([\s/][^>]*)?>.*?(<\s*/+{name}([\s/][^>]*)?(>|$)|$)', chr(1), 'g')"
    t = rf"regexp_replace({t}, '<\s*/[^>]*(>|$)', chr(1), 'g')"
    t = rf"regexp_replace({t}, '(?is)<\s*({BLOCK_TAGS.replace(' ', '|')})([\s/][^>]*)?(>|$)', chr(1), 'g')"
    t = rf"regexp_replace({t}, '<[^>]*(>|$)', chr(2), 'g')"
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '\n[\x01\x02]+', chr(10), 'g'), '\x02*\x01[\x01\x02]*', chr(10), 'g'), '\x02+', ' ', 'g')"
    for entity, char in ENTITIES:
        t = f"replace({t}, {quoted(entity)}, {quoted(char)})"
    return document_form(t)


def paragraphs(docs: str) -> str:
    return f"""{numbered(docs)}, parted AS (SELECT *, {blank('content')} AS b, sum(CASE WHEN {blank('content')} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part FROM numbered),
chunks AS (SELECT path, min(line) AS start_line, max(line) AS end_line, string_agg(content, {NL} ORDER BY line) AS text FROM parted WHERE NOT b GROUP BY path, part)"""


HEADING = rf"^[{WS}]*#{{1,6}}([^#{WS}]|[{WS}]+[^{WS}])"


def extracted(docs: str) -> str:
    bare = trim("content")
    heading = rf"length(t) <= 120 AND (regexp_matches(t, '^[0-9\x{{FF10}}-\x{{FF19}}]+[.．、)）]+[^.．、)）]') OR regexp_matches(t, '^[一二三四五六七八九十零〇][、.．)）]') OR (starts_with(t, '第') AND regexp_matches(substr(t, 1, 8), '章|节|部分')) OR regexp_matches(t, '{HEADING}'))"
    fresh = "size = 0 OR heading OR size + len > 1200"
    grown = f"(CASE WHEN {fresh} THEN 0 ELSE size END + len)"
    return f"""{numbered(docs, 'raw')}, filled AS (SELECT path, line, t, length(t) + 1 AS len, {heading} AS heading, regexp_matches(t, '[.。!！?？;；]$') AS sentence, row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM (SELECT path, line, {bare} AS t FROM raw) WHERE t <> ''),
walk AS (SELECT path, i, CAST(1 AS BIGINT) AS part, CAST(CASE WHEN len >= 700 AND sentence THEN 0 ELSE len END AS BIGINT) AS size FROM filled WHERE i = 1
  UNION ALL SELECT f.path, f.i, w.part + CASE WHEN {fresh} THEN 1 ELSE 0 END, CAST(CASE WHEN {grown} >= 700 AND f.sentence THEN 0 ELSE {grown} END AS BIGINT) FROM walk w JOIN filled f ON f.path = w.path AND f.i = w.i + 1),
chunks AS (SELECT f.path, min(f.line) AS start_line, max(f.line) AS end_line, string_agg(t, {NL} ORDER BY f.line) AS text FROM filled f JOIN walk w ON f.path = w.path AND f.i = w.i GROUP BY f.path, w.part)"""


def listed(rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {literals.values(rows)}) AS v(path, text)"


def titled(rows: str, starts: str, title: str, item: str, extra: str = "", seen: str = "TRUE") -> str:
    return f"""WITH docs AS ({rows}), {numbered('docs')}, bare AS (SELECT *, {trim('content')} AS t, {blank('content')} AS b FROM numbered){extra},
flagged AS (SELECT *, {starts} AS starts FROM {'depths' if extra else 'bare'} ),
parted AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part, max(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS seen FROM flagged),
grouped AS (SELECT path, part, min(line) AS start_line, max(line) AS end_line, string_agg(content, {NL} ORDER BY line) AS text, arg_min(t, line) AS t, arg_min(content, line) AS content FROM parted WHERE {seen} GROUP BY path, part)
SELECT path, CASE WHEN part > 0 THEN '{item}' ELSE 'paragraph' END AS chunk_kind, CASE WHEN part > 0 THEN {title} END AS title, start_line, end_line, text FROM grouped WHERE NOT ({blank('text')})"""


def statements(terms: list[str]) -> dict[str, str]:
    scored = scores(terms)
    code_start = f"(regexp_matches(t, '^({CODE_STARTS})') OR (regexp_matches(t, '^(const |let |var |export const )') AND regexp_matches(t, '=>|function')) OR (ends_with(t, '{{') AND contains(t, '(') AND contains(t, ')') AND NOT regexp_matches(lower(t), '^({CONTROL_STARTS})')) OR (ends_with(t, '{{') AND contains(t, '()')))"
    kind_rows = ", ".join(f"('{e}', '{k}')" for k, found in kinds.EXTENSIONS.items() for e in found.split())
    bonus_rows = ", ".join(f"('{e}', {n})" for e, n in kinds.EXTENSION_BONUS.items())
    label_rows = ", ".join(f"('{k}', '{v}')" for k, v in kinds.LABELS.items())
    names = lambda text: ", ".join(quoted(n) for n in text.split())
    snapshots = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k, length(o_orderpriority) AS size, o_custkey AS modified FROM orders),
before AS (SELECT * FROM o WHERE k % 7 <> 0), after AS (SELECT path, size, CASE WHEN k % 5 = 0 THEN modified + 1 ELSE modified END AS modified FROM o WHERE k % 11 <> 0),
diff AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.size = b.size AND a.modified = b.modified THEN 'reused' ELSE 'updated' END AS state FROM before b FULL OUTER JOIN after a ON a.path = b.path)"""
    chunk_md5 = f"SELECT path, start_line, end_line, md5(text) AS text_md5, {tokens_of('text')} AS token_estimate FROM chunks"
    audited = f"WITH {DOCS}, {findings('docs')}"
    custom = "SELECT doc_id, CAST(length(text) AS BIGINT) AS score FROM documents WHERE contains(lower(text), 'thand')"
    rendered = f"token_estimate + {tokens_of(chr(39) + '### ' + chr(39) + ' || file || chr(10) || chr(10) || ' + chr(39) + 'Lines ' + chr(39) + ' || start_line || ' + chr(39) + '-' + chr(39) + ' || end_line || chr(10) || chr(10)')}"
    budgeted = f"""WITH RECURSIVE {scored}, {FOLDERED}, {FLOORED},
c AS (SELECT row_number() OVER (ORDER BY score DESC, file, start_line) AS n, doc_id, file, {rendered.replace('token_estimate', tokens_of('text'), 1)} AS cost FROM floored WHERE kept),
one AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, MAP {{'': CAST(0 AS BIGINT)}} AS m, '' AS d, CAST(0 AS BIGINT) AS had, CAST(0 AS BIGINT) AS was
  UNION ALL SELECT c.n, CASE WHEN fits AND NOT late THEN used + cost ELSE used END, CASE WHEN fits AND NOT late THEN map_concat(m, MAP {{file: h + cost}}) ELSE m END, CASE WHEN NOT fits THEN 'global' WHEN late THEN 'late' ELSE 'selected' END, h, used
  FROM (SELECT c.*, one.used, one.m, coalesce(one.m[c.file], 0) AS h, cost <= 20000 - one.used AS fits, coalesce(one.m[c.file], 0) > 0 AND coalesce(one.m[c.file], 0) + cost > 12000 AS late FROM one JOIN c ON c.n = one.n + 1) c),
put_off AS (SELECT c.*, one.had, row_number() OVER (ORDER BY c.n) AS k FROM one JOIN c ON c.n = one.n WHERE d = 'late'),
two AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT arg_max(used, n) FROM one) AS used, '' AS d UNION ALL SELECT p.k, CASE WHEN p.cost <= 20000 - two.used THEN two.used + p.cost ELSE two.used END, CASE WHEN p.cost <= 20000 - two.used THEN 'selected' ELSE 'per-file' END FROM two JOIN put_off p ON p.k = two.k + 1)
SELECT c.doc_id, coalesce(t.d, one.d) AS decision, c.n AS position, c.cost AS token_estimate,
  CASE coalesce(t.d, one.d) WHEN 'global' THEN 'global budget limit: current ' || one.was || ', candidate ' || c.cost || ', limit 20000' WHEN 'per-file' THEN 'per-file budget limit: current ' || one.had || ', candidate ' || c.cost || ', limit 12000' END AS reason
FROM c JOIN one ON one.n = c.n LEFT JOIN put_off p ON p.n = c.n LEFT JOIN two t ON t.k = p.k"""
    batch = f"""WITH c AS (SELECT doc_id, {words('text')} AS w FROM documents), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(1.0, avg(len(w))) AS mean FROM c),
q AS (SELECT DISTINCT item_id, unnest({words('text')}) AS term FROM benchmark), p AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY term),
b AS (SELECT item_id, doc_id, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))) AS bm25 FROM p JOIN d USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
SELECT item_id AS query_id, count(*) AS n, round(max(bm25), 4) AS best FROM b GROUP BY item_id"""
    preview = f"substr({trim(f'''regexp_replace(text, '[{WS}]+', ' ', 'g')''')}, 1, 160)"
    rust_starts = "before = 0 AND regexp_matches(t, '^((pub )?(struct|enum|trait|fn|mod)|impl) ')"
    depth = """, sums AS (SELECT *, sum(length(regexp_replace(content, '[^{]', '', 'g')) - length(regexp_replace(content, '[^}]', '', 'g'))) OVER (PARTITION BY path ORDER BY line) AS s FROM bare),
floors AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line)) AS depth FROM sums), depths AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line), 0) AS before FROM floors)"""
    rust_title = trim("regexp_replace(regexp_replace(t, '\\{+$', ''), ';+$', '')")
    code_title = trim("regexp_replace(regexp_replace(regexp_replace(t, '\\{+$', ''), ':+$', ''), ';+$', '')")
    heading_title = trim(f"regexp_replace({trim(f'''regexp_replace(content, '^[{WS}]*#{{1,6}}', '')''')}, '^#+|#+$', '', 'g')")
    markdown = lambda rows: f"""WITH all_docs AS ({rows}), {numbered('all_docs', 'every')},
headed AS (SELECT DISTINCT path FROM every WHERE regexp_matches(content, '{HEADING}')),
sections AS (SELECT path, part, min(line) AS start_line, max(line) AS end_line, string_agg(content, {NL} ORDER BY line) AS text, arg_min(content, line) AS content FROM (SELECT *, sum(CASE WHEN regexp_matches(content, '{HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part FROM every WHERE path IN (FROM headed)) GROUP BY path, part),
docs AS (SELECT * FROM all_docs WHERE path NOT IN (FROM headed)), {paragraphs('docs')}
SELECT path, 'markdown section' AS chunk_kind, CASE WHEN part > 0 THEN {heading_title} END AS title, start_line, end_line, text FROM sections WHERE NOT ({blank('text')})
UNION ALL SELECT path, 'paragraph', NULL, start_line, end_line, text FROM chunks"""  # noqa: E731
    summary = f"""concat_ws('; ', CASE WHEN lexical_score > 0 THEN 'BM25 lexical score: ' || lexical_score END, CASE WHEN text_matches > 0 THEN 'exact text matches: ' || text_matches || ', unique terms ' || matched || '/{len(terms)} x 3' END, CASE WHEN covered > 0 THEN 'term coverage: ' || covered || '/{len(terms)} x 6' END,
CASE WHEN full_coverage_score > 0 THEN 'full query coverage bonus: ' || full_coverage_score END, CASE WHEN path_match_score > 0 THEN 'path matches: ' || path_match_score // 2 || ' x 2' END, CASE WHEN file_name_match_score > 0 THEN 'file name matches: ' || file_name_match_score // 3 || ' x 3' END, CASE WHEN file_kind_score > 0 THEN 'file kind bonus: ' || file_kind_score END, CASE WHEN density_score > 0 THEN 'term density bonus: ' || density_score END)"""
    reason = "CASE WHEN NOT kept THEN 'automatic relevance floor: score ' || score || ', file best ' || best || ', file minimum ' || least || ', dominant minimum ' || dominant || ', metadata match ' || named || ', local minimum ' || local END"
    spans = f"""WITH RECURSIVE {DOCS}, {extracted('docs')}, {paragraphs('docs').replace('numbered', 'counted').replace('parted', 'islands').replace('chunks AS', 'whole AS')},
held AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, end_line, text) AS i FROM (SELECT path, start_line, end_line, text FROM chunks UNION ALL SELECT path, start_line, end_line, text FROM whole) WHERE contains(lower(text), 'oren')),
merged AS (SELECT path, i, CAST(1 AS BIGINT) AS span, end_line FROM held WHERE i = 1
  UNION ALL SELECT h.path, h.i, m.span + CASE WHEN h.start_line > m.end_line AND h.start_line <= m.end_line + 2 THEN 0 ELSE 1 END, CASE WHEN h.start_line > m.end_line AND h.start_line <= m.end_line + 2 THEN greatest(h.end_line, m.end_line) ELSE h.end_line END FROM merged m JOIN held h ON h.path = m.path AND h.i = m.i + 1)
SELECT h.path, min(h.start_line) AS start_line, max(h.end_line) AS end_line, md5(string_agg(h.text, chr(10) || chr(10) ORDER BY h.i)) AS text_md5 FROM held h JOIN merged m ON m.path = h.path AND m.i = h.i GROUP BY h.path, m.span"""
    titled_md5 = lambda sql: f"SELECT path, chunk_kind, title, start_line, end_line, md5(text) AS text_md5, {tokens_of('text')} AS token_estimate FROM ({sql})"
    pages_md = r"SELECT CAST(page_id AS VARCHAR) AS path, regexp_replace(html, '<(h[1-6]|title)[^>]*>', chr(10) || '# ', 'g') AS text FROM pages"
    documents = "SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents"
    return {
        "token_estimates": f"SELECT doc_id, {tokens_of('text')} AS tokens, {preview} AS preview FROM documents",
        "token_counts": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
        "term_df": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({words('text')})) AS term FROM documents) GROUP BY term",
        "composite_rank": f"WITH {scored} SELECT path, score, {summary} AS summary FROM scored ORDER BY score DESC, string_split(path, '/'), 1 LIMIT 10",
        "composite_scores": f"WITH {scored} SELECT doc_id, {PARTS}, score FROM scored",
        "rank_custom_scorer": custom,
        "bm25_batch_benchmark": batch,
        "search_exact": f"WITH {scores(['license'])} SELECT doc_id, score FROM scored WHERE contains(lower(text), 'license') OR contains(lower(path), 'license')",
        "search_scope": f"WITH {scores(terms, '''source = 'src1' ''')} SELECT doc_id, score FROM scored",
        "search_grouped": f"WITH {scored}, {FOLDERED}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, start_line) AS k FROM foldered) SELECT file AS path, doc_id, score FROM n WHERE k <= 2 ORDER BY score DESC, file, start_line LIMIT 10",
        "search_totals": f"WITH {scored}, {FOLDERED} SELECT count(*) AS passages, count(DISTINCT file) AS files FROM foldered",
        "audit_documents": f"{audited} SELECT CAST(path AS BIGINT) AS doc_id, line, kind, severity, evidence FROM findings",
        "audit_pages": f"WITH docs AS (SELECT CAST(page_id AS VARCHAR) AS path, html AS text FROM pages), {findings('docs')} SELECT CAST(path AS BIGINT) AS page_id, line, kind, severity, evidence FROM findings",
        "audit_literals": f"WITH docs AS (SELECT * FROM (VALUES {literals.values(literals.AUDIT)}) AS v(path, text)), {findings('docs')} SELECT path, line, kind, severity, evidence FROM findings",
        "audit_severity_counts": f"{audited} SELECT severity, count(*) AS n FROM findings GROUP BY severity",
        "audit_by_label": f"{audited}, f AS (SELECT CAST(path AS BIGINT) AS doc_id, count(*) AS n FROM findings GROUP BY path) SELECT quality, toxic, count(*) AS docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings FROM labels LEFT JOIN f USING (doc_id) GROUP BY quality, toxic",
        "html_extract": f"SELECT page_id, {markup('html')} AS text FROM pages",
        "chunk_paragraphs": f"WITH docs AS (SELECT CAST(page_id AS VARCHAR) AS path, {markup('html')} AS text FROM pages), {paragraphs('docs')} {chunk_md5}",
        "chunk_conversations": f"WITH docs AS (SELECT CAST(conv_id AS VARCHAR) AS path, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id), {paragraphs('docs')} {chunk_md5}",
        "chunk_markdown_literals": markdown(listed(literals.MARKDOWN)),
        "chunk_rust_literals": titled(listed(literals.RUST), rust_starts, rust_title, "rust item", depth),
        "chunk_markdown": titled_md5(markdown(pages_md)),
        "chunk_rust": titled_md5(titled(documents, rust_starts, rust_title, "rust item", depth)),
        "chunk_code": titled_md5(titled(documents, f"{code_start} AND NOT regexp_matches(t, '^(//|#|/\\*|\\*)')", code_title, "code item", seen="seen = 1")),
        "chunk_code_literals": titled(listed(literals.CODE), f"{code_start} AND NOT regexp_matches(t, '^(//|#|/\\*|\\*)')", code_title, "code item", seen="seen = 1"),
        "chunk_table_rows": f"""WITH r AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS path, o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority AS l, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS i FROM orders),
chunks AS (SELECT path, min(i) + 1 AS start_line, max(i) + 1 AS end_line, 'key,status,priority' || chr(10) || string_agg(l, chr(10) ORDER BY i) AS text FROM r GROUP BY path, (i - 1) // 25)
SELECT path, 'key,status,priority' AS title, start_line, end_line, md5(text) AS text_md5, {tokens_of('text')} AS token_estimate FROM chunks""",
        "chunk_extracted": f"WITH RECURSIVE {DOCS}, {extracted('docs')} {chunk_md5}",
        "relevance_floor": f"WITH {scored}, {FOLDERED}, {FLOORED} SELECT doc_id, kept, {reason} AS reason FROM floored",
        "budget_select": budgeted,
        "span_merge": spans,
        "redact_lines": f"{audited}, first AS (SELECT path, line, min(kind) AS kind FROM findings GROUP BY path, line), j AS (SELECT l.path, string_agg(CASE WHEN f.kind IS NULL THEN l.content ELSE '[REDACTED: ' || f.kind || ']' END, chr(10) ORDER BY l.line) AS t, count(f.kind) AS k FROM lines_findings l LEFT JOIN first f ON f.path = l.path AND f.line = l.line GROUP BY l.path) SELECT path, md5(t) AS text_md5 FROM j WHERE k > 0",
        "selected_findings": f"WITH RECURSIVE {DOCS}, {extracted('docs')}, {findings('docs')} SELECT path, line, kind, severity FROM findings f WHERE EXISTS (SELECT 1 FROM chunks c WHERE contains(lower(c.text), 'thand') AND c.path = f.path AND f.line BETWEEN c.start_line AND c.end_line)",
        "privacy_gate_count": f"{audited} SELECT count(*) AS n FROM findings WHERE severity IN ('Medium', 'High')",
        "pack_statistics": f"WITH RECURSIVE {DOCS}, {extracted('docs')}, {findings('docs')} SELECT 'paragraph' AS label, count(*) AS n FROM chunks UNION ALL SELECT severity, count(*) FROM findings GROUP BY severity UNION ALL SELECT kind, count(*) FROM findings GROUP BY kind",
        "scan_kind_counts": f"""WITH f AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM (VALUES {literals.values(literals.FILES)}) AS v(path, size)),
e AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM f),
k AS (SELECT e.*, CASE WHEN lower(name) IN ({names(kinds.TEXT_NAMES)}) THEN 'text' WHEN name = 'Cargo.lock' THEN 'toml' WHEN name IN ({names(kinds.CODE_NAMES)}) THEN 'code' ELSE coalesce(x.kind, 'other') END AS kind FROM e LEFT JOIN (VALUES {kind_rows}) AS x(ext, kind) ON x.ext = e.ext AND e.ext <> '')
SELECT l.label AS kind, count(*) AS n, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS bonus FROM k JOIN (VALUES {label_rows}) AS l(kind, label) ON l.kind = k.kind LEFT JOIN (VALUES {bonus_rows}) AS b(ext, n) ON b.ext = k.ext GROUP BY l.label""",
        "index_diff": f"WITH {snapshots} SELECT path, state FROM diff",
        "index_counts": f"WITH {snapshots} SELECT state, count(*) AS n FROM diff GROUP BY state",
        "index_state": f"WITH {snapshots} SELECT 'same' AS name, true AS fresh UNION ALL SELECT 'changed', count(*) FILTER (state <> 'reused') = 0 FROM diff",
    }
