"""DuckDB SQL that gives the rows of the queries, written without their operators."""

from __future__ import annotations

from ..functions.lexicon import ALIASES, CANONICAL, MOST_TAGS, MOST_TERMS
from ..functions.requests import EXTENSIONS, MEDIA_TYPES
from .values import duck_input

_WORDS = "regexp_extract_all({}, '[A-Za-z0-9_-]+')"


def _values(name: str, alias: str = "v") -> str:
    return f"{alias} AS ({duck_input(name)})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in values) + "]"


# Unicode white space as RE2 needs it spelled out.
_S = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_trim(x)}, '{_S}+', ' ', 'g')"


_PAGE = (
    r"(?i)^(?:第\s*\d+\s*页(?:\s*[/共]\s*\d+\s*页)?|-+\s*\d+\s*-+|—\s*\d+\s*—|\d+\s*/\s*\d+"
    r"|page\s+\d+(?:\s*of\s*\d+)?|\d{1,3}|\[\d{1,3}\]|〔\d{1,3}〕)$"
)


def _lines(x: str) -> str:
    return f"string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10))"


def _clean(x: str, repeats: str = "CAST([] AS VARCHAR[])") -> str:
    collapsed = f"list_transform({_lines(x)}, lambda l: {_collapse('l')})"
    kept = f"list_filter({collapsed}, lambda l: NOT regexp_matches(l, '{_PAGE}') AND (l = '' OR NOT list_contains({repeats}, lower(l))))"
    return _trim(f"regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_POSTINGS = f"""
tok AS (SELECT doc_id AS chunk_id, source AS document_id, list_transform({_WORDS.format('text')}, lambda x: lower(x)) AS t FROM documents),
size AS (SELECT chunk_id, document_id, greatest(len(t), 1) AS dl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"""

_BATCH = "q AS (SELECT item_id AS query_id, text, CAST(NULL AS VARCHAR) AS wanted, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"


def _bm25(k: int) -> str:
    return f"""
terms AS (SELECT DISTINCT query_id, wanted, lower(term) AS term FROM (SELECT query_id, wanted, unnest({_WORDS.format('text')}) AS term FROM q)),
bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
       FROM terms JOIN post USING (term) JOIN freq USING (term) JOIN size USING (chunk_id), stats
       WHERE coalesce(wanted, '') = '' OR document_id = wanted GROUP BY ALL),
words AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rnk, chunk_id, score FROM bm) WHERE rnk <= {k})"""


def _near(k: int, stored: str) -> str:
    return f"""
c AS ({stored}),
sims AS (SELECT query_id, chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
         FROM q JOIN c ON q.embedding IS NOT NULL AND (coalesce(wanted, '') = '' OR document_id = wanted)),
near AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rnk, chunk_id, score FROM sims) WHERE rnk <= {k})"""


_LABELS = "SELECT vec_id AS chunk_id, 'label' || label AS document_id, embedding FROM embeddings"
_DOC_VECTORS = "SELECT doc_id AS chunk_id, source AS document_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id"
_FUSED = """
lists AS (SELECT query_id, chunk_id, rnk, score AS vector_score, NULL AS bm25_score FROM near UNION ALL SELECT query_id, chunk_id, rnk, NULL, score FROM words),
sums AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 9) AS score, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score FROM lists GROUP BY ALL),
fused AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rnk, chunk_id, score, vector_score, bm25_score FROM sums)"""
_HYBRID = f"WITH {_BATCH}, {_POSTINGS}, {_bm25(20)}, {_near(20, _DOC_VECTORS)}, {_FUSED}"


def _features(fetched: str = "fused WHERE rnk <= 20") -> str:
    q, p = f"list_distinct(list_transform({_WORDS.format('q.text')}, lambda x: lower(x)))", f"list_transform({_WORDS.format('d.text')}, lambda x: lower(x))"
    return f"""
cand AS (SELECT * FROM {fetched}),
best AS (SELECT query_id, max(bm25_score) AS most FROM cand GROUP BY ALL),
feat AS (SELECT query_id, chunk_id, coalesce(vector_score, 0) AS vec, least(1.0, coalesce(bm25_score, 0) / CASE WHEN most > 0 THEN most ELSE 1.0 END) AS kw,
           CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {p})) / CAST(len({q}) AS DOUBLE) ELSE 0 END AS coverage,
           CASE WHEN length(trim(q.text)) >= 2 AND contains(lower(d.text), lower(trim(q.text))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase, vector_score, bm25_score
         FROM cand JOIN best USING (query_id) JOIN q USING (query_id) JOIN documents d ON d.doc_id = chunk_id),
reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rnk
             FROM (SELECT *, round(0.32::DOUBLE * vec + 0.28::DOUBLE * kw + 0.25::DOUBLE * coverage + 0.15::DOUBLE * phrase, 6) AS score FROM feat))"""


# The tokens of a chunk budget: runs of Latin letters, digits and underscores, or one
# visible character, with the white space before.
_PIECES = f"regexp_extract_all(text, '{_S}*(?:[A-Za-z0-9_]+|[^\\t\\n\\x0B\\f\\r \\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}])')"

_BLANK = f"regexp_matches(text, '^{_S}*$')"
_COUNT = f"greatest(1, len({_PIECES}))"


def _packed(source: str) -> str:
    """Greedy parents of a table of lines (doc_id, i, text): el has them without blank ones,
    numbered and counted, and par the parent of each."""
    return f"""
src AS ({source}),
el AS (SELECT doc_id, text, {_COUNT} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM src WHERE NOT {_BLANK}),
par AS (SELECT doc_id, k, text, n, n AS held, 0 AS p FROM el WHERE k = 1
        UNION ALL SELECT e.doc_id, e.k, e.text, e.n, CASE WHEN held + e.n > 800 THEN e.n ELSE held + e.n END, p + CAST(held + e.n > 800 AS INTEGER) FROM par JOIN el e ON e.doc_id = par.doc_id AND e.k = par.k + 1)"""


_RAW_LINES = "SELECT doc_id, i, l[i] AS text FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_PARENTS = f"""WITH RECURSIVE {_packed(_RAW_LINES)}
SELECT CAST(doc_id AS VARCHAR) AS document_id, p AS parent_no, left(arg_min(text, k), 80) AS title, sha256(string_agg(text, chr(10) ORDER BY k)) AS text_sha256 FROM par GROUP BY doc_id, p"""

# Children: at each line (j) of a parent, where the lines held start (s), what was put out
# before it (f to t); a full child leaves its last lines, from tail on, to the next one.
_CHILDREN = f"""WITH RECURSIVE {_packed(f"SELECT doc_id, i, {_clean('text')} AS text FROM ({_RAW_LINES})")},
own AS (SELECT doc_id, p, list(text ORDER BY k) AS lines, list(n ORDER BY k) AS ns FROM par GROUP BY ALL),
sums AS (SELECT *, list_transform(generate_series(1, len(ns)), lambda x: list_sum(ns[1:x])) AS c FROM own),
line AS (SELECT *, ns[j] AS n, coalesce(list_max(list_filter(generate_series(1, j - 1), lambda x: c[j - 1] - coalesce(c[x - 1], 0) >= 40)), 1) AS tail
         FROM (SELECT *, unnest(generate_series(1, len(ns))) AS j FROM sums)),
kid AS (SELECT doc_id, p, j, CASE WHEN n > 280 THEN j + 1 ELSE j END AS s, CASE WHEN n > 280 THEN 0 ELSE n END AS held, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t FROM line WHERE j = 1
        UNION ALL
        SELECT e.doc_id, e.p, e.j, CASE WHEN e.n > 280 THEN e.j + 1 WHEN held + e.n > 280 AND s <= kid.j THEN greatest(s, e.tail) ELSE s END,
               CASE WHEN e.n > 280 THEN 0 WHEN held + e.n > 280 AND s <= kid.j THEN e.c[e.j] - coalesce(e.c[greatest(s, e.tail) - 1], 0) ELSE held + e.n END,
               CASE WHEN (e.n > 280 OR held + e.n > 280) AND s <= kid.j THEN s END, kid.j
        FROM kid JOIN line e ON e.doc_id = kid.doc_id AND e.p = kid.p AND e.j = kid.j + 1),
parts AS (SELECT doc_id, p, kid.j, 0 AS kind, 0 AS no, array_to_string(lines[f:t], chr(10)) AS content FROM kid JOIN own USING (doc_id, p) WHERE f IS NOT NULL
          UNION ALL SELECT doc_id, p, kid.j + 1, 0, 0, array_to_string(lines[s:kid.j], chr(10)) FROM kid JOIN own USING (doc_id, p) WHERE kid.j = len(lines) AND s <= kid.j
          UNION ALL SELECT doc_id, p, j, 1, no, {_trim("array_to_string(w[no * 240 + 1 : no * 240 + 280], '')")}
                    FROM (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 280) / 240.0) AS INTEGER)))) AS no FROM (SELECT doc_id, p, j, {_PIECES.replace('(text,', '(lines[j],')} AS w FROM line WHERE n > 280)))
SELECT CAST(doc_id AS VARCHAR) AS document_id, p AS parent_no, CAST(row_number() OVER (PARTITION BY doc_id, p ORDER BY j, kind, no) - 1 AS INTEGER) AS child_no, content, left(lines[1], 80) AS context
FROM parts JOIN own USING (doc_id, p) WHERE content <> ''"""

_EVENTS = f"""WITH pieces AS (SELECT conv_id AS query_id, turn AS no, role = 'system' AS thought, text FROM conversations),
said AS (SELECT query_id, no, text, regexp_replace(string_agg(text, '') OVER (PARTITION BY query_id ORDER BY no), '^{_S}+', '') AS t FROM pieces WHERE NOT thought AND text <> ''),
settled AS (SELECT query_id, min(no) FILTER (t <> '' AND NOT starts_with('[知识库]', t) AND NOT starts_with('[模型]', t)) AS pos, max(no) AS last FROM said GROUP BY ALL),
start AS (SELECT q.query_id, coalesce(pos, 1000000) AS pos, coalesce(t, '') AS t FROM (SELECT DISTINCT query_id FROM pieces) q LEFT JOIN settled USING (query_id) LEFT JOIN said ON said.query_id = q.query_id AND said.no = coalesce(pos, last)),
parsed AS (SELECT query_id, pos, CASE WHEN starts_with(t, '[知识库]') THEN 'knowledge_base' ELSE 'model' END AS mode,
             CASE WHEN starts_with(t, '[知识库]') THEN ltrim(t[6:], ' ' || chr(9) || chr(10) || chr(13)) WHEN starts_with(t, '[模型]') THEN ltrim(t[5:], ' ' || chr(9) || chr(10) || chr(13)) ELSE t END AS answer FROM start),
rest AS (SELECT query_id, no, text FROM said JOIN parsed USING (query_id) WHERE no > pos),
every AS (SELECT query_id, -1 AS no, 0 AS k, 'meta' AS type, CAST(NULL AS VARCHAR) AS text FROM parsed
  UNION ALL SELECT query_id, no, 0, 'reasoning', text FROM pieces WHERE thought
  UNION ALL SELECT query_id, pos, 1, 'mode', mode FROM parsed UNION ALL SELECT query_id, pos, 2, 'delta', answer FROM parsed WHERE answer <> ''
  UNION ALL SELECT query_id, no, 1, 'delta', text FROM rest
  UNION ALL SELECT query_id, 2000000, 0, 'end', answer || coalesce((SELECT string_agg(text, '' ORDER BY no) FROM rest r WHERE r.query_id = p.query_id), '') FROM parsed p)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY no, k) - 1 AS INTEGER) AS seq, type, text FROM every"""

_IMAGE_URL = """s AS (SELECT id, trim(coalesce(raw, '')) AS s FROM v),
u AS (SELECT id, CASE WHEN s = '' OR lower(s) LIKE 'data:image%' OR lower(s) LIKE 'http://%' OR lower(s) LIKE 'https://%' THEN s WHEN starts_with(s, 'iVBORw0KGgo') THEN 'data:image/png;base64,' || s ELSE 'data:image/jpeg;base64,' || s END AS url FROM s)"""

_CONTEXTS = """ctx AS (SELECT doc_id - doc_id % 20 AS query_id, string_agg('[' || doc_id || '] 【' || source || ' | ' || lang || '】' || CASE WHEN doc_id % 3 > 0 THEN '（第 ' || doc_id % 3 || ' 页）' ELSE '' END
  || CASE WHEN lang = 'de' THEN ' 实体:de、' || source ELSE '' END || chr(10) || text || CASE WHEN lang = 'fr' THEN chr(10) || '（所属小节）' || chr(10) || source ELSE '' END || chr(10) || chr(10), '' ORDER BY doc_id) AS context FROM documents GROUP BY ALL)"""

_INGESTED = """first AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents),
again AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' revised' ELSE text END AS text FROM documents),
second AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND (text NOT IN (SELECT text FROM documents WHERE text <> '')) AS fresh FROM again)"""

_HAN = r"[\x{4e00}-\x{9fff}]"

# Short lines that stand on many pages of a document, but for long ones with a clinical word.
_REPEATS = f"""{_values('page_elements')},
ok AS (SELECT document_id FROM v WHERE page_number > 0 GROUP BY ALL HAVING count(DISTINCT section_no) >= 3),
keys AS (SELECT DISTINCT document_id, section_no, lower({_collapse('line')}) AS key FROM (SELECT document_id, section_no, unnest({_lines('text')}) AS line FROM v WHERE page_number > 0 AND document_id IN (FROM ok))),
short AS (SELECT * FROM keys WHERE length(key) BETWEEN 2 AND 40),
pages AS (SELECT document_id, count(DISTINCT section_no) AS n_pages FROM short GROUP BY ALL),
found AS (SELECT document_id, key FROM short JOIN pages USING (document_id) WHERE NOT (length(key) > 24 AND regexp_matches(key, '治疗|诊断|患者')) GROUP BY document_id, key, n_pages HAVING count(*) >= greatest(3, ceil(n_pages * 0.4)))"""

# Names in a text by length, names by an alias, drug forms; each once, at its first place.
_TAGS = f"""{_values('questions')},
t AS (SELECT id, coalesce(txt, '') AS t FROM v),
names AS (SELECT unnest({_list(sorted(CANONICAL, key=len, reverse=True))}) AS tag, unnest(generate_series(1, {len(CANONICAL)})) AS k),
known AS (SELECT unnest([{", ".join("{'tag': '" + k + "', 'aliases': " + _list(v) + ", 'k': " + str(1000 + i) + "}" for i, (k, v) in enumerate(ALIASES.items()))}], recursive := true)),
drugs AS (SELECT id, list_filter(regexp_extract_all(t, '{_HAN}{{2,6}}(?:片|胶囊|注射液|缓释片|控释片)'), lambda x: length(x) BETWEEN 3 AND 10) AS d FROM t),
every AS (SELECT id, tag, k FROM t JOIN names ON contains(t, tag) UNION ALL SELECT id, tag, k FROM t JOIN known ON len(list_filter(aliases, lambda a: contains(t, a))) > 0
          UNION ALL SELECT id, d[i], 2000 + i FROM (SELECT id, d, unnest(generate_series(1, len(d))) AS i FROM drugs)),
tags AS (SELECT * FROM (SELECT id, tag, CAST(row_number() OVER (PARTITION BY id ORDER BY min(k)) - 1 AS INTEGER) AS no FROM every GROUP BY id, tag) WHERE no < {MOST_TAGS})"""


def _more() -> str:
    """What tags add, as list elements: names their aliases, aliases their name and its aliases."""
    rows = {name: list(aliases) for name, aliases in ALIASES.items()}
    for name, aliases in ALIASES.items():
        for a in aliases:
            rows.setdefault(a, []).extend([name, *aliases])
    return ", ".join("{'key': '" + k + "', 'list': " + _list(v) + "}" for k, v in rows.items())


_EXPANSIONS = _more()


def _json_text(x: str) -> str:
    """Text of a JSON string, of an array's parts, or of an object's text, content and reasoning."""
    of = lambda e, k: f"coalesce(CASE WHEN json_type({e}->'$.{k}') = 'VARCHAR' THEN {e}->>'$.{k}' WHEN json_type({e}->'$.{k}') = 'ARRAY' THEN array_to_string(list_filter(list_transform(CAST({e}->'$.{k}' AS JSON[]), lambda y: CASE WHEN json_type(y) = 'VARCHAR' THEN y->>'$' END), lambda y: y IS NOT NULL), '') END, '')"
    part = f"CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'OBJECT' THEN {of('e', 'text')} || {of('e', 'content')} ELSE '' END"
    return f"coalesce(CASE json_type({x}) WHEN 'VARCHAR' THEN {x}->>'$' WHEN 'ARRAY' THEN array_to_string(list_transform(CAST({x} AS JSON[]), lambda e: {part}), '') WHEN 'OBJECT' THEN {of(f'({x})', 'text')} || {of(f'({x})', 'content')} || {of(f'({x})', 'reasoning_content')} ELSE '' END, '')"


_FRAME_LIMIT = "CASE WHEN asked <= 0 THEN {d} ELSE least(asked, {m}) END"

SQL = {
    "tokenize_terms": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, list_transform({_WORDS.format('text')}, lambda x: lower(x)) AS t FROM documents)",
    "tokenize_han": f"""WITH {_values('mixed_texts')},
latin AS (SELECT id, lower(unnest({_WORDS.format('txt')})) AS token FROM v),
chars AS (SELECT id, txt, unnest(generate_series(1, length(txt))) AS i FROM v),
han AS (SELECT id, i, substring(txt, i, 1) AS c, CASE WHEN i > 1 THEN substring(txt, i - 1, 1) END AS b FROM chars WHERE regexp_matches(substring(txt, i, 1), '[\\x{{4e00}}-\\x{{9fff}}]')),
every AS (SELECT * FROM latin UNION ALL SELECT id, c FROM han UNION ALL SELECT id, b || c FROM han WHERE regexp_matches(b, '[\\x{{4e00}}-\\x{{9fff}}]'))
SELECT id, token, count(*) AS n FROM every GROUP BY ALL""",
    "term_freq": f"WITH {_POSTINGS} SELECT chunk_id AS doc_id, term, tf FROM post",
    "doc_freq": f"WITH {_POSTINGS} SELECT term, df FROM freq",
    "corpus_stats": f"WITH {_POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_batch": f"WITH {_BATCH}, {_POSTINGS}, {_bm25(10)} SELECT * FROM words",
    "bm25_topk": f"WITH {_BATCH}, {_POSTINGS}, {_bm25(50)} SELECT * FROM words",
    "bm25_filtered": f"WITH q AS (SELECT item_id AS query_id, text, 'src3' AS wanted FROM benchmark), {_POSTINGS}, {_bm25(10)} SELECT * FROM words",
    "vector_batch": f"WITH {_BATCH}, {_near(10, _LABELS)} SELECT * FROM near",
    "vector_topk": f"WITH {_BATCH}, {_near(50, _LABELS)} SELECT * FROM near",
    "vector_filtered": f"WITH {_BATCH.replace('CAST(NULL AS VARCHAR)', chr(39) + 'label1' + chr(39))}, {_near(10, _LABELS)} SELECT * FROM near",
    "rrf_hybrid": f"{_HYBRID} SELECT query_id, rnk, chunk_id, score FROM fused WHERE rnk <= 5",
    "rrf_merge_scores": f"{_HYBRID} SELECT query_id, rnk, chunk_id, score, vector_score, bm25_score FROM fused",
    "rerank_features": f"{_HYBRID}, {_features()} SELECT query_id, chunk_id, round(vec, 6) AS vec, round(kw, 6) AS kw, round(coverage, 6) AS coverage, phrase, score FROM reranked",
    "rerank_topk": f"{_HYBRID}, {_features()} SELECT query_id, rnk, chunk_id, score FROM reranked WHERE rnk <= 5",
    "search_modes": f"""{_HYBRID}, {_features()},
hits AS (SELECT query_id * 10 AS query_id, 'vector' AS mode, rnk, chunk_id, score FROM near UNION ALL SELECT query_id * 10 + 1, 'hybrid', rnk, chunk_id, score FROM fused UNION ALL SELECT query_id * 10 + 2, 'rerank', rnk, chunk_id, score FROM reranked)
SELECT query_id, mode, rnk, chunk_id, source AS document_id, score, CASE WHEN n_chars % 2 = 0 THEN source END AS context, CAST(nullif(n_chars % 3, 0) AS INTEGER) AS page_number,
  CASE WHEN doc_id % 3 = 1 AND source <> text THEN source END AS parent_text, CAST(length(text) AS INTEGER) AS n_text FROM hits JOIN documents ON doc_id = chunk_id WHERE rnk <= 5""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "collapse_space": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "visible_chars": f"SELECT doc_id, CAST(n AS INTEGER) AS n, n >= 40 AS usable FROM (SELECT doc_id, length(regexp_replace(text, '{_S[:-1]}\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) AS n FROM documents)",
    "page_line_filter": f"WITH {_values('page_lines')} SELECT id, regexp_matches({_collapse('line')}, '{_PAGE}') AS is_page FROM v",
    "repeating_lines": f"WITH {_REPEATS} SELECT document_id, key FROM found",
    "clean_elements": f"""WITH {_REPEATS},
every AS (SELECT document_id, list(key) AS keys FROM found GROUP BY ALL),
done AS (SELECT document_id, section_no, element_no, {_clean('text', "coalesce(keys, CAST([] AS VARCHAR[]))")} AS text FROM v LEFT JOIN every USING (document_id) WHERE NOT {_BLANK})
SELECT * FROM done WHERE NOT {_BLANK}""",
    "entity_tag": f"WITH {_TAGS} SELECT id, no, tag FROM tags",
    "expand_query": f"""WITH {_TAGS},
more AS (SELECT unnest([{_EXPANSIONS}], recursive := true)),
terms AS (SELECT id, no, 0 AS j, tag AS term FROM tags UNION ALL SELECT id, no, j, list[j] FROM (SELECT id, no, list, unnest(generate_series(1, len(list))) AS j FROM tags JOIN more ON key = tag)),
fresh AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY min(no * 100 + j)) AS n FROM terms JOIN v USING (id) WHERE term <> '' AND NOT contains(txt, term) GROUP BY id, term),
added AS (SELECT id, string_agg(term, ' ' ORDER BY n) AS t FROM fresh WHERE n <= {MOST_TERMS} GROUP BY ALL)
SELECT id, CASE WHEN t IS NULL THEN txt ELSE txt || ' ' || t END AS expanded FROM v LEFT JOIN added USING (id)""",
    "accept_files": f"""WITH {_values('uploads')},
t AS (SELECT file_no, regexp_extract(file_name, '[^/]+$') AS name, lower(regexp_extract(regexp_extract(file_name, '[^/]+$'), '\\.[^./]+$')) AS extension FROM v)
SELECT file_no, CASE WHEN name <> '' AND NOT starts_with(name, '.') AND list_contains({_list(EXTENSIONS)}, extension) THEN 'accepted' ELSE 'rejected' END AS status, extension,
  CASE extension {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEDIA_TYPES.items())} ELSE '-' END AS media_type FROM t""",
    "ocr_scores": f"""WITH {_values('ocr_texts')},
l AS (SELECT id, txt, confidence, list_transform({_lines('txt')}, lambda x: {_trim('x')}) AS lines FROM v),
g AS (SELECT *, list_filter(lines, lambda x: NOT (length(x) >= 6 AND NOT regexp_matches(x, '{_HAN}') AND len(regexp_extract_all(x, '[A-Za-z]')) >= 6)) AS good FROM l),
j AS (SELECT *, {_trim("regexp_replace(array_to_string(good, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM g)
SELECT id, round(confidence * 100 + 2 * len(regexp_extract_all(txt, '{_HAN}')) - len(regexp_extract_all(txt, '[A-Za-z]')) - 80 * (len(lines) - len(good)), 6) AS score,
  regexp_replace(regexp_replace(regexp_replace(t, '({_HAN}){_S}+({_HAN})', '\\1\\2', 'g'), '({_HAN}){_S}+({_HAN})', '\\1\\2', 'g'), '不超过([1-9]\\d)9([。．]|$)', '不超过\\1%\\2', 'g') AS text FROM j""",
    "delta_extract": f"""WITH {_values('stream_lines')},
t AS (SELECT id, regexp_replace({_trim('line')}, '(?i)^data:', '') AS p FROM v),
j AS (SELECT id, CASE WHEN {_trim('p')} NOT IN ('', '[DONE]') AND json_valid({_trim('p')}) THEN CAST({_trim('p')} AS JSON) END AS j FROM t),
c AS (SELECT id, j, {_json_text("j->'$.choices[0].delta.content'")} || {_json_text("j->'$.choices[0].delta.text'")} AS a, {_json_text("j->'$.choices[0].message.content'")} || {_json_text("j->'$.choices[0].message.text'")} AS b, {_json_text("j->'$.content'")} || {_json_text("j->'$.output_text'")} AS c,
       {_json_text("j->'$.choices[0].delta.reasoning_content'")} || {_json_text("j->'$.choices[0].delta.reasoning'")} AS d, {_json_text("j->'$.choices[0].message.reasoning_content'")} || {_json_text("j->'$.choices[0].message.reasoning'")} AS e, {_json_text("j->'$.reasoning_content'")} AS f FROM j)
SELECT id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS content, CASE WHEN d <> '' THEN d WHEN e <> '' THEN e ELSE f END AS reasoning, j IS NOT NULL AS valid FROM c""",
    "finish_rewrite": f"""WITH {_values('stream_lines')},
t AS (SELECT id, CASE WHEN contains(line, 'tool_call') THEN regexp_replace(line, '"type"\\s*:\\s*(""|null)', '"type":"function"', 'g') ELSE line END AS line FROM v)
SELECT id, CASE WHEN regexp_matches(line, '(?i)"finish_reason"\\s*:\\s*"(stop|length|tool_calls|function_call|content_filter)') THEN line ELSE regexp_replace(line, '"finish_reason"\\s*:\\s*"[^"]*"', '"finish_reason":"stop"', 'g') END AS line FROM t""",
    "paragraphs": f"""WITH {_values('blocks')},
parts AS (SELECT id, list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform({_lines("coalesce(txt, '')")}, lambda l: {_trim('l')}), chr(10)), '\\n{{2,}}'), lambda p: trim(p, chr(10))), lambda p: p <> '') AS p FROM v)
SELECT id, CAST(i - 1 AS INTEGER) AS no, p[i] AS paragraph FROM (SELECT id, p, unnest(generate_series(1, len(p))) AS i FROM parts)""",
    "sliding_split": f"""WITH t AS (SELECT doc_id, {_PIECES} AS p FROM documents),
w AS (SELECT doc_id, p, unnest(generate_series(0, greatest(0, CAST(ceil((len(p) - 280) / 240.0) AS INTEGER)))) AS no FROM t WHERE len(p) > 0)
SELECT doc_id, CAST(no AS INTEGER) AS no, {_trim("array_to_string(p[no * 240 + 1 : no * 240 + 280], '')")} AS piece FROM w""",
    "parent_chunks": _PARENTS,
    "child_chunks": _CHILDREN,
    "answer_events": _EVENTS,
    # of files with equal bytes the first by path is stored, with its hash; names without content have no chunk
    "stream_ingest": "SELECT min('f' || doc_id || '.md') AS document_id, sha256(text) AS content_hash FROM documents GROUP BY text",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "dedup_first": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'skipped' END AS status FROM documents",
    "dedup_anti": "SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'de') GROUP BY text",
    "replace_by_name": """WITH new AS (SELECT source AS document_id, min(doc_id) AS chunk_id FROM documents WHERE lang = 'de' GROUP BY ALL),
every AS (SELECT source AS document_id, doc_id AS chunk_id FROM documents WHERE source NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new)
SELECT document_id, count(*) AS n, min(chunk_id) AS first_chunk FROM every GROUP BY ALL""",
    "catalog_list": "SELECT source AS document_id, source AS file_name, arg_min(n_chars, doc_id) AS file_size, min(doc_id) * 1000 AS uploaded_s, count(*) AS chunk_count FROM documents GROUP BY ALL",
    "detail": """WITH p AS (SELECT source, array_to_string(list_sort(list_distinct(list(n_chars % 7) FILTER (n_chars % 7 > 0))), ',') AS pages, count(*) AS chunk_count FROM documents GROUP BY ALL),
f AS (SELECT source, CASE WHEN length(text) > 300 THEN text[:300] || '…' ELSE text END AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source AS document_id, chunk_count, pages, (SELECT string_agg(t, '|' ORDER BY n) FROM f WHERE f.source = p.source AND n <= 5) AS previews FROM p""",
    "catalog_delete": "SELECT source AS document_id, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src7') GROUP BY ALL",
    "task_rollup": f"""WITH {_values('log')},
last AS (SELECT task_id, file_no, arg_max(status, event_ts) AS status FROM v GROUP BY ALL),
t AS (SELECT task_id, count(*) AS total_files, count(*) FILTER (status NOT IN ('pending', 'processing')) AS processed_files, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'imported') AS i FROM last GROUP BY ALL)
SELECT task_id, total_files, processed_files, CASE WHEN processed_files = 0 THEN 'queued' WHEN processed_files < total_files THEN 'processing' WHEN f > 0 AND i > 0 THEN 'partial_failed' WHEN f > 0 THEN 'failed' ELSE 'completed' END AS status FROM t""",
    "citations": f"""WITH {_values('hits')},
c AS (SELECT query_id, rnk, 'src' || doc AS document_id, coalesce(CAST(vs AS DOUBLE), CAST(s AS DOUBLE)) AS score, page FROM v),
m AS (SELECT *, greatest(0.5, round(max(score) OVER (PARTITION BY query_id) - 0.15, 9)) AS cutoff FROM c),
g AS (SELECT query_id, document_id, min(rnk) AS first, list_sort(list_distinct(list(page) FILTER (page > 0))) AS p FROM m WHERE score >= cutoff GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS source_no, document_id, coalesce(array_to_string(p, ','), '') AS pages FROM g""",
    "history_last6": "SELECT conv_id, turn, CASE WHEN lower(role) = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6",
    "last_user": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE lower(role) = 'user' GROUP BY ALL",
    "prompt_context": f"WITH {_CONTEXTS} SELECT query_id, sha256(context) AS context_sha256 FROM ctx",
    "chat_prompts": f"""WITH {_CONTEXTS},
asked AS (SELECT conv_id AS query_id, arg_max(text, turn) AS text FROM conversations WHERE lower(role) = 'user' GROUP BY ALL),
past AS (SELECT conv_id AS query_id, count(*) AS n, string_agg(CASE WHEN lower(role) = 'assistant' THEN 'assistant' ELSE 'user' END || ':' || CAST(to_json(text) AS VARCHAR), chr(10) ORDER BY turn) AS said
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY ALL),
user_said AS (SELECT query_id, to_json('【知识库上下文】' || chr(10) || coalesce(context, '（知识库为空或没有检索到任何内容）' || chr(10)) || chr(10) || chr(10) || '【用户问题】' || chr(10) || {_trim('text')}) AS q FROM asked LEFT JOIN ctx USING (query_id))
SELECT query_id, CAST(n + 2 AS INTEGER) AS n_messages, sha256('system:"Answer from the context."' || chr(10) || said || chr(10) || 'user:' || CAST(q AS VARCHAR)) AS prompt_sha256 FROM user_said JOIN past USING (query_id)""",
    "message_parts": f"""WITH {_values('images')}, {_IMAGE_URL}
SELECT id, CASE WHEN id % 3 = 0 THEN '"see ' || id || '"' ELSE '[{{"type":"text","text":"see ' || id || '"}}' || CASE WHEN url <> '' THEN ',{{"type":"image_url","image_url":{{"url":' || CAST(to_json(url) AS VARCHAR) || '}}}}' ELSE '' END || ',{{"type":"image_url","image_url":{{"url":"http://second"}}}}]' END AS content FROM u""",
    "upstream_errors": f"WITH {_values('refusals')} SELECT id, CASE status WHEN 429 THEN '429: busy or rate-limited' WHEN 401 THEN '401: key not valid' ELSE status || ': ' || left({_trim("coalesce(body, '')")}, 240) END AS error FROM v",
    "newest_build": f"WITH {_values('builds')} SELECT path FROM v WHERE lower(path) LIKE '%.zip' ORDER BY modificationTime DESC, path DESC LIMIT 1",
    "embedded": "SELECT doc_id AS chunk_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks, 1.0::DOUBLE AS small_call FROM documents",
    # of equal contents the first is stored; the German ones have new contents the second time, the others none
    "ingest_twice": f"""WITH {_INGESTED}
SELECT 't0' AS task_id, doc_id AS file_no, CASE WHEN n = 1 THEN 'imported' ELSE 'skipped' END AS status, CAST(n = 1 AND text <> '' AS INTEGER) AS chunk_count FROM first
UNION ALL SELECT 't1', doc_id, CASE WHEN fresh THEN 'imported' ELSE 'skipped' END, CAST(fresh AND text <> '' AS INTEGER) FROM second""",
    "stored_chunks": f"""WITH {_INGESTED},
gone AS (SELECT doc_id FROM second WHERE fresh AND text <> '')
SELECT 'f' || doc_id || '.md' AS document_id, sha256(text) AS content_hash, octet_length(encode(text)) AS file_size FROM first WHERE n = 1 AND text <> '' AND doc_id NOT IN (FROM gone)
UNION ALL SELECT 'f' || doc_id || '.md', sha256(text), octet_length(encode(text)) FROM second WHERE fresh AND text <> ''""",
    "mode_parse": f"""WITH {_values('answers')}, t AS (SELECT id, best, ltrim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM v)
SELECT id, CASE WHEN starts_with(t, '[知识库]') THEN 'knowledge_base' WHEN starts_with(t, '[模型]') THEN 'model' WHEN coalesce(best, 0) >= 0.45 THEN 'knowledge_base' ELSE 'model' END AS mode,
  CASE WHEN starts_with(t, '[知识库]') THEN ltrim(t[6:], ' ' || chr(9) || chr(10) || chr(13)) WHEN starts_with(t, '[模型]') THEN ltrim(t[5:], ' ' || chr(9) || chr(10) || chr(13)) ELSE t END AS answer FROM t""",
    "sse_frames": """SELECT conv_id, turn, 'event: delta' || chr(10) || 'data: {"type":"' || role || '","seq":' || turn || '}' || chr(10) || chr(10) AS frame FROM conversations""",
    "image_urls": f"WITH {_values('images')}, {_IMAGE_URL} SELECT id, url FROM u",
    "size_clamps": f"WITH {_values('sizes')} SELECT asked, {_FRAME_LIMIT.format(d=5, m=50)} AS search_k, {_FRAME_LIMIT.format(d=8, m=20)} AS chat_k, least(4 * {_FRAME_LIMIT.format(d=5, m=50)}, 50) AS fetch FROM v",
    "request_fields": f"""WITH {_values('fields')}, t AS (SELECT *, rtrim(trim(coalesce(base, '')), '/') AS b FROM v)
SELECT id, CASE WHEN lower(trim(mode)) IN ('vector', 'hybrid') THEN lower(trim(mode)) ELSE 'rerank' END AS mode, CASE WHEN NOT coalesce(thinking, false) THEN 'none' WHEN lower(effort) IN ('low', 'medium', 'high') THEN lower(effort) ELSE 'medium' END AS effort,
  CASE WHEN b = '' THEN 'https://llm.example/v1/chat/completions' WHEN lower(b) LIKE '%/chat/completions' THEN b ELSE b || '/chat/completions' END AS url, b = '' AS blank FROM t""",
    "update_manifest": f"""WITH {_values('settings', 's')}, {_values('manifest_requests', 'r')}, {_values('packages', 'p')},
j AS (SELECT request_id, r.platform, channel, origin, s.* EXCLUDE (platform), enabled AND package_url IN (SELECT path FROM p) AS ok FROM r JOIN s ON s.platform = CASE WHEN lower(coalesce(r.platform, '')) = 'win32-x64' THEN 'win32-x64' ELSE 'win-x64' END)
SELECT request_id, CASE WHEN ok THEN latest_version ELSE '' END AS latest_version, CASE WHEN ok THEN origin || package_url ELSE '' END AS package_url,
  CASE WHEN NOT ok THEN '' WHEN coalesce(platform, '') = '' THEN 'win-x64' ELSE platform END AS platform, CASE WHEN NOT ok THEN '' WHEN coalesce(channel, '') = '' THEN 'stable' ELSE channel END AS channel, ok AND force_update AS force_update FROM j""",
    "table_markdown": f"""WITH {_values('cells')},
c AS (SELECT id, row_no, string_split(cells, ';') AS c, max(len(string_split(cells, ';'))) OVER (PARTITION BY id) AS w, count(*) OVER (PARTITION BY id) AS n FROM v),
r AS (SELECT id, row_no, w, n, '| ' || array_to_string(list_resize(c, w, ''), ' | ') || ' |' || chr(10) AS line FROM c)
SELECT id, max(line) FILTER (row_no = 1) || '|' || repeat(' --- |', any_value(w)) || chr(10) || coalesce(string_agg(line, '' ORDER BY row_no) FILTER (row_no > 1 OR n = 1), '') AS markdown FROM r GROUP BY id""",
}
