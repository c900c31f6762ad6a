"""DuckDB SQL restating each driver query (see ``quarry.plans.driver``)."""

from __future__ import annotations

from quarry.plans import sqlparts as S
from quarry.plans.driver import FALLBACK_MIN_SQL, LSH_BANDS, LSH_BITS, PROBE_BANDS, PROBE_FLIPS, VARIED_LIMIT_SQL

ORACLES: dict[str, str] = {}

ORACLES["search_code"] = S.search_ctes() + S.RESULT_SELECT

ORACLES["search_fallback"] = S.search_ctes(VARIED_LIMIT_SQL, FALLBACK_MIN_SQL) + S.RESULT_SELECT

ORACLES["search_summary"] = S.search_ctes(VARIED_LIMIT_SQL, FALLBACK_MIN_SQL) + """,
per_query AS (
  SELECT query_id, count(*) AS n, bool_or(NOT passes) AS used_fallback,
         max(threshold) AS applied
  FROM results GROUP BY query_id)
SELECT CAST(q.query_id AS BIGINT) AS query_id, 'ok' AS status,
       CAST(coalesce(p.n, 0) AS BIGINT) AS count,
       coalesce(p.used_fallback, false) AS used_fallback,
       round(coalesce(p.applied, q.eff_min), 6) AS applied_min_score
FROM qry q LEFT JOIN per_query p ON p.query_id = q.query_id"""

ORACLES["compact_results"] = S.search_ctes() + f""",
compact AS (
  SELECT *, trim(regexp_replace(content, '{S.WS_RE}+', ' ', 'g')) AS cc FROM results)
SELECT CAST(query_id AS BIGINT) AS query_id, query, project, CAST(rank AS BIGINT) AS rank, file_path,
       round(round(score, 4), 6) AS score,
       CASE WHEN length(cc) <= 400 THEN cc ELSE rtrim(substr(cc, 1, 397)) || '...' END AS snippet,
       nullif(symbol_name, '') AS symbol_name, nullif(symbol_type, '') AS symbol_type,
       nullif(language, '') AS language,
       CAST(CASE WHEN start_line <> 0 THEN start_line END AS BIGINT) AS start_line,
       CAST(CASE WHEN end_line <> 0 THEN end_line END AS BIGINT) AS end_line,
       round(round(semantic_score, 4), 6) AS semantic_score,
       round(round(lexical_score, 4), 6) AS lexical_score
FROM compact"""

ORACLES["lexical_bonus"] = S.search_ctes() + """
SELECT CAST(query_id AS BIGINT) AS query_id, file_path, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(sh AS BIGINT) AS symbol_hits, CAST(ph AS BIGINT) AS path_hits,
       CAST(ch AS BIGINT) AS content_hits, (length(nq) > 0 AND contains(hay, nq)) AS phrase,
       round(lexical_score, 6) AS lexical_score
FROM scored"""

_KNN_PAIRS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS distance,
             list_distance(a.v, b.v) AS euclid
      FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
      FROM p)"""

ORACLES["knn_topk"] = _KNN_PAIRS + """
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(vec_id AS BIGINT) AS vec_id,
       CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance
FROM r WHERE rank <= 10"""

ORACLES["semantic_score"] = _KNN_PAIRS + """
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(vec_id AS BIGINT) AS vec_id,
       CAST(rank AS BIGINT) AS rank,
       round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - distance)), 6) AS cosine_score,
       round(euclid, 6) AS euclidean_distance,
       round(1.0::DOUBLE / (1.0::DOUBLE + greatest(euclid, 0.0::DOUBLE)), 6) AS euclidean_score
FROM r WHERE rank <= 10"""

ORACLES["query_terms"] = "WITH qsrc AS (\n" + """
  SELECT 'benchmark' AS origin, item_id AS qid, text FROM benchmark
  UNION ALL
  SELECT 'conversation', conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
qkey AS (SELECT origin || ':' || CAST(qid AS VARCHAR) AS key, origin, qid, text FROM qsrc),
""" + S.query_terms_ctes("qkey", "key", "text").strip() + """
SELECT k.origin, CAST(k.qid AS BIGINT) AS qid, t.term
FROM terms t JOIN qkey k ON k.key = t.qid"""

ORACLES["synonym_expand"] = "WITH " + S.query_terms_ctes("documents", "doc_id", "text").strip() \
    + """,
syn_terms AS (
  SELECT f.qid, s.val AS term FROM fired f JOIN syn s ON s.key = f.key
  UNION SELECT qid, key FROM fired)
SELECT CAST(qid AS BIGINT) AS doc_id, term FROM syn_terms"""

# ---------------------------------------------------------------------------------------------
# Sources, paths and text.
# ---------------------------------------------------------------------------------------------

from quarry.config import IGNORED_DIRS, SUPPORTED_EXTENSIONS  # noqa: E402
from quarry.plans import fixtures as FX  # noqa: E402

_IGN = "[" + ", ".join(S.q(d) for d in IGNORED_DIRS) + "]"
_EXT = "(" + ", ".join(S.q(e) for e in SUPPORTED_EXTENSIONS) + ")"
_PREFIX = "quarry"

ORACLES["project_discovery"] = f"""
SELECT name, CAST(count(*) AS BIGINT) AS n_files
FROM (SELECT split_part({FX.DOC_DISCOVERY_PATH}, '/', 1) AS name FROM documents)
WHERE name NOT IN {tuple(IGNORED_DIRS)}
GROUP BY name"""

ORACLES["file_scan"] = """
SELECT CAST(page_id AS BIGINT) AS page_id,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project,
       regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) || '.html' AS file_path,
       html AS content
FROM pages"""

ORACLES["tree_scan"] = f"""WITH f AS (
  SELECT {FX.PAGE_PROJECT} AS project, {FX.PAGE_FILE} AS file_path, html,
         page_id % 8 AS kind FROM pages)
SELECT adapter, project, file_path, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS digest
FROM f, (VALUES ('tree'), ('binary')) a(adapter)
WHERE kind NOT IN (0, 3) AND (adapter = 'tree' OR kind NOT IN (1, 2))"""

_DOC_FILES = f"SELECT doc_id, text, {FX.DOC_REL_PATH} AS file_path FROM documents"

ORACLES["path_filter"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, file_path FROM ({_DOC_FILES})
WHERE NOT list_has_any(string_split(file_path, '/'), {_IGN})
  AND lower({S.suffix('file_path')}) IN {_EXT}"""

ORACLES["detect_language"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, file_path, {S.language('file_path')} AS language
FROM ({_DOC_FILES})"""

ORACLES["decode_text"] = """
SELECT CAST(doc_id AS BIGINT) AS doc_id, text AS content, CAST(length(text) AS BIGINT) AS n_chars
FROM documents WHERE length(text) > 0"""

ORACLES["path_tokens"] = f"""
SELECT CAST(page_id AS BIGINT) AS page_id, {S.path_tokens('url')} AS path_tokens FROM pages"""

ORACLES["normalize_text"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, {S.fold('text')} AS folded FROM documents"""

ORACLES["index_name"] = f"""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {S.index_name('p_name', _PREFIX)} AS index_name
FROM part"""

ORACLES["search_text"] = f"""
WITH d AS (
  SELECT doc_id, text, {FX.DOC_MD_PATH} AS fp,
         CASE WHEN lang = 'de' THEN concat('Doc', CAST(doc_id AS STRING)) END AS sym,
         CASE WHEN lang IN ('de', 'es') THEN 'section' END AS styp
  FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       {S.search_text_sql('fp', S.language('fp'), S.path_tokens('fp'), 'text', 'sym', 'styp')}
         AS search_text
FROM d"""

ORACLES["snippet"] = f"""
WITH c AS (SELECT doc_id, text,
                  trim(regexp_replace(text, '{S.WS_RE}+', ' ', 'g'), ' ') AS cc FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CASE WHEN length(cc) <= 400 THEN cc ELSE rtrim(substr(cc, 1, 397), ' ') || '...' END
         AS snippet,
       left(text, 2000) AS preview
FROM c"""

ORACLES["query_dedupe"] = f"""
WITH asked AS (
  SELECT conv_id, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT conv_id, replace(replace(text, ' ', '  '), chr(10), chr(9) || chr(10) || ' ')
  FROM conversations WHERE role = 'user')
SELECT trim(regexp_replace(text, '{S.WS_RE}+', ' ', 'g'), ' ') AS query_key,
       CAST(count(*) AS BIGINT) AS n, CAST(min(conv_id) AS BIGINT) AS first_conv
FROM asked GROUP BY 1"""

# ---------------------------------------------------------------------------------------------
# Chunking and structure.
# ---------------------------------------------------------------------------------------------

_PARA = f"SELECT doc_id, {FX.DOC_PARAGRAPHS} AS text FROM documents"

ORACLES["chunk_text"] = "WITH RECURSIVE src AS (" + _PARA + ")," \
    + S.chunk_ctes("src", ["doc_id"], "text").rstrip() + """
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(piece_index AS BIGINT) AS piece_index, content,
       CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset
FROM ck_out"""

ORACLES["chunk_text_wide"] = "WITH RECURSIVE src AS (" + _PARA + ")," \
    + S.chunk_ctes("src", ["doc_id"], "text", overlap=800).rstrip() + """
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(piece_index AS BIGINT) AS piece_index, content,
       CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset
FROM ck_out"""

ORACLES["chunk_lines"] = "WITH RECURSIVE src AS (" + _PARA + ")," \
    + S.chunk_ctes("src", ["doc_id"], "text").rstrip() + """
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(piece_index AS BIGINT) AS piece_index,
       CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line
FROM ck_out"""

_NL = "chr(10)"
_SPANS = f"""
spans AS (
  SELECT p_partkey, 0 AS span_ord, {FX.PART_CLASS} AS name, 'class' AS symbol_type,
         2 AS start_line, 4 AS end_line,
         concat('class ', {FX.PART_CLASS}, ':', {_NL}, '    def ', {FX.PART_METHOD}, '(self):',
                {_NL}, '        return ', CAST(p_size AS STRING)) AS text
  FROM part WHERE NOT ({FX.PART_BROKEN})
  UNION ALL
  SELECT p_partkey, 1, concat({FX.PART_CLASS}, '.', {FX.PART_METHOD}), 'method', 3, 4,
         concat('def ', {FX.PART_METHOD}, '(self):', {_NL}, '        return ',
                CAST(p_size AS STRING))
  FROM part WHERE NOT ({FX.PART_BROKEN})
  UNION ALL
  SELECT p_partkey, 2, {FX.PART_FUNC}, 'function', 6, 7,
         concat('def ', {FX.PART_FUNC}, '():', {_NL}, '    pass')
  FROM part WHERE NOT ({FX.PART_BROKEN}))"""

ORACLES["symbol_spans"] = "WITH " + _SPANS.strip() + """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(span_ord AS BIGINT) AS span_ord, name,
       symbol_type, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       text
FROM spans"""

ORACLES["module_gaps"] = f"""
WITH s AS (SELECT user_id, {FX.EVENT_START} AS a, {FX.EVENT_END} AS b FROM events),
s2 AS (SELECT user_id, a, max(b) AS b FROM s GROUP BY user_id, a),
c AS (SELECT *, greatest(1, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1)) AS cursor FROM s2)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(cursor AS BIGINT) AS gap_start,
       CAST(a - 1 AS BIGINT) AS gap_end FROM c WHERE a > cursor
UNION ALL
SELECT CAST(user_id AS BIGINT), CAST(greatest(1, max(b) + 1) AS BIGINT), {FX.EVENT_LINES}
FROM s GROUP BY user_id HAVING greatest(1, max(b) + 1) <= {FX.EVENT_LINES}"""

_PY_CHUNKS = f"""
py_files AS (
  SELECT p_partkey, p_brand AS project, {FX.PART_PATH} AS file_path, {FX.PART_SOURCE} AS content,
         {FX.PART_BROKEN} AS broken
  FROM part),
py_chunks AS (
  SELECT f.project, f.file_path, s.span_ord AS chunk_index, s.text AS content, s.name AS symbol_name,
         s.symbol_type, s.start_line, s.start_line + {S.nl_count('s.text')} AS end_line
  FROM py_files f JOIN spans s ON s.p_partkey = f.p_partkey
  UNION ALL
  SELECT project, file_path, 3, concat('# part ', CAST(p_partkey AS STRING)), NULL, 'module', 1, 1
  FROM py_files WHERE NOT broken
  UNION ALL
  SELECT project, file_path, 0, {S.strip('content')}, NULL, 'module', 1,
         1 + {S.nl_count(S.strip('content'))}
  FROM py_files WHERE broken
  UNION ALL
  SELECT n_project, n_path, i, c, n, t, a, b FROM (
    SELECT {FX.BREAK_PROJECT} AS n_project, {FX.BREAK_PATH} AS n_path,
           unnest(CASE WHEN s_suppkey % 2 = 0 THEN [{{'i': 0, 'c': concat('x = ', {FX.BREAK_KEY}),
                    'n': NULL, 't': 'module', 'a': 1, 'b': 1}}]
                  ELSE [{{'i': 0, 'c': concat('def f', {FX.BREAK_KEY}, '():', {_NL}, '    return 1'),
                         'n': concat('f', {FX.BREAK_KEY}), 't': 'function', 'a': 4, 'b': 5}},
                        {{'i': 1, 'c': concat('a = 1', {_NL}, 'b = "{FX.LINE_SEPARATOR}"'), 'n': NULL,
                         't': 'module', 'a': 1, 'b': 2}},
                        {{'i': 2, 'c': concat('z = ', {FX.BREAK_KEY}), 'n': NULL, 't': 'module',
                         'a': 6, 'b': 6}}] END, recursive := true) FROM supplier))"""

ORACLES["structured_chunks"] = "WITH RECURSIVE " + _SPANS.strip() + "," + _PY_CHUNKS + "," + f"""
md_src AS (SELECT source AS project, {FX.DOC_MD_PATH} AS file_path, {FX.DOC_PARAGRAPHS} AS text
           FROM documents),""" + S.chunk_ctes("md_src", ["project", "file_path"], "text").rstrip() \
    + f""",
all_chunks AS (
  SELECT project, file_path, chunk_index, 'py' AS language, content, symbol_name, symbol_type,
         start_line, end_line FROM py_chunks
  UNION ALL
  SELECT project, file_path, piece_index, 'md', content, NULL, NULL, start_line, end_line
  FROM ck_out)
SELECT project, file_path, CAST(chunk_index AS BIGINT) AS chunk_index, language, content,
       {S.path_tokens('file_path')} AS path_tokens, symbol_name, symbol_type,
       CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line
FROM all_chunks"""

ORACLES["build_chunks"] = "WITH RECURSIVE " + f"""
kept AS (
  SELECT 'corpus' AS project, file_path, text FROM ({_DOC_FILES})
  WHERE NOT list_has_any(string_split(file_path, '/'), {_IGN})
    AND lower({S.suffix('file_path')}) IN {_EXT} AND length(text) > 0),""" \
    + S.chunk_ctes("kept", ["project", "file_path"], "text").rstrip() + f""",
typed AS (
  SELECT *, {S.language('file_path')} AS language,
         CASE WHEN {S.language('file_path')} = 'py' THEN 'module' END AS symbol_type,
         {S.path_tokens('file_path')} AS path_tokens
  FROM ck_out)
SELECT project, file_path, CAST(piece_index AS BIGINT) AS chunk_index, language, symbol_type,
       CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, content,
       {S.search_text_sql('file_path', 'language', 'path_tokens', 'content', 'NULL', 'symbol_type')}
         AS search_text
FROM typed"""

# ---------------------------------------------------------------------------------------------
# Embedding, index and registry.
# ---------------------------------------------------------------------------------------------

ORACLES["embed_hash"] = """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t
             FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 512 AS BIGINT) AS bucket
      FROM tok),
c AS (SELECT doc_id, bucket, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
nrm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
SELECT CAST(c.doc_id AS BIGINT) AS doc_id, bucket, round(n / norm, 6) AS weight
FROM c JOIN nrm USING (doc_id)"""

ORACLES["chunk_vectors"] = """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.lang || '/doc' || CAST(d.doc_id AS VARCHAR) || '.txt'
         AS file_path,
       e.vec_id IS NOT NULL AS has_vector, CAST(len(e.embedding) AS BIGINT) AS dim,
       round(sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 6) AS norm
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

ORACLES["index_refresh"] = f"""
SELECT d.source AS project, d.lang || '/doc' || CAST(d.doc_id AS VARCHAR) || '.txt' AS file_path,
       CAST(0 AS BIGINT) AS chunk_index,
       d.lang || '/doc' || CAST(d.doc_id AS VARCHAR) || '.txt#0' AS chunk_key,
       d.text AS content, CAST(len(e.embedding) AS BIGINT) AS dim,
       round({S.DOC_VECTOR}[1]::DOUBLE, 6) AS first, round(list_sum({S.DOC_VECTOR}::DOUBLE[]), 4) AS total
FROM documents d JOIN embeddings e ON {S.DOC_VECTOR_ON}
WHERE NOT (d.source = 'src0' AND d.lang <> 'en')"""

ORACLES["index_summary"] = "WITH RECURSIVE " + f"""
md_src AS (SELECT source AS project, {FX.DOC_MD_PATH} AS file_path, {FX.DOC_PARAGRAPHS} AS text
           FROM documents),""" + S.chunk_ctes("md_src", ["project", "file_path"], "text").rstrip() \
    + """,
per AS (SELECT project, count(DISTINCT file_path) AS files, count(*) AS chunks FROM ck_out
        GROUP BY project),
reg AS (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS project FROM nation)
SELECT r.project, CAST(coalesce(p.files, 0) AS BIGINT) AS files_indexed,
       CAST(coalesce(p.chunks, 0) AS BIGINT) AS chunks_indexed,
       CASE WHEN p.chunks > 0 THEN 'ok' ELSE 'no_chunks' END AS status
FROM reg r LEFT JOIN per p ON p.project = r.project"""

_T0 = f"TIMESTAMP '{FX.REGISTRY_T0}'"
_NOW = f"TIMESTAMP '{FX.REGISTRY_NOW}'"
_CUR = f"""
cur AS (
  SELECT n_name AS name, {FX.NATION_PROJECT_PATH} AS project_path,
         {S.index_name('n_name', _PREFIX)} AS index_name,
         {_T0} + to_hours(n_nationkey) AS created_at, {_T0} + to_hours(n_nationkey) AS updated_at,
         CASE WHEN n_regionkey = 0 THEN NULL ELSE {_T0} + to_days(n_nationkey) END
           AS last_indexed_at,
         CAST(n_nationkey * 10 AS BIGINT) AS cnt
  FROM nation)"""


def _fmt(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_UPSERT = "WITH " + _CUR.strip() + f""",
inc0 AS (SELECT {FX.SUPPLIER_PROJECT} AS name, {FX.SUPPLIER_PATH} AS project_path,
                s_suppkey AS seq
         FROM supplier JOIN nation ON s_nationkey = n_nationkey),
inc AS (SELECT name, project_path FROM (
          SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS r FROM inc0)
        WHERE r = 1),
up AS (
  SELECT coalesce(c.name, i.name) AS name,
         CASE WHEN i.name IS NOT NULL THEN i.project_path ELSE c.project_path END AS project_path,
         CASE WHEN i.name IS NOT NULL THEN {S.index_name('coalesce(c.name, i.name)', _PREFIX)}
              ELSE c.index_name END AS index_name,
         coalesce(c.created_at, {_NOW}) AS created_at,
         CASE WHEN i.name IS NOT NULL THEN {_NOW} ELSE c.updated_at END AS updated_at,
         c.last_indexed_at, coalesce(c.cnt, 0) AS cnt
  FROM cur c FULL OUTER JOIN inc i ON c.name = i.name)"""

ORACLES["project_upsert"] = _UPSERT + f"""
SELECT name, project_path, index_name, {_fmt('created_at')} AS created_at,
       {_fmt('updated_at')} AS updated_at, {_fmt('last_indexed_at')} AS last_indexed_at,
       CAST(cnt AS BIGINT) AS last_indexed_chunk_count
FROM up"""

ORACLES["registry_versions"] = ORACLES["project_upsert"].replace(
    "AS last_indexed_chunk_count\nFROM up", "AS last_indexed_chunk_count, true AS renewed,\n"
    "       (SELECT count(*) FROM nation) AS before\nFROM up")

_ODD = "n_regionkey = 3 AND n_nationkey % 4 = 0"
ORACLES["registry_json"] = "WITH " + _CUR.strip() + f"""
SELECT c.name, CASE WHEN {_ODD} THEN NULL ELSE project_path END AS project_path,
       CASE WHEN {_ODD} THEN NULL ELSE index_name END AS index_name,
       {_fmt(f'CASE WHEN {_ODD} THEN NULL ELSE created_at END')} AS created_at,
       {_fmt('CASE WHEN n_regionkey = 3 THEN NULL ELSE updated_at END')} AS updated_at,
       CAST(NULL AS VARCHAR) AS last_indexed_at,
       CAST(CASE WHEN n_regionkey = 3 AND (n_nationkey % 4 = 0 OR n_nationkey % 3 = 0) THEN 0 ELSE cnt END AS BIGINT)
         AS last_indexed_chunk_count
FROM cur c JOIN nation ON n_name = c.name WHERE n_regionkey IN (0, 3)"""

ORACLES["project_list"] = _UPSERT + f"""
SELECT name, project_path, {_fmt('last_indexed_at')} AS last_indexed_at,
       CAST(cnt AS BIGINT) AS last_indexed_chunk_count
FROM up"""

ORACLES["project_stamp"] = "WITH " + _CUR.strip() + f""",
summ AS (
  SELECT n_name AS project, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE s_acctbal > 0 GROUP BY n_name
  UNION ALL SELECT 'region-' || r_name, 1 FROM region)
SELECT c.name, c.project_path, c.index_name, {_fmt('c.created_at')} AS created_at,
       {_fmt(f'CASE WHEN s.n IS NOT NULL THEN {_NOW} ELSE c.updated_at END')} AS updated_at,
       {_fmt(f'CASE WHEN s.n IS NOT NULL THEN {_NOW} ELSE c.last_indexed_at END')}
         AS last_indexed_at,
       CAST(CASE WHEN s.n IS NOT NULL THEN s.n ELSE c.cnt END AS BIGINT)
         AS last_indexed_chunk_count
FROM cur c LEFT JOIN summ s ON s.project = c.name"""

ORACLES["project_remove"] = "WITH " + _CUR.strip() + """,
rem AS (SELECT DISTINCT name FROM (
          SELECT n_name AS name FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT 'zone-' || r_name FROM region))
SELECT r.name, c.cnt IS NOT NULL AS ok, CAST(coalesce(c.cnt, 0) AS BIGINT) AS chunks_deleted,
       'removed' AS state
FROM rem r LEFT JOIN cur c ON c.name = r.name
UNION ALL
SELECT name, NULL, NULL, 'kept' FROM cur WHERE name NOT IN (SELECT name FROM rem)"""

ORACLES["registry_lookup"] = f"""
WITH reg AS (SELECT DISTINCT source AS name FROM documents),
req AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 23 AS VARCHAR) AS project
        FROM benchmark)
SELECT CAST(q.query_id AS BIGINT) AS query_id, q.project,
       CASE WHEN r.name IS NULL THEN 'not_registered' ELSE 'ok' END AS status,
       CASE WHEN r.name IS NOT NULL THEN {S.index_name('r.name', _PREFIX)} END AS index_name
FROM req q LEFT JOIN reg r ON r.name = q.project"""

# ---------------------------------------------------------------------------------------------
# End to end: build the index with hashed vectors, then search it.
# ---------------------------------------------------------------------------------------------

_INDEXED_CANDIDATES = "WITH RECURSIVE " + f"""
md_src AS (SELECT source AS project, {FX.DOC_MD_PATH} AS file_path, {FX.DOC_PARAGRAPHS} AS text
           FROM documents),""" + S.chunk_ctes("md_src", ["project", "file_path"], "text").rstrip() \
    + f""",
ch AS (
  SELECT project, file_path, piece_index AS chunk_index, 'md' AS language, content,
         {S.path_tokens('file_path')} AS path_tokens, NULL::VARCHAR AS symbol_name,
         NULL::VARCHAR AS symbol_type, start_line, end_line
  FROM ck_out),
st AS (SELECT *, {S.search_text_sql('file_path', 'language', 'path_tokens', 'content',
                                     'symbol_name', 'symbol_type')} AS search_text FROM ch),
qry AS (
  SELECT b.item_id AS query_id, d.source AS project, b.text AS query, 5 AS eff_limit,
         0.10::DOUBLE AS eff_min
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),""" \
    + S.hashed_weights("st", ["project", "file_path", "chunk_index"], "search_text", "cw").rstrip() \
    + "," + S.hashed_weights("qry", ["query_id"], "query", "qw").rstrip() + """,
sim AS (
  SELECT q.query_id, c.file_path, c.chunk_index, sum(q.w * c.w) AS s
  FROM qw q JOIN qry ON qry.query_id = q.query_id
  JOIN cw c ON c.project = qry.project AND c.bucket = q.bucket
  GROUP BY q.query_id, c.file_path, c.chunk_index),
cand0 AS (
  SELECT qry.query_id, qry.eff_limit, qry.eff_min, qry.query,
         least(greatest(qry.eff_limit * 2, qry.eff_limit), 100) AS k,
         st.project, st.file_path, st.chunk_index, st.language, st.content, st.symbol_name,
         st.symbol_type, st.start_line, st.end_line, st.path_tokens,
         1 - coalesce(sim.s, 0.0::DOUBLE) AS distance
  FROM qry JOIN st ON st.project = qry.project
  LEFT JOIN sim ON sim.query_id = qry.query_id AND sim.file_path = st.file_path
                AND sim.chunk_index = st.chunk_index)"""

ORACLES["search_indexed"] = S.search_ctes(candidates=_INDEXED_CANDIDATES).replace(
    "WITH RECURSIVE", "WITH RECURSIVE", 1) + S.RESULT_SELECT


ORACLES["index_run"] = f"""WITH RECURSIVE odd AS (
  SELECT {FX.ODD_PROJECT} AS project, {FX.DOC_MD_PATH} AS file_path, {FX.DOC_PARAGRAPHS} AS text
  FROM documents),""" + S.chunk_ctes("odd", ["project", "file_path"], "text").rstrip() + f""",
per AS (SELECT project, count(DISTINCT file_path) AS files, count(*) AS n FROM ck_out GROUP BY project),
known AS (SELECT DISTINCT project FROM odd WHERE project <> 'src6' UNION ALL SELECT 'nothing')
SELECT k.project, CASE WHEN k.project = 'src5' THEN 0 ELSE coalesce(files, 0) END AS files_indexed,
       CASE WHEN k.project = 'src5' THEN 0 ELSE coalesce(n, 0) END AS chunks_indexed,
       CASE WHEN k.project = 'src5' OR n IS NULL THEN 'no_chunks' ELSE 'ok' END AS status,
       CASE WHEN n IS NULL THEN NULL WHEN k.project = 'src5' THEN '{FX.REGISTRY_T0}'
            ELSE '{FX.REGISTRY_NOW}' END AS last_indexed_at,
       coalesce(n, 0) AS last_indexed_chunk_count, coalesce(n, 0) AS rows_in_index
FROM known k LEFT JOIN per p USING (project)"""

ORACLES["embed_model"] = """SELECT CAST(doc_id AS BIGINT) AS doc_id, """ + ", ".join(
    f"CAST(length(text) - length(replace(text, '{v}', '')) AS BIGINT) AS n_{v}" for v in "aeiou") + """,
       CAST(length(text) AS BIGINT) AS n_chars FROM documents"""

ORACLES["embed_cached"] = f"""
WITH bench AS (SELECT item_id AS id, 0 AS turn, text FROM benchmark),
rest AS (SELECT -item_id - 1 AS id, 0 AS turn, ' ' || replace(text, ' ', '  ') AS text FROM benchmark
         UNION ALL SELECT conv_id, turn + 1, text FROM conversations),
keyed AS (SELECT *, trim(regexp_replace(text, '{S.WS_RE}+', ' ', 'g'), ' ') AS key FROM (
            SELECT *, true AS early FROM bench UNION ALL SELECT *, false FROM rest) x),
n AS (SELECT count(DISTINCT key) FILTER (WHERE early) AS a, count(DISTINCT key) AS b FROM keyed)
SELECT CAST(id AS BIGINT) AS id, CAST(turn AS BIGINT) AS turn,
       CAST(length(key) - length(replace(key, 'a', '')) AS BIGINT) AS n_a,
       CAST(length(key) - length(replace(key, 'u', '')) AS BIGINT) AS n_u,
       a AS added_0, b - a AS added_1, CAST(0 AS BIGINT) AS added_2
FROM keyed, n"""

ORACLES["index_all"] = f"""WITH RECURSIVE odd AS (
  SELECT {FX.ODD_PROJECT} AS project, {FX.DOC_MD_PATH} AS file_path, {FX.DOC_PARAGRAPHS} AS text
  FROM documents),""" + S.chunk_ctes("odd", ["project", "file_path"], "text").rstrip() + f""",
per AS (SELECT project, count(DISTINCT file_path) AS files, count(*) AS n FROM ck_out WHERE project <> 'src5' GROUP BY project),
known AS (SELECT DISTINCT project FROM odd),
run AS (SELECT project, coalesce(files, 0) AS files, coalesce(n, 0) AS n FROM known LEFT JOIN per USING (project))
SELECT project, {S.index_name('project', _PREFIX)} AS index_name, files AS files_indexed, n AS chunks_indexed,
       CASE WHEN project = 'src5' THEN 'failed' WHEN n = 0 THEN 'no_chunks' ELSE 'ok' END AS status,
       CASE WHEN project = 'src5' THEN 'ValueError: text refused' END AS error, n > 0 AS stamped,
       n AS rows, 2 * n AS signatures, (SELECT count(*) FROM run) AS projects,
       (SELECT count(*) FROM run WHERE n > 0) AS projects_indexed, CAST(1 AS BIGINT) AS projects_failed,
       (SELECT CAST(sum(files) AS BIGINT) FROM run) AS all_files, (SELECT CAST(sum(n) AS BIGINT) FROM run) AS all_chunks
FROM run"""

ORACLES["index_drop"] = f"""WITH odd AS (
  SELECT {FX.ODD_PROJECT} AS name, count(*) AS n FROM documents GROUP BY 1)
SELECT name, 'kept' AS state, true AS ok, n AS chunks FROM odd WHERE name NOT IN ('007', 'a:b', '50%')
UNION ALL
SELECT r.name, 'removed', n IS NOT NULL, coalesce(n, 0)
FROM (VALUES ('007'), ('a:b'), ('50%'), ('absent')) r(name) LEFT JOIN odd USING (name)"""


_LSH_RESULT = """,
met AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id FROM probe a JOIN sig b USING (band, bucket)),
r AS (SELECT query_id, vec_id, distance,
             row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
      FROM (SELECT m.query_id, m.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS distance
            FROM met m JOIN e a ON a.vec_id = m.query_id JOIN e b ON b.vec_id = m.vec_id) x)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(vec_id AS BIGINT) AS vec_id,
       CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance
FROM r WHERE rank <= 10"""
_VECTORS = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),"

ORACLES["knn_lsh"] = _VECTORS + S.lsh_buckets("sig", "e", "vec_id", LSH_BANDS, LSH_BITS) \
    + ", probe AS (SELECT * FROM sig)" + _LSH_RESULT

ORACLES["knn_lsh_probe"] = _VECTORS + S.lsh_buckets("sig", "e", "vec_id", PROBE_BANDS, LSH_BITS) + "," \
    + S.lsh_probes("probe", "e", "vec_id", PROBE_BANDS, LSH_BITS, PROBE_FLIPS) + _LSH_RESULT

ORACLES["search_lsh"] = S.search_ctes(candidates=S.ready_vector_candidates("5", "0.10::DOUBLE").replace(
    "cand0 AS (", "every AS (", 1) + "," + S.lsh_buckets("qsig", "qry", "query_id", LSH_BANDS, LSH_BITS) + ","
    + S.lsh_buckets("isig", "idx", "project, file_path, chunk_index", LSH_BANDS, LSH_BITS) + """,
met AS (SELECT DISTINCT q.query_id, i.project, i.file_path, i.chunk_index
        FROM qsig q JOIN isig i USING (band, bucket)),
cand0 AS (SELECT e.* FROM every e JOIN met m USING (query_id, project, file_path, chunk_index))""") \
    + S.RESULT_SELECT


ORACLES["search_stored"] = ORACLES["search_lsh"]


ORACLES["registry_round_trip"] = f"""WITH n AS (
  SELECT DISTINCT split_part({FX.DOC_DISCOVERY_PATH}, '/', 1) AS name FROM documents)
SELECT name, '/ws/' || name AS project_path, {S.index_name('name', _PREFIX)} AS index_name,
       (SELECT count(*) FROM n WHERE name NOT IN {tuple(IGNORED_DIRS)}) AS projects,
       CAST(0 AS BIGINT) AS indexed_projects, CAST(0 AS BIGINT) AS chunks
FROM n WHERE name NOT IN {tuple(IGNORED_DIRS)}"""
