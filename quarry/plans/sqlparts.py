"""SQL fragments for the DuckDB cross-check of the driver queries.

Each fragment restates, in plain SQL over the given tables, what an operator computes; it is
only used to check the Spark plans (``oracle_sql``), never to run the engine.
"""

from __future__ import annotations

from quarry.config import (CHUNK_SPLIT_HINTS, QUERY_TOKEN_PATTERN, STOP_WORDS,
                           TERM_SYNONYMS)
from quarry.functions.text import PY_WHITESPACE, regex_char_class

WS_SQL = "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE)
WS_RE = regex_char_class(PY_WHITESPACE)
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def nl_count(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


def path_tokens(x: str) -> str:
    """Path tokens for lower-case paths (no capital runs, so no look-ahead is needed)."""
    toks = (f"list_filter(list_transform(regexp_extract_all({x}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'),"
            f" lambda t: lower(t)), lambda t: length(t) >= 2)")
    return (f"array_to_string(list_filter({toks}, lambda t, i: list_position({toks}, t) = i), ' ')")


def stop_list() -> str:
    return "(" + ", ".join(q(w) for w in STOP_WORDS) + ")"


def synonym_values() -> str:
    rows = [f"({q(k)}, {q(v)})" for k, vals in TERM_SYNONYMS.items() for v in vals]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS s(key, val)"


def query_terms_ctes(src: str, id_col: str, text_col: str, prefix: str = "") -> str:
    """CTEs ``{prefix}tok``, ``{prefix}terms(qid, term)`` for the query rows of ``src``."""
    return f"""
{prefix}tok0 AS (
  SELECT DISTINCT {id_col} AS qid,
         unnest(regexp_extract_all({fold(text_col)}, '{QUERY_TOKEN_PATTERN}')) AS t
  FROM {src}),
{prefix}tok AS (SELECT qid, t FROM {prefix}tok0 WHERE t NOT IN {stop_list()}),
{prefix}syn AS ({synonym_values()}),
{prefix}fired AS (
  SELECT DISTINCT k.qid, s.key FROM {prefix}tok k JOIN {prefix}syn s
    ON contains(k.t, s.key) OR k.t = s.val),
{prefix}terms AS (
  SELECT qid, t AS term FROM {prefix}tok
  UNION SELECT qid, substr(t, 1, 5) FROM {prefix}tok WHERE length(t) >= 5
  UNION SELECT f.qid, s.val FROM {prefix}fired f JOIN {prefix}syn s ON s.key = f.key
  UNION SELECT qid, key FROM {prefix}fired)"""


# ---------------------------------------------------------------------------------------------
# Shapes derived from the given tables (kept equal to quarry.plans.driver).
# ---------------------------------------------------------------------------------------------

DOC_PATH = "d.lang || '/doc' || CAST(d.doc_id AS VARCHAR) || '.txt'"

_N = "(SELECT count(*) FROM embeddings)"
_TURN = f"CAST((d.doc_id // {_N}) % len(e.embedding) AS BIGINT)"
DOC_VECTOR_ON = f"e.vec_id = d.doc_id % {_N}"
DOC_VECTOR = f"list_concat(e.embedding[{_TURN} + 1:], e.embedding[1:{_TURN}])"

DOC_INDEX = f"""
idx0 AS (
  SELECT d.source AS project, {DOC_PATH} AS file_path, 0 AS chunk_index, 'txt' AS language,
         d.text AS content, NULL::VARCHAR AS symbol_name, NULL::VARCHAR AS symbol_type,
         1 AS start_line, {nl_count('d.text')} + 1 AS end_line, {DOC_VECTOR}::DOUBLE[] AS v
  FROM documents d JOIN embeddings e ON {DOC_VECTOR_ON}),
idx AS (SELECT *, {path_tokens('file_path')} AS path_tokens FROM idx0)"""


def bench_queries(limit_sql: str, min_sql: str) -> str:
    return f"""
qry AS (
  SELECT b.item_id AS query_id, d.source AS project, b.text AS query,
         e.embedding::DOUBLE[] AS v, {limit_sql} AS eff_limit, {min_sql} AS eff_min
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
  JOIN documents d ON d.doc_id = b.item_id)"""


def ready_vector_candidates(limit_sql: str, min_sql: str, multiplier: int = 2) -> str:
    """``qry`` and ``cand0`` (every query x chunk of its project, with the distance) for the
    document index with ready vectors."""
    return f"""WITH {DOC_INDEX},
{bench_queries(limit_sql, min_sql)},
cand0 AS (
  SELECT qry.query_id, qry.eff_limit, qry.eff_min, qry.query,
         least(greatest(qry.eff_limit * {multiplier}, qry.eff_limit), 100) AS k,
         idx.project, idx.file_path, idx.chunk_index, idx.language, idx.content,
         idx.symbol_name, idx.symbol_type, idx.start_line, idx.end_line, idx.path_tokens,
         1 - list_cosine_similarity(qry.v, idx.v) AS distance
  FROM qry JOIN idx ON idx.project = qry.project)"""


def lsh_buckets(name: str, src: str, keys: str, bands: int, bits: int, dim: int = 64, seed: int = 7) -> str:
    """CTEs ``{name}_planes`` and ``{name}(keys, band, bucket)``: signs of ``v`` against the hyperplanes."""
    import numpy as np

    planes = np.random.default_rng(seed).standard_normal((bands * bits, dim))
    rows = ", ".join(f"({j}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])" for j, p in enumerate(planes))
    return f"""
{name}_planes AS (SELECT * FROM (VALUES {rows}) AS t(j, p)),
{name} AS (
  SELECT {keys}, j // {bits} AS band,
         sum(CASE WHEN list_dot_product(v, p) > 0 THEN 1 << (j % {bits}) ELSE 0 END) AS bucket
  FROM {src}, {name}_planes GROUP BY {keys}, j // {bits})"""


def lsh_probes(name: str, src: str, keys: str, bands: int, bits: int, flips: int) -> str:
    """CTE ``{name}(keys, band, bucket)``: own buckets and those behind the ``flips`` smallest products.

    Reads ``{name}_planes`` of ``lsh_buckets`` under the same name with ``_own`` appended.
    """
    return lsh_buckets(f"{name}_own", src, keys, bands, bits) + f""",
{name}_dots AS (
  SELECT {keys}, j // {bits} AS band, j % {bits} AS bit, row_number() OVER (
    PARTITION BY {keys}, j // {bits} ORDER BY abs(list_dot_product(v, p)), j) AS place
  FROM {src}, {name}_own_planes),
{name} AS (
  SELECT {keys}, band, CAST(bucket AS BIGINT) AS bucket FROM {name}_own UNION ALL
  SELECT {keys}, band, xor(CAST(bucket AS BIGINT), CAST(1 << bit AS BIGINT))
  FROM {name}_own JOIN {name}_dots USING ({keys}, band) WHERE place <= {flips})"""


def search_ctes(limit_sql: str = "5", min_sql: str = "0.10::DOUBLE", fallback: float = 0.03,
                multiplier: int = 2, candidates: str | None = None) -> str:
    """CTEs through ``results``; ``candidates`` supplies ``qry`` and ``cand0``."""
    head = candidates or ready_vector_candidates(limit_sql, min_sql, multiplier)
    return f"""{head},
cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                   ORDER BY distance, file_path, chunk_index) AS crank FROM cand0)
  WHERE crank <= k),
{query_terms_ctes("qry", "query_id", "query").strip()},
folded AS (
  SELECT c.*, {fold('c.file_path')} AS ffp, {fold("coalesce(c.symbol_name, '')")} AS fsym,
         {fold("coalesce(c.path_tokens, '')")} AS fptok, {fold('c.content')} AS fbody,
         {strip(fold('c.query'))} AS nq
  FROM cand c),
hay AS (SELECT *, ffp || {NL} || fsym || {NL} || fptok || {NL} || fbody AS hay FROM folded),
hits AS (
  SELECT h.query_id, h.file_path, h.chunk_index,
         count(t.term) FILTER (WHERE contains(h.ffp, t.term) OR contains(h.fptok, t.term)) AS ph,
         count(t.term) FILTER (WHERE contains(h.fsym, t.term)) AS sh,
         count(t.term) FILTER (WHERE contains(h.hay, t.term)) AS ch,
         count(t.term) AS nterms
  FROM hay h LEFT JOIN terms t ON t.qid = h.query_id
  GROUP BY h.query_id, h.file_path, h.chunk_index),
scored AS (
  SELECT h.*, x.ph, x.sh, x.ch, x.nterms,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - h.distance)) AS semantic_score,
         CASE WHEN x.nterms = 0 THEN 0.0::DOUBLE ELSE
           least(x.ph * 0.08::DOUBLE, 0.24::DOUBLE) + least(x.sh * 0.12::DOUBLE, 0.36::DOUBLE)
           + least(x.ch * 0.025::DOUBLE, 0.25::DOUBLE)
           + CASE WHEN length(h.nq) > 0 AND contains(h.hay, h.nq) THEN 0.2::DOUBLE
                  ELSE 0.0::DOUBLE END END AS lexical_score
  FROM hay h JOIN hits x USING (query_id, file_path, chunk_index)),
ranked AS (
  SELECT *, semantic_score + lexical_score AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY semantic_score + lexical_score DESC,
                            distance, file_path, chunk_index) AS rank,
         max(semantic_score + lexical_score) OVER (PARTITION BY query_id) AS best
  FROM scored),
decided AS (
  SELECT *, best >= eff_min AS passes,
         CASE WHEN best >= eff_min THEN eff_min ELSE least({fallback}::DOUBLE, eff_min) END
           AS threshold
  FROM ranked),
results AS (SELECT * FROM decided WHERE score >= threshold AND rank <= eff_limit)"""


RESULT_SELECT = """
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, project, file_path,
       CAST(chunk_index AS BIGINT) AS chunk_index, language, symbol_name, symbol_type,
       CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       round(distance, 6) AS distance, round(semantic_score, 6) AS semantic_score,
       round(lexical_score, 6) AS lexical_score, round(score, 6) AS score
FROM results"""


def hint_regex_sql() -> str:
    alts = "|".join(h[1:].replace("\n", "\\n") for h in CHUNK_SPLIT_HINTS)
    return "(?s)^(.*)\\n(?:" + alts + ")"


__all__ = ["WS_RE", "WS_SQL", "q", "fold", "strip", "nl_count", "path_tokens", "search_ctes",
           "RESULT_SELECT", "hint_regex_sql", "query_terms_ctes"]


def suffix(path: str) -> str:
    return f"regexp_extract(regexp_extract({path}, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1)"


def language(path: str) -> str:
    return f"coalesce(nullif(substr(lower({suffix(path)}), 2), ''), 'text')"


def slug(x: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace({fold(x)}, '[^a-z0-9]+', '-', 'g'), '-'), ''),"
            f" 'project')")


def index_name(x: str, prefix_slug: str) -> str:
    return (f"regexp_replace(left(concat_ws('-', '{prefix_slug[:20]}', left({slug(x)}, 28), "
            f"left(sha1({x}), 8)), 63), '-+$', '')")


def chunk_ctes(src: str, keys: list[str], text: str, prefix: str = "ck", max_chars: int = 1600,
               overlap: int = 200, min_offset: int = 200) -> str:
    """Recursive restatement of the window chunker: CTE ``{prefix}_out(keys, piece_index,
    content, start_line, end_line, start_offset, end_offset)`` (lines relative to base 1)."""
    from quarry.functions.text import NON_WS_CLASS

    k = ", ".join(keys)
    hint = hint_regex_sql()
    nxt = f"greatest(e2 - {overlap}, start + 1)"
    return f"""
{prefix}_in AS (SELECT {k}, {strip(text)} AS t FROM {src}),
{prefix}_steps({k}, t, n, start, nl, done, s, e, sl, el, keep) AS (
  SELECT {k}, t, CAST(length(t) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), length(t) = 0,
         NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false
  FROM {prefix}_in
  UNION ALL
  SELECT {k}, t, n, {nxt}, nl + {nl_count(f"substr(t, start + 1, {nxt} - start)")}, e2 >= n,
         start, e2, nl + 1, nl + 1 + {nl_count("substr(t, start + 1, greatest(e2 - 1 - start, 0))")},
         regexp_matches(substr(t, start + 1, e2 - start), '{NON_WS_CLASS}')
  FROM (SELECT *, CASE WHEN e0 < n AND cut > {min_offset} THEN start + cut ELSE e0 END AS e2
        FROM (SELECT *, least(start + {max_chars}, n) AS e0,
                     length(regexp_extract(substr(t, start + 1, least(start + {max_chars}, n) - start),
                                           '{hint}', 1)) AS cut
              FROM {prefix}_steps WHERE NOT done) {prefix}_x) {prefix}_y),
{prefix}_out AS (
  SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY s) - 1 AS piece_index,
         {strip("substr(t, s + 1, e - s)")} AS content, sl AS start_line, el AS end_line,
         s AS start_offset, e AS end_offset
  FROM {prefix}_steps WHERE s IS NOT NULL AND keep)"""


def search_text_sql(fp: str, lang: str, ptok: str, content: str, sym: str, styp: str) -> str:
    def lab(label, c):
        return f"CASE WHEN length({c}) > 0 THEN '{label}' || {c} END"

    return (f"concat_ws({NL}, 'file_path: ' || {fp}, 'language: ' || {lang}, "
            f"{lab('symbol_name: ', sym)}, {lab('symbol_type: ', styp)}, "
            f"{lab('path_tokens: ', ptok)}, 'content:', nullif({strip(content)}, ''))")


def hashed_weights(src: str, keys: list[str], text: str, name: str, dim: int = 512) -> str:
    """CTE ``{name}(keys, bucket, w)``: the L2-normalised hashed bag of words of ``text``."""
    k = ", ".join(keys)
    return f"""
{name}_tok AS (SELECT {k}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {src}),
{name}_cnt AS (SELECT {k}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket,
                      count(*)::DOUBLE AS n
               FROM {name}_tok GROUP BY ALL),
{name}_norm AS (SELECT {k}, sqrt(sum(n * n)) AS norm FROM {name}_cnt GROUP BY ALL),
{name} AS (SELECT {", ".join("c." + x for x in keys)}, c.bucket, c.n / m.norm AS w
           FROM {name}_cnt c JOIN {name}_norm m USING ({k}))"""
