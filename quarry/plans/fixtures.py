"""Test shapes derived from the given tables, as SQL expressions valid in Spark and DuckDB.

They only decide *inputs* (paths, generated Python sources, line intervals, registry records);
the operators under test are the library's, and the oracles restate those separately.
"""

from __future__ import annotations

NL = "chr(10)"

# documents -> project-relative paths with ignored directories and assorted file names.
DOC_TOP = "CASE source WHEN 'src3' THEN 'node_modules' WHEN 'src7' THEN 'build' ELSE source END"
_ID = "CAST(doc_id AS STRING)"
DOC_NAME = (
    "CASE doc_id % 9 "
    f"WHEN 0 THEN concat('doc', {_ID}, '.py') "
    f"WHEN 1 THEN concat('doc', {_ID}, '.md') "
    f"WHEN 2 THEN concat('doc', {_ID}, '.TXT') "
    f"WHEN 3 THEN concat('doc', {_ID}, '.png') "
    f"WHEN 4 THEN concat('Makefile', {_ID}) "
    f"WHEN 5 THEN concat('doc', {_ID}, '.tar.gz') "
    f"WHEN 6 THEN concat('doc', {_ID}, '.Json') "
    f"WHEN 7 THEN concat('.doc', {_ID}) "
    f"ELSE concat('doc', {_ID}, '.yml') END"
)
DOC_REL_PATH = f"concat({DOC_TOP}, '/', lang, '/', {DOC_NAME})"
DOC_DISCOVERY_PATH = f"concat({DOC_TOP}, '/', lang, '/doc', {_ID}, '.txt')"
# Text with blank lines, so the chunker's preferred cut points occur.
DOC_PARAGRAPHS = f"replace(text, '. ', concat('.', {NL}, {NL}))"
DOC_MD_PATH = f"concat(lang, '/doc', {_ID}, '.md')"

# pages -> files on disk: a project and a path, some hidden, ignored or unsupported, one repeating
# the project's name.
PAGE_PROJECT = "concat('site', CAST(page_id % 7 AS STRING))"
_PAGE = "CAST(page_id AS STRING)"
PAGE_FILE = (
    f"CASE page_id % 8 WHEN 0 THEN concat('node_modules/p', {_PAGE}, '.html') "
    f"WHEN 1 THEN concat('sub/_p', {_PAGE}, '.html') WHEN 2 THEN concat('.hidden/p', {_PAGE}, '.html') "
    f"WHEN 3 THEN concat('sub/p', {_PAGE}, '.bin') WHEN 4 THEN concat('site', {_PAGE}, '.HTML') "
    f"ELSE concat('sub/deep/p', {_PAGE}, '.html') END"
)

# Project names that look like numbers or need escaping in a path.
ODD_PROJECT = ("CASE source WHEN 'src1' THEN '007' WHEN 'src2' THEN '7' WHEN 'src3' THEN 'a:b' "
               "WHEN 'src4' THEN '50%' ELSE source END")

# part -> a small Python module per part (every tenth size gets a syntax error).
_PK = "CAST(p_partkey AS STRING)"
PART_CLASS = f"concat(replace(p_brand, '#', ''), 'Part', {_PK})"
PART_METHOD = "concat(lower(p_type), '_', CAST(p_size AS STRING))"
PART_FUNC = f"concat(replace(p_name, ' ', '_'), '_', {_PK})"
PART_BROKEN = "p_size % 10 = 0"
PART_SOURCE = (
    f"concat('# part ', {_PK}, {NL}, 'class ', {PART_CLASS}, ':', {NL}, "
    f"'    def ', {PART_METHOD}, '(self):', {NL}, "
    f"'        return ', CAST(p_size AS STRING), {NL}, {NL}, "
    f"'def ', {PART_FUNC}, CASE WHEN {PART_BROKEN} THEN '(:' ELSE '():' END, {NL}, "
    f"'    pass', {NL})"
)
PART_PATH = f"concat('pkg/', lower(p_type), '/part_', {_PK}, '.py')"

# supplier -> Python files with form feeds and a line separator, which do not end lines.
LINE_SEPARATOR = "\u2028"
BREAK_KEY = "CAST(s_suppkey AS STRING)"
BREAK_PROJECT = "concat('breaks', CAST(s_nationkey AS STRING))"
BREAK_PATH = f"concat('lib/breaks_', {BREAK_KEY}, '.py')"
BREAK_SOURCE = (
    f"CASE WHEN s_suppkey % 2 = 0 THEN concat(chr(12), chr(12), chr(12), 'x = ', {BREAK_KEY}) "
    f"ELSE concat(chr(12), {NL}, chr(12), 'a = 1', {NL}, 'b = \"{LINE_SEPARATOR}\"', {NL}, "
    f"'def f', {BREAK_KEY}, '():', {NL}, '    return 1', {NL}, 'z = ', {BREAK_KEY}) END"
)

# events -> line intervals per user (minute of the month, length from the value).
EVENT_START = "(day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) + 1"
EVENT_END = f"{EVENT_START} + CAST(floor(value) AS BIGINT)"
EVENT_LINES = 44640

# registry records.
NATION_PROJECT_PATH = "concat('/ws/', lower(n_name))"
SUPPLIER_PROJECT = ("CASE WHEN s_acctbal >= 5000 THEN n_name "
                    "ELSE concat(n_name, '-', CAST(s_suppkey AS STRING)) END")
SUPPLIER_PATH = "concat('/incoming/', lower(s_name))"
REGISTRY_T0 = "2024-01-01 00:00:00"
REGISTRY_NOW = "2024-06-01 12:00:00"
