"""Structure-aware file chunks and the project chunk build.

A file row becomes an ordered array of sections - Python symbols first (pre-order), then the
module-level line ranges between them, or the whole file for other languages - and every section
is cut by the window chunker. A Python file whose sections give no chunk falls through to the whole
file, so every file that is not blank has a chunk. One ``posexplode`` of the flattened array yields the chunks with a
dense ``chunk_index``: the whole step is a narrow, per-row transformation (no shuffle), so it
scales with the number of files and is immune to key skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.functions import text as tx
from quarry.operators.chunking import chunk_records, let
from quarry.operators.symbols import extract_lines, gap_ranges, split_lines, symbol_spans, total_lines
from quarry.session import ship_package
from quarry.sources.files import decode_content, select_source_files

SECTION_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("base", T.IntegerType()),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
])

CHUNK_COLUMNS = ["project", "file_path", "chunk_index", "language", "content", "path_tokens",
                 "symbol_name", "symbol_type", "start_line", "end_line"]


def file_sections(content, language) -> F.Column:
    """Ordered ARRAY<section> for one file."""
    is_py = tx.col_(language) == F.lit("py")
    content = tx.col_(content)
    null_s = F.lit(None).cast("string")

    def for_python(spans):
        symbol_sections = F.transform(spans, lambda s: F.struct(
            s["text"].alias("text"), s["start_line"].alias("base"),
            s["name"].alias("symbol_name"), s["symbol_type"].alias("symbol_type")))

        def with_lines(lines):
            gaps = gap_ranges(spans, total_lines(content))
            return F.transform(gaps, lambda g: F.struct(
                extract_lines(lines, g["a"], g["b"]).alias("text"), g["a"].alias("base"),
                null_s.alias("symbol_name"), F.lit("module").alias("symbol_type")))

        return F.concat(symbol_sections, let(split_lines(content), with_lines))

    whole = F.array(F.struct(content.alias("text"), F.lit(1).alias("base"),
                             null_s.alias("symbol_name"), null_s.alias("symbol_type")))
    spans = F.coalesce(symbol_spans(content, is_py),
                       F.array().cast(T.ArrayType(symbol_spans_type())))
    return F.when(is_py, let(spans, for_python)).otherwise(whole).cast(T.ArrayType(SECTION_TYPE))


def symbol_spans_type():
    from quarry.operators.symbols import SPAN_TYPE
    return SPAN_TYPE


def structured_chunks(files: DataFrame, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """``files(project, file_path, content STRING)`` -> chunk table (see ``CHUNK_COLUMNS``)."""
    ship_package(files.sparkSession)
    lang = tx.detect_language("file_path")
    staged = files.select("project", "file_path", "content", lang.alias("language"))
    sections = file_sections(F.col("content"), F.col("language"))

    def cut(section):
        return F.transform(chunk_records(section["text"], section["base"], settings), lambda p: F.struct(
            p["content"].alias("content"), p["start_line"].alias("start_line"),
            p["end_line"].alias("end_line"), section["symbol_name"].alias("symbol_name"),
            section["symbol_type"].alias("symbol_type")))

    whole = F.array(F.struct(F.col("content").alias("text"), F.lit(1).alias("base"),
                             F.lit(None).cast("string").alias("symbol_name"),
                             F.lit(None).cast("string").alias("symbol_type")))
    pieces = let(F.flatten(F.transform(sections, cut)), lambda own: F.when(
        (F.col("language") == "py") & (F.size(own) == 0), F.flatten(F.transform(whole, cut))).otherwise(own))
    # posexplode_outer: a plain posexplode makes the optimizer infer ``size(pieces) > 0`` and
    # push it below any exchange, evaluating the whole chunking (and the parser) twice.
    exploded = staged.select(
        "project", "file_path", "language",
        F.posexplode_outer(pieces).alias("chunk_index", "c")).where(F.col("chunk_index").isNotNull())
    return exploded.select(
        "project", "file_path", "chunk_index", "language",
        F.col("c.content").alias("content"),
        tx.path_tokens("file_path").alias("path_tokens"),
        F.col("c.symbol_name").alias("symbol_name"),
        F.col("c.symbol_type").alias("symbol_type"),
        F.col("c.start_line").alias("start_line"),
        F.col("c.end_line").alias("end_line"),
    )


def with_search_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("search_text", tx.search_text(
        "file_path", "language", "path_tokens", "content", "symbol_name", "symbol_type"))


def build_chunks(raw_files: DataFrame, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Project chunk build: path filters, decode, structure-aware chunks, search text.

    ``raw_files(project, file_path, content BINARY)`` with project-relative paths.
    """
    selected = select_source_files(raw_files)
    decoded = decode_content(selected, "content")
    return with_search_text(structured_chunks(decoded, settings))
