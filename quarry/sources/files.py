"""File tables: adapters, path predicates, decoding and project discovery.

The engine works on one table shape, ``files(project, file_path, content)``, with project-relative
POSIX paths. It can come from any table, from Spark's ``binaryFile`` source, or from a folder-by-folder
listing (see ``tree_source``), which also returns hidden files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import IGNORED_DIRS
from quarry.functions import text as tx


def from_table(df: DataFrame, project: str = "project", file_path: str = "file_path",
               content: str = "content", root: str | Column | None = None,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Adapter A: any table with a project, a path and bytes or text (``keep``: further columns)."""
    path = F.col(file_path)
    if root is not None:
        root_col = F.lit(root) if isinstance(root, str) else root
        path = tx.relative_path(path, root_col)
    return df.select(F.col(project).alias("project"), path.alias("file_path"),
                     F.col(content).alias("content"), *keep)


def from_binary_files(spark: SparkSession, root: str) -> DataFrame:
    """Adapter B: Spark's ``binaryFile`` source below ``root`` (one project per top directory).

    Spark's file listing skips every name that starts with ``_`` or ``.`` (``__init__.py``,
    ``.github/``); use ``from_tree`` when those files matter.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
           .select("path", "content"))
    # file:/x, file:///x and /x name the same folder; other schemes are compared as they are
    below = re.sub("^file:/+", "/", root).rstrip("/")
    rel = tx.relative_path(F.regexp_replace("path", "^file:/+", "/"), F.lit(below))
    return raw.where(F.instr(rel, "/") > 0).select(
        F.split(rel, "/").getItem(0).alias("project"),
        F.regexp_replace(rel, "^[^/]*/", "").alias("file_path"),
        "content",
    )


def from_tree(spark: SparkSession, root: str) -> DataFrame:
    """Adapter C: a tree that all executors see, listed folder by folder (reads hidden files too).

    The tree is listed when this is called, the files are read when the result is. A file or folder that
    cannot be read is a row with NULL content and its error; decoding leaves it out.
    """
    from quarry.sources.tree_source import read_tree

    return read_tree(spark, re.sub("^file:/+", "/", root))


def select_source_files(files: DataFrame) -> DataFrame:
    """Keep supported extensions outside ignored directories (tests the relative path)."""
    return files.where(~tx.in_ignored_dir("file_path") & tx.is_supported_file("file_path"))


def decode_bytes(content) -> Column:
    """UTF-8 when the bytes are valid UTF-8 (a BOM is kept), else ISO-8859-1; ``\\r\\n``/``\\r``
    become ``\\n`` as in text-mode reads."""
    c = tx.col_(content)
    as_text = F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8")) \
        .otherwise(F.decode(c, "ISO-8859-1"))
    return F.regexp_replace(as_text, "\\r\\n?", "\n")


def decode_content(files: DataFrame, column: str = "content") -> DataFrame:
    """Decode a binary ``content`` column (strings pass through) and drop empty files."""
    dtype = dict(files.dtypes)[column]
    decoded = decode_bytes(column) if dtype == "binary" else \
        F.regexp_replace(F.col(column), "\\r\\n?", "\n")
    return files.withColumn(column, decoded).where(F.length(column) > 0)


def discover_projects(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Top-level directory names under a root, minus ignored names, ordered by lower name.

    ``paths`` lists root-relative file paths; names are deduplicated with a partial aggregate.
    """
    top = F.split(F.col(path_col), "/").getItem(0)
    has_sub = F.instr(F.col(path_col), "/") > 0
    names = (paths.where(has_sub).select(top.alias("name")).where(~F.col("name").isin(*IGNORED_DIRS))
             .groupBy("name").agg(F.count(F.lit(1)).alias("n_files")))
    return names.orderBy(F.lower("name"), "name")
