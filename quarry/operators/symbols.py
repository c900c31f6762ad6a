"""Python symbol spans and the module-level line ranges between them.

Spans need a real parser, so they come from the standard library's ``ast`` in an Arrow-batched
UDF: one call per Python file, returning that file's spans as an array (bounded by the file).
Everything downstream (sorting, gaps, chunking) is Spark SQL.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_, count_char, strip

SPAN_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


_LINE_END = re.compile(r"\r\n|\n|\r")


class _Segments:
    """``ast.get_source_segment`` with the source split once (the stdlib splits it per call,
    which is quadratic for large files). Lines keep their ends; form feeds do not split."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        pos = 0
        for m in _LINE_END.finditer(source):
            self.lines.append(source[pos:m.end()])
            pos = m.end()
        self.lines.append(source[pos:])
        self._encoded: dict[int, bytes] = {}

    def _enc(self, i: int) -> bytes:
        b = self._encoded.get(i)
        if b is None:
            b = self._encoded[i] = self.lines[i].encode()
        return b

    def get(self, node) -> str | None:
        end_lineno, end_col = getattr(node, "end_lineno", None), getattr(node, "end_col_offset", None)
        if end_lineno is None or end_col is None:
            return None
        first, last, col = node.lineno - 1, end_lineno - 1, node.col_offset
        if first == last:
            return self._enc(first)[col:end_col].decode()
        head = self._enc(first)[col:].decode()
        tail = self._enc(last)[:end_col].decode()
        return head + "".join(self.lines[first + 1:last]) + tail


def python_spans(source: str) -> list[dict]:
    """Classes, functions and methods in pre-order.

    Methods are named ``Class.method`` (nested classes extend the prefix, but a nested class's own
    name is not qualified); a function nested in a function is a plain ``function``. Files that
    do not parse yield no spans.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    spans: list[dict] = []
    segments = _Segments(source)

    def add(node, name: str, kind: str) -> None:
        start, end = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        if start is None or end is None:
            return
        segment = segments.get(node)
        if not segment:
            return
        spans.append({"name": name, "symbol_type": kind, "start_line": start,
                      "end_line": end, "text": segment.strip()})

    def walk(node, classes: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                add(child, child.name, "class")
                walk(child, classes + (child.name,))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if classes:
                    add(child, ".".join(classes + (child.name,)), "method")
                else:
                    add(child, child.name, "function")
                walk(child, classes)
            else:
                walk(child, classes)

    try:
        walk(tree, ())
    except RecursionError:
        return []
    return spans


@F.pandas_udf(T.ArrayType(SPAN_TYPE))
def _spans_udf(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else python_spans(s))


def symbol_spans(content, is_python) -> Column:
    """ARRAY<span> for Python rows, NULL otherwise (only Python rows are sent to the parser)."""
    return _spans_udf(F.when(col_(is_python), col_(content)))


def total_lines(content) -> Column:
    """Number of ``\\n`` plus one: the one line rule of spans, gaps and extracts."""
    return count_char(content) + 1


def gap_ranges(spans, n_lines) -> Column:
    """ARRAY<STRUCT<a,b>> of line ranges covered by no span (spans sorted by start, end)."""
    ordered = F.array_sort(F.transform(
        F.coalesce(col_(spans), F.array().cast(T.ArrayType(SPAN_TYPE))),
        lambda s: F.struct(s["start_line"].alias("a"), s["end_line"].alias("b"))))
    range_type = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()),
                                           T.StructField("b", T.IntegerType())]))
    init = F.struct(F.lit(1).alias("cursor"), F.array().cast(range_type).alias("gaps"))

    def merge(acc, sp):
        gaps = F.when(sp["a"] > acc["cursor"],
                      F.array_append(acc["gaps"], F.struct(acc["cursor"].alias("a"),
                                                           (sp["a"] - 1).alias("b"))))
        return F.struct(F.greatest(acc["cursor"], sp["b"] + 1).alias("cursor"),
                        gaps.otherwise(acc["gaps"]).alias("gaps"))

    def finish(acc):
        tail = F.struct(acc["cursor"].alias("a"), col_(n_lines).alias("b"))
        return F.when(acc["cursor"] <= n_lines, F.array_append(acc["gaps"], tail)) \
            .otherwise(acc["gaps"])

    return F.aggregate(ordered, init, merge, finish)


def extract_lines(lines, a, b) -> Column:
    """Lines ``a..b`` (1-based, inclusive) of a split text, joined by ``\\n`` and stripped."""
    return strip(F.array_join(F.slice(lines, a, b - a + 1), "\n"))


def split_lines(content) -> Column:
    """Lines by ``\\n`` only, as they are counted (form feeds and U+2028 do not end a line)."""
    return F.split(col_(content), "\n", -1)


def module_gaps(spans: DataFrame, files: DataFrame, keys=("project", "file_path")) -> DataFrame:
    """Table form: gaps between span rows, per file.

    ``spans`` has ``keys + (start_line, end_line)``; ``files`` has ``keys + (n_lines)``. Spans
    with the same start are first collapsed to their furthest end (map-side partial aggregate),
    which bounds every file's window group by its number of lines, however many spans it has.
    """
    keys = list(keys)
    starts = spans.groupBy(*keys, "start_line").agg(F.max("end_line").alias("end_line"))
    w = Window.partitionBy(*keys).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.lit(1), F.coalesce(F.max("end_line").over(w) + 1, F.lit(1)))
    inner = (starts.withColumn("cursor", cursor)
             .where(F.col("start_line") > F.col("cursor"))
             .select(*keys, F.col("cursor").alias("gap_start"),
                     (F.col("start_line") - 1).alias("gap_end")))
    last = spans.groupBy(*keys).agg(F.max("end_line").alias("max_end"))
    tail = (files.join(last, keys, "left")
            .select(*keys, F.greatest(F.lit(1), F.coalesce(F.col("max_end") + 1, F.lit(1)))
                    .alias("gap_start"), F.col("n_lines").alias("gap_end"))
            .where(F.col("gap_start") <= F.col("gap_end")))
    return inner.unionByName(tail)
