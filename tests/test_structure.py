from pathlib import Path

from pyspark.sql import functions as F

from quarry.operators.structure import structured_chunks
from quarry.operators.symbols import module_gaps, python_spans

SAMPLE = '''def area(width, height):
    return width * height


class Box:
    sides = 6

    def volume(self, depth):
        return depth * self.sides
'''


def test_sample_chunks(spark):
    df = spark.createDataFrame([("project-a", "app.py", SAMPLE)],
                               "project string, file_path string, content string")
    rows = structured_chunks(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.symbol_name, r.symbol_type, r.start_line, r.end_line, r.path_tokens)
            for r in rows] == [
        (0, "area", "function", 1, 2, "app py"),
        (1, "Box", "class", 5, 9, "app py"),
        (2, "Box.volume", "method", 8, 9, "app py"),
    ]


def test_symbol_naming():
    src = "class C:\n    def m(self):\n        def inner():\n            pass\n    class D:\n        pass\n" \
          "def f():\n    def g():\n        pass\n"
    names = [(s["name"], s["symbol_type"]) for s in python_spans(src)]
    assert names == [("C", "class"), ("C.m", "method"), ("C.inner", "method"), ("D", "class"),
                     ("f", "function"), ("g", "function")]
    assert python_spans("def (:\n") == []
    # a file's byte order mark is removed when it is decoded; the parser takes none
    assert python_spans("\ufeffdef f():\n    pass\n") == []


def test_syntax_error_becomes_module(spark):
    df = spark.createDataFrame([("p", "bad.py", "def (:\n  x\n")],
                               "project string, file_path string, content string")
    (row,) = structured_chunks(df).collect()
    assert row.symbol_type == "module" and row.symbol_name is None
    assert (row.start_line, row.end_line) == (1, 2)


def test_module_gaps_table(spark):
    spans = spark.createDataFrame([("f", 3, 5), ("f", 4, 4), ("f", 8, 9)],
                                  "file_path string, start_line int, end_line int")
    files = spark.createDataFrame([("f", 10), ("g", 7)], "file_path string, n_lines int")
    got = sorted(tuple(r) for r in module_gaps(spans, files, keys=("file_path",)).collect())
    assert got == [("f", 1, 2), ("f", 6, 7), ("f", 10, 10), ("g", 1, 7)]


def test_dense_chunk_index(spark):
    text = "\n\n".join("p" * 700 for _ in range(12))
    df = spark.createDataFrame([("p", "doc.md", text)], "project string, file_path string, content string")
    idx = [r.chunk_index for r in structured_chunks(df).collect()]
    assert sorted(idx) == list(range(len(idx))) and len(idx) > 3


def test_large_overlap_by_hand(spark):
    from quarry.config import DEFAULT_SETTINGS
    from quarry.operators.chunking import chunk_text

    wide = DEFAULT_SETTINGS.with_(chunk_max_chars=1000, chunk_overlap=800)
    df = spark.createDataFrame([(1, "x" * 1500)], "doc_id long, text string")
    rows = chunk_text(df, "text", settings=wide).orderBy("piece_index").collect()
    assert [(r.start_offset, r.end_offset) for r in rows] == [(0, 1000), (200, 1200), (400, 1400), (600, 1500)]


def _chunks(spark, content, path="m.py"):
    df = spark.createDataFrame([("p", path, content)], "project string, file_path string, content string")
    return [(r.content, r.symbol_name, r.symbol_type, r.start_line, r.end_line)
            for r in structured_chunks(df).orderBy("chunk_index").collect()]


def test_form_feeds_and_line_separators_do_not_end_lines(spark):
    assert _chunks(spark, "\x0c\x0c\x0cx = 1") == [("x = 1", None, "module", 1, 1)]
    assert [c[0] for c in _chunks(spark, "\x0c\n\x0ca=1\nb=2\nc=3")] == ["a=1\nb=2\nc=3"]
    got = _chunks(spark, "s = '\u2028'\ndef f():\n    pass\nz = 1\nw = 2\n")
    assert got == [("def f():\n    pass", "f", "function", 2, 3), ("s = '\u2028'", None, "module", 1, 1),
                   ("z = 1\nw = 2", None, "module", 4, 5)]


def test_every_file_that_is_not_blank_has_a_chunk_and_loses_no_word(spark):
    import random

    rng = random.Random(9)
    parts = ["x = 1", "def f():\n    return 1", "\x0c", "\x0b", "\r", "\r\n", "\n", "\u2028", "\x85",
             "class C:\n    y = 2", "\n# note", '"""a\n\nb"""', "(", " ", "\x1c"]
    files = [("p", f"f{i}.py", "".join(rng.choice(parts) + rng.choice(["\n", "", "\n\n"])
                                       for _ in range(rng.randint(1, 7)))) for i in range(300)]
    df = spark.createDataFrame(files, "project string, file_path string, content string")
    got = {}
    for r in structured_chunks(df).collect():
        got.setdefault(r.file_path, []).append(r.content)
    for _, path, content in files:
        if content.strip():
            assert got.get(path), repr(content)
            joined = "\n".join(got[path])
            assert all(w in joined for w in content.split()), (repr(content), got[path])
