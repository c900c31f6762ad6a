import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import registry as rg
from quarry.operators.embed import attach_vectors, hashed_embedding
from quarry.sources import files as src


def test_decode_and_filters(spark):
    rows = [("p", "a.py", "olá\r\nmundo".encode("latin-1")),
            ("p", "b.md", "olá\r\nmundo".encode("utf-8")),
            ("p", "c.txt", "\ufeffbom".encode("utf-8")),
            ("p", "node_modules/x.js", b"x"), ("p", "img.png", b"x"), ("p", "e.txt", b"")]
    df = spark.createDataFrame(rows, "project string, file_path string, content binary")
    got = {r.file_path: r.content for r in
           src.decode_content(src.select_source_files(df), "content").collect()}
    assert got == {"a.py": "olá\nmundo", "b.md": "olá\nmundo", "c.txt": "\ufeffbom"}


def test_tree_source_keeps_hidden_files(spark):
    root = tempfile.mkdtemp(prefix="quarry-tree-")
    for rel in ["proj/__init__.py", "proj/_priv/d.py", "proj/.github/c.yml", "proj/sub/b.MD",
                "other/x.py"]:
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write("x = 1\n")
    got = sorted((r.project, r.file_path) for r in src.from_tree(spark, root).collect())
    assert got == [("other", "x.py"), ("proj", ".github/c.yml"), ("proj", "__init__.py"),
                   ("proj", "_priv/d.py"), ("proj", "sub/b.MD")]


def test_refresh_keeps_other_projects(spark):
    from quarry.session import scratch_path

    path = scratch_path(spark, "test-index")
    base = spark.createDataFrame(
        [(p, f"f{i}.txt", 0, "txt", "c", "f txt", None, None, 1, 1, [1.0, 0.0])
         for p in ("a", "b") for i in range(3)],
        "project string, file_path string, chunk_index int, language string, content string, "
        "path_tokens string, symbol_name string, symbol_type string, start_line int, "
        "end_line int, embedding array<float>")
    ix.refresh_projects(base, path)
    ix.refresh_projects(base.where("project = 'a' AND file_path = 'f0.txt'"), path)
    ix.refresh_projects(base.where("project = 'a' AND file_path = 'f0.txt'"), path)  # idempotent
    counts = {r.project: r["count"] for r in ix.read_index(spark, path).groupBy("project").count().collect()}
    assert counts == {"a": 1, "b": 3}
    dropped = ix.drop_projects(spark, path, spark.createDataFrame([("b",)], "name string"))
    assert [tuple(r) for r in dropped.collect()] == [("b", 3)]
    assert {r.project for r in ix.read_index(spark, path).collect()} == {"a"}


def test_registry_upsert_stamp_remove(spark):
    cur = rg.upsert_projects(rg.empty_registry(spark),
                             spark.createDataFrame([("A", "/a"), ("  ", "/blank")],
                                                   "name string, project_path string"),
                             now="2024-01-01 00:00:00")
    again = rg.upsert_projects(cur, spark.createDataFrame([("A", "/a2")], "name string, project_path string"),
                               now="2024-02-01 00:00:00")
    (row,) = again.collect()
    assert row.project_path == "/a2" and str(row.created_at).startswith("2024-01-01")
    assert str(row.updated_at).startswith("2024-02-01") and row.last_indexed_chunk_count == 0
    stamped = rg.stamp_indexed(again, spark.createDataFrame([("A", 7), ("Z", 1)],
                                                            "project string, chunks_indexed long"),
                               now="2024-03-01 00:00:00")
    (row,) = stamped.collect()
    assert row.last_indexed_chunk_count == 7
    remaining, outcome = rg.remove_projects(stamped, spark.createDataFrame([("A",), ("Q",)], "name string"))
    assert remaining.count() == 0
    assert sorted(tuple(r) for r in outcome.collect()) == [("A", True, 7), ("Q", False, 0)]


def test_hashed_embedding_and_pairing(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "")], "id long, text string")
    vecs = {r.id: r.v for r in df.select("id", hashed_embedding("text", 16).alias("v")).collect()}
    assert abs(sum(x * x for x in vecs[1]) - 1.0) < 1e-5 and sum(vecs[2]) == 0
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, embedding array<float>")
    matched, missing = attach_vectors(chunks, vectors, "id")
    assert matched.count() == 2 and [r.id for r in missing.collect()] == [3]


def test_binary_file_adapter_and_discovery(spark):
    root = tempfile.mkdtemp(prefix="quarry-bin-")
    for rel in ["alpha/src/a.py", "alpha/README.md", "beta/x.txt", "beta/__init__.py",
                "node_modules/y.js"]:
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write("print(1)\n")
    files = src.from_binary_files(spark, root)
    got = sorted((r.project, r.file_path) for r in files.collect())
    # binaryFile skips names starting with "_" or "." (documented); the tree source keeps them
    assert got == [("alpha", "README.md"), ("alpha", "src/a.py"), ("beta", "x.txt"),
                   ("node_modules", "y.js")]
    paths = files.select(F.concat("project", F.lit("/"), "file_path").alias("path"))
    assert [r.name for r in src.discover_projects(paths).collect()] == ["alpha", "beta"]


def test_registry_round_trip(spark):
    from quarry.session import scratch_path

    path = scratch_path(spark, "test-registry")
    assert rg.load_registry(spark, path).count() == 0  # absent -> empty
    reg = rg.upsert_projects(rg.empty_registry(spark),
                             spark.createDataFrame([("b", "/b"), ("A", "/a")],
                                                   "name string, project_path string"),
                             now="2024-01-01 00:00:00")
    rg.save_registry(reg, path)
    back = rg.load_registry(spark, path)
    assert [r.name for r in rg.list_projects(back).collect()] == ["A", "b"]


def test_model_embedding_backend(spark):
    from quarry.operators.embed import model_embedding

    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    got = sorted(tuple(r.embedding) for r in model_embedding(df, "t", factory).collect())
    assert got == [(2.0, 1.0), (4.0, 1.0)]


def test_index_projects_end_to_end(spark):
    from quarry.operators.embed import hashed_embedding
    from quarry.session import scratch_path

    path = scratch_path(spark, "test-index-projects")
    files = spark.createDataFrame(
        [("a", "x.py", b"def f():\n    return 1\n"), ("a", "README.md", b"# A\n\ntext"),
         ("zz", "y.py", b"x = 1\n"), ("a", "node_modules/z.js", b"1")],
        "project string, file_path string, content binary")
    registry = rg.upsert_projects(
        rg.empty_registry(spark),
        spark.createDataFrame([("a", "/a"), ("b", "/b")], "name string, project_path string"),
        now="2024-01-01 00:00:00")
    summary, after = ix.index_projects(files, path, lambda c: hashed_embedding(c, 32),
                                       registry=registry, now="2024-02-01 00:00:00")
    got = {r.project: (r.files_indexed, r.chunks_indexed, r.status) for r in summary.collect()}
    assert got == {"a": (2, 2, "ok"), "b": (0, 0, "no_chunks")}
    stamped = {r.name: r.last_indexed_chunk_count for r in after.collect()}
    assert stamped == {"a": 2, "b": 0}
    assert {r.project for r in ix.read_index(spark, path).collect()} == {"a"}


def test_registry_json_import(spark):
    import json

    base = tempfile.mkdtemp(prefix="quarry-state-")
    good = os.path.join(base, "projects.json")
    with open(good, "w") as fh:
        json.dump({"projects": {
            "alpha": {"name": "alpha", "project_path": "/w/alpha", "index_name": "x-alpha-1",
                      "created_at": "2024-01-01T00:00:00+00:00",
                      "updated_at": "2024-01-02T00:00:00+00:00",
                      "last_indexed_at": None, "last_indexed_chunk_count": 0},
            "beta": {"project_path": "/w/beta", "last_indexed_at": "2024-03-01T10:00:00+00:00",
                     "last_indexed_chunk_count": 12}}}, fh, indent=2)
    bad = os.path.join(base, "broken.json")
    with open(bad, "w") as fh:
        fh.write("{not json")
    rows = {r.name: r for r in rg.load_registry_json(spark, good).collect()}
    assert set(rows) == {"alpha", "beta"}
    assert rows["beta"].last_indexed_chunk_count == 12 and rows["alpha"].last_indexed_at is None
    assert rows["beta"].last_indexed_at is not None
    assert rg.load_registry_json(spark, bad).count() == 0
    assert rg.load_registry_json(spark, os.path.join(base, "absent.json")).count() == 0


def test_source_tree_fixture_end_to_end(spark):
    from quarry.operators.structure import build_chunks

    root = tempfile.mkdtemp(prefix="quarry-fixture-")
    files = {
        "proj/__init__.py": "def init():\n    return 1\n".encode(),
        "proj/_priv/d.py": "class D:\n    def m(self):\n        pass\n".encode(),
        "proj/.github/c.yml": b"on: push\n",
        "proj/.env.json": b"{}\n",                      # suffix ".json": indexed
        "proj/node_modules/e.js": b"var e = 1;\n",      # ignored directory
        "proj/sub/b.MD": b"# Title\n\nBody\n",
        "proj/logo.png": b"\x89PNG\r\n",                 # unsupported extension
        "proj/empty.py": b"",                            # empty -> skipped
        "proj/latin.txt": "olá çava\n".encode("latin-1"),
        "proj/crlf.py": b"def f():\r\n    return 2\r\n",
        "proj/bom.py": "\ufeffdef g():\n    pass\n".encode("utf-8"),
        "proj/nul.py": b"def h():\n    return '\x00'\n",
    }
    for rel, data in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(data)
    chunks = build_chunks(src.from_tree(spark, root)).collect()
    by_file = {}
    for r in chunks:
        by_file.setdefault(r.file_path, []).append(r)
    assert set(by_file) == {"__init__.py", "_priv/d.py", ".github/c.yml", ".env.json", "sub/b.MD",
                            "latin.txt", "crlf.py", "bom.py", "nul.py"}
    assert [(r.symbol_name, r.symbol_type) for r in by_file["__init__.py"]] == [("init", "function")]
    assert {r.symbol_name for r in by_file["_priv/d.py"]} == {"D", "D.m"}
    assert by_file["latin.txt"][0].content == "olá çava"
    assert by_file["crlf.py"][0].content == "def f():\n    return 2"
    assert by_file["sub/b.MD"][0].language == "md"
    # files the parser rejects (NUL byte) become module chunks; the BOM is kept in the text
    assert {r.symbol_type for r in by_file["nul.py"]} == {"module"}
    assert all(r.project == "proj" for r in chunks)


def test_decode_matches_rule_on_random_bytes(spark):
    import random

    rng = random.Random(51)
    chunks = [b"abc", "é".encode(), "é".encode("latin-1"), b"\r\n", b"\r", b"\n", b"\xef\xbb\xbf",
              b"\xed\xa0\x80", b"\xc0\xaf", b"\xff", "ü€".encode(), b"\x00", b"  "]
    blobs = [b"".join(rng.choice(chunks) for _ in range(rng.randint(1, 12))) for _ in range(400)]

    def rule(data: bytes):
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, content binary")
    got = {r.i: r.t for r in df.select("i", src.decode_bytes("content").alias("t")).collect()}
    assert [got[i] for i in range(len(blobs))] == [rule(b) for b in blobs]


def test_unreadable_registry_is_an_error_not_an_empty_one(spark, tmp_path):
    import pytest

    assert rg.load_registry(spark, str(tmp_path / "absent")).count() == 0
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    (damaged / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        rg.load_registry(spark, str(damaged)).count()


def test_records_with_null_fields_are_still_registered(spark):
    reg = spark.createDataFrame([("p", None, None, None, None, None, None)], rg.REGISTRY_SCHEMA)
    asked = spark.createDataFrame([("p",), ("q",)], "project string")
    assert {r.project: r.status for r in rg.lookup(asked, reg).collect()} == {"p": "ok", "q": "not_registered"}
    _, outcome = rg.remove_projects(reg, spark.createDataFrame([("p",)], "name string"))
    assert outcome.first().ok


def test_repeated_query_ids_are_rejected(spark):
    import pytest
    from quarry.operators.search import search

    index = spark.createDataFrame(
        [("p", "a.txt", 0, "txt", "alpha", "a txt", None, None, 1, 1, [1.0, 0.0])],
        "project string, file_path string, chunk_index int, language string, content string, "
        "path_tokens string, symbol_name string, symbol_type string, start_line int, end_line int, "
        "embedding array<float>")
    queries = spark.createDataFrame([(1, "p", "alpha", [1.0, 0.0]), (1, "p", "beta", [0.0, 1.0])],
                                    "query_id long, project string, query string, embedding array<float>")
    with pytest.raises(ValueError, match="unique"):
        search(index, queries)


def test_file_adapters_on_a_real_tree(spark, tmp_path):
    """Ignored folders and unknown extensions are not opened; ``foo/foo`` stays; unreadable files show."""
    from quarry.sources.files import from_binary_files, from_tree

    for name, data in {"foo/foo.py": b"x", "foo/.git/a.py": b"x", "foo/node_modules/a.js": b"x", "foo/b.bin": b"x",
                       "foo/foo": b"x", "bar/_init.py": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "foo" / "gone.py").symlink_to(tmp_path / "foo" / "b.bin")
    tree = {(r.project, r.file_path) for r in from_tree(spark, str(tmp_path)).collect()}
    assert tree == {("foo", "foo.py"), ("foo", "gone.py"), ("bar", "_init.py")}
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        got = {(r.project, r.file_path) for r in from_binary_files(spark, root).collect()}
        assert ("foo", "foo.py") in got and ("foo", "foo") in got and "" not in {p for p, _ in got}


def test_index_entries_are_completed(spark):
    from quarry.operators.index import with_defaults

    df = spark.createDataFrame([(None, None, "", "", None, None, "kept")],
                               "file_path string, chunk_index int, language string, symbol_name string, "
                               "start_line int, content string, more string")
    assert tuple(with_defaults(df).first()) == ("", 0, "text", None, 0, "", "kept")
