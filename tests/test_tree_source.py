"""Folder-by-folder listing: against a plain walk, errors as rows, files dealt by size."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.config import IGNORED_DIRS, SUPPORTED_EXTENSIONS
from quarry.sources import tree_source as ts
from quarry.sources.files import decode_content, from_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """400 files in some 150 folders up to 8 deep, one project far larger than the others."""
    root, rng = tmp_path_factory.mktemp("tree"), random.Random(1)
    names = ["a", "b", "_p", ".github", "node_modules", "src", "build"]
    for k in range(400):
        project = "big" if k % 4 else f"p{k % 5}"
        folder = root / project / "/".join(rng.choice(names) for _ in range(rng.randrange(0, 8)))
        folder.mkdir(parents=True, exist_ok=True)
        name = f"f{k}{rng.choice(['.py', '.MD', '.png', '', '.json'])}"
        (folder / name).write_bytes(os.urandom(rng.choice([0, 10, 1000, 100_000])))
    (root / "empty").mkdir()
    (root / "node_modules").mkdir(exist_ok=True)
    (root / "loose.py").write_bytes(b"x")
    (root / "big" / "folder.py").mkdir()
    (root / "big" / "nowhere.py").symlink_to(root / "absent")
    (root / "big" / "up").symlink_to(root)
    return root


def walked(root):
    out = {}
    for project in os.listdir(root):
        if project in IGNORED_DIRS or not (root / project).is_dir():
            continue
        for folder, below, names in os.walk(root / project):
            below[:] = [d for d in below if d not in IGNORED_DIRS]
            for name in names:
                full = os.path.join(folder, name)
                if os.path.splitext(name)[1].lower() in SUPPORTED_EXTENSIONS and os.path.isfile(full):
                    with open(full, "rb") as file:
                        out[project, os.path.relpath(full, root / project)] = file.read()
    return out


def test_equals_a_plain_walk(spark, tree):
    rows = from_tree(spark, str(tree)).collect()
    assert all(r.error is None for r in rows) and len(rows) == len({(r.project, r.file_path) for r in rows})
    assert {(r.project, r.file_path): bytes(r.content) for r in rows} == walked(tree)


def test_every_folder_is_listed_once_in_rounds_of_their_depth(spark, tree, monkeypatch):
    rounds = []
    keep = ts.materialise
    monkeypatch.setattr(ts, "materialise", lambda df, name: rounds.append(name) or keep(df, name))
    listed = ts.list_tree(spark, str(tree))
    folders = Counter((r.project, r.path) for r in listed.where("kind = 'folder'").collect())
    assert len(folders) > 60 and set(folders.values()) == {1}
    deepest = max(p.count("/") + 2 if p else 1 for _, p in folders)
    assert len(rounds) == deepest + 1


def test_unreadable_folders_and_files_are_rows(spark, tree, tmp_path):
    ((project, path, kind, size, error),) = ts.list_folder(str(tree), "big", "gone")
    assert (project, path, kind, size) == ("big", "gone", None, None) and error.startswith("FileNotFoundError")
    assert ts.list_folder(str(tree), "big", "f.py/x")[0][4]
    (tmp_path / "p").mkdir()
    for name in ("here.py", "gone.py"):
        (tmp_path / "p" / name).write_bytes(b"x = 1")
    listed = ts.list_tree(spark, str(tmp_path)).unionByName(
        spark.createDataFrame([("p", "shut", None, None, "PermissionError: shut")], ts._LISTED))
    files = ts.read_files(listed, str(tmp_path))
    (tmp_path / "p" / "gone.py").rename(tmp_path / "moved.py")  # after the listing, before the reading
    got = {r.file_path: (r.content and bytes(r.content), r.error) for r in files.collect()}
    assert got["here.py"] == (b"x = 1", None) and got["shut"] == (None, "PermissionError: shut")
    assert got["gone.py"][0] is None and got["gone.py"][1].startswith("FileNotFoundError") and len(got) == 3
    assert [r.file_path for r in decode_content(files).collect()] == ["here.py"]


def test_files_are_dealt_by_size(spark, tree):
    listed = ts.list_tree(spark, str(tree))
    files = ts.read_files(listed, str(tree), task_bytes=1 << 18)
    total = listed.agg(F.sum("size")).first()[0]
    loads = [r.n for r in files.groupBy(F.spark_partition_id().alias("t")).agg(
        F.sum(F.length("content")).alias("n")).collect()]
    assert len(loads) > 8 and max(loads) < 2.5 * total / len(loads)


def test_missing_and_empty_roots(spark, tmp_path):
    assert from_tree(spark, str(tmp_path / "absent")).count() == 0
    assert from_tree(spark, f"file:{tmp_path}").count() == 0
