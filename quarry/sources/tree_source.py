"""Reading a directory tree as ``files`` rows, folder by folder.

``list_tree`` walks the tree breadth first: a round is a table with a row per folder, its folders are
listed by tasks all over the cluster, and the folders found are the next round. Every folder is listed
once, whichever project it belongs to, so one huge project spreads like many small ones. A folder that
cannot be listed becomes a row with its error, as a file does that cannot be read.

``read_files`` deals the listed files to tasks by size: each task of the listing hands its largest files
out first, in turn, so that all readers get about the same number of bytes. Contents leave a task in
bounded batches.

Unlike Spark's file sources this keeps names that start with ``_`` or ``.``. The root is read by the
executors, so on a cluster it must be a path that every executor sees (a shared mount); object stores go
through ``binaryFile``. Links to folders are not followed below a project.
"""

from __future__ import annotations

import os
import stat
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import IGNORED_DIRS, SUPPORTED_EXTENSIONS
from quarry.session import materialise, ship_package

#: Bytes of contents that a reader task aims at, and that leave it at once.
TASK_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
_EXTENSIONS = frozenset(SUPPORTED_EXTENSIONS)
_IGNORED = frozenset(IGNORED_DIRS)
_LISTED = "project string, path string, kind string, size long, error string"
_FILES = "project string, file_path string, content binary, error string"


def list_folder(root: str, project: str, folder: str) -> list[tuple]:
    """(project, path, kind, size, error) of the entries of one folder that matter, in name order.

    ``kind`` is ``folder`` or ``file``; the root (no project) gives the projects. A failure is one row
    without a kind. Ignored folders and files of other extensions are left out.
    """
    out = []
    try:
        with os.scandir(os.path.join(root, project, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if not project:
                    if e.is_dir() and e.name not in _IGNORED:
                        out.append((e.name, "", "folder", None, None))
                elif e.is_dir(follow_symlinks=False):
                    if e.name not in _IGNORED:
                        out.append((project, path, "folder", None, None))
                elif os.path.splitext(e.name)[1].lower() in _EXTENSIONS:
                    try:
                        found = e.stat()
                    except OSError as failure:  # gone, or a link to nowhere: no file to read
                        if not e.is_symlink():
                            out.append((project, path, None, None, f"{type(failure).__name__}: {failure}"))
                        continue
                    if stat.S_ISREG(found.st_mode):
                        out.append((project, path, "file", found.st_size, None))
    except OSError as failure:
        out.append((project, folder, None, None, f"{type(failure).__name__}: {failure}"))
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, kind, size, error) of all folders and supported files below ``root``.

    Each round of folders is written before the next one starts; the driver sees only whether there
    are more.
    """
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for project, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list_folder(root, project, folder)
                if rows:
                    yield _batch(rows, _LISTED)

    tasks = spark.sparkContext.defaultParallelism
    found = None
    folders = spark.createDataFrame([("", "")], "project string, path string")
    while True:
        spread = folders if found is None else folders.repartition(tasks)
        level = materialise(spread.mapInArrow(run, _LISTED), "listing")
        found = level if found is None else found.unionByName(level)
        folders = level.where("kind = 'folder'").select("project", "path")
        if folders.isEmpty():
            return found


def read_files(listed: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(project, file_path, content, error) of the listed files, and the errors of the listing."""
    spark = listed.sparkSession
    total = listed.agg(F.sum("size").alias("n")).first().n or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))

    def deal(batches):
        at = zlib.crc32(str(TaskContext.get().partitionId()).encode())
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: -(r[2] or 0))
            if rows:
                yield _batch([(*r, (at + k) % tasks) for k, r in enumerate(rows)],
                             "project string, path string, size long, error string, task int")
            at += len(rows)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for project, path, _, error, _ in zip(*(c.to_pylist() for c in batch.columns)):
                data = None
                if error is None:
                    try:
                        with open(os.path.join(root, project, path), "rb") as file:
                            data = file.read()
                    except OSError as failure:
                        error = f"{type(failure).__name__}: {failure}"
                rows.append((project, path, data, error))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield _batch(rows, _FILES)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _FILES)

    wanted = listed.where("kind = 'file' or kind is null").select("project", "path", "size", "error")
    dealt = wanted.mapInArrow(deal, "project string, path string, size long, error string, task int")
    return dealt.repartitionById(tasks, F.col("task")).mapInArrow(run, _FILES)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All supported files below ``root``, one project per top folder."""
    if not os.path.isdir(root):
        return spark.createDataFrame([], _FILES)
    return read_files(list_tree(spark, root), root)
