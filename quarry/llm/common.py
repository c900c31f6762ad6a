"""Shared helpers: tables, materialisation in the shared folder, byte-level word kernels.

Word rule used by every word-based operator here: lower-case A-Z, then maximal runs of ASCII
letters, ASCII digits and non-ASCII characters. On UTF-8 bytes every byte >= 0x80 belongs to a
non-ASCII character, so the rule is evaluated on raw bytes without building Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package

#: Texts are handled in slices of about this many bytes, so memory does not follow batch size.
SLICE_BYTES = 2 << 20

#: Rows reach Python tasks in batches of at most about this many bytes where ``bounded_batches`` holds.
BATCH_BYTES = 4 << 20

_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        _LOWER[_c] = _c
    elif 0x41 <= _c <= 0x5A:
        _LOWER[_c] = _c + 32

_rng = np.random.default_rng(20240607)
_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and makes the rows a fixed input for everything downstream; the files survive
    the loss of executors because they lie in the folder of ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the tables that ``materialise`` wrote and ``df`` reads, once nothing reads them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of a query go when it ends (its result is a written table), not at a later collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Python tasks get rows of about ``size`` bytes at once, not up to 10,000 rows and 64 MB.

    An executor holds such a batch off its heap and, with copies, in Python, for every running task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ready(spark: SparkSession) -> None:
    """Make the package importable on the executors."""
    ship_package(spark)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective) on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def binary_views(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; NULL counts as empty. No Python strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes (a single longer text forms its own range)."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of consecutive texts held as byte ranges of one normalised buffer.

    ``low``: normalised bytes (0 where no word character stands); ``start``/``end``: byte range of
    each word; ``first``: index of each text's first word (length n + 1).
    """

    __slots__ = ("low", "start", "end", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = _LOWER[raw]
        inside = low != 0
        begins = inside.copy()
        ends = inside.copy()
        if len(low):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(low))]
            begins[cut] = inside[cut]
            ends[cut - 1] = inside[cut - 1]
        self.low = low
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, computed in bounded chunks."""
        n = len(self.start)
        out = np.empty(n, np.uint64)
        size = self.end - self.start
        total = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < n:
            j = int(np.searchsorted(total, total[i] + (1 << 20), side="right")) - 1
            j = min(max(j, i + 1), n)
            lens = size[i:j]
            at = total[i:j] - total[i]
            pos = np.arange(total[j] - total[i]) - np.repeat(at, lens)
            src = pos + np.repeat(self.start[i:j], lens)
            vals = _MIX[self.low[src]] * _POW[pos & 1023]
            # word length enters too, so periodic position weights cannot alias long words
            out[i:j] = np.add.reduceat(vals, at) + lens.astype(np.uint64) * _M2
            i = j
        return mix64(out)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows of each text, with each text's offsets.

    A text of fewer (but not none) words is one window of all its words.
    """
    counts = np.diff(first)
    n = len(hashes)
    if n >= width:
        win = hashes[:n - width + 1] * _SHINGLE[0]
        for k in range(1, width):
            win = win + hashes[k:n - width + 1 + k] * _SHINGLE[k]
    else:
        win = np.zeros(0, np.uint64)
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(offsets[-1], np.uint64)
    full = np.flatnonzero(counts >= width)
    if len(full):
        lens = out_counts[full]
        rel = np.arange(lens.sum()) - np.repeat(np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        out[np.repeat(offsets[full], lens) + rel] = win[np.repeat(first[full], lens) + rel]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = hashes[first[i]:first[i + 1]]
        out[offsets[i]] = np.sum(part * _SHINGLE[:len(part)], dtype=np.uint64) + np.uint64(len(part))
    return mix64(out), offsets


def crc_mod(col, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus`` (the contract's folds)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a seeded hash of ``key`` (same rows on every run).

    A hash threshold cuts each partition to its share before the final ordering, so no task sees
    more than about the bound, whatever the size of the input.
    """
    total = df.count()
    h = F.xxhash64(F.col(key), F.lit(seed))
    if total > bound:
        share = min(1.0, 1.25 * bound / total + 0.0005)
        df = df.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return df.orderBy(h, F.col(key)).limit(bound)


def column_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of the given columns in schema order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema],
        schema=schema)
