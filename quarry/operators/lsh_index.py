"""Stored approximate index: random-hyperplane signatures kept beside the index table.

``write_signatures`` reads every vector once, at index time, and keeps one narrow row per (vector, band):
band, bucket, project and the row's key - no vector. Files are sorted by (band, bucket) inside each
project, and a refreshed project replaces its own rows only.

``knn_stored`` answers a table of queries. A query probes its own bucket in every band and, with ``flips``,
the neighbouring buckets behind its least certain bits (those whose hyperplane it lies closest to), which
buys recall without more bands. The distinct probed buckets meet the signature table on (project, band,
bucket); the keys in them are gathered with the list of those buckets, at most one per band, and only then
are vectors read: once each, whatever the number of bands and queries that asked for them.

No pair of a query and a row is ever written: a task holds the queries of one block with their probes
(``knn._query_blocks``) and finds the pairs of a batch itself, bucket by bucket where few meet, by a matrix
product and a test of bucket bits where many do. Distances are exact. Nothing is copied per band but keys,
so what is shuffled and written grows with the vectors, however many queries meet in a bucket. Each task
passes on its k best rows per query.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.operators.knn import (TILE_CELLS, TILE_ROWS, _as_matrix, _Best, _hyperplanes, _normalise,
                                  _query_blocks, _scan_blocks, _tree_reduce)
from quarry.session import materialise, ship_package

#: Cells (pairs x dimensions) that are scored at once, and pairs that are found at once.
PAIR_CELLS = 4 << 20
PAIRS = 1 << 20
#: Share of the pairs of a batch beyond which a matrix product scores them.
DENSE = 1 / 8
#: Bytes of one probed bucket or wanted key when it is broadcast, generous.
ROW_BYTES = 128


class LshParams(NamedTuple):
    """What a signature depends on; queries must use the parameters of the stored table."""

    dim: int
    bands: int
    bits: int
    seed: int = 7


class Signatures(NamedTuple):
    """A signature table (band, bucket, group, key columns) and its parameters."""

    rows: DataFrame
    params: LshParams


def _matrix(vectors: pa.Array, dim: int, ids) -> np.ndarray:
    """Rows as a matrix; a vector of another dimension is an error that names its row."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(sizes != dim)
    if len(wrong):
        raise ValueError(f"vector of {int(sizes[wrong[0]])} dimensions instead of {dim} in row {ids(int(wrong[0]))}")
    return _as_matrix(vectors, dim)


def _buckets(dots: np.ndarray, params: LshParams) -> np.ndarray:
    weights = (1 << np.arange(params.bits)).astype(np.int64)
    return ((dots > 0).reshape(-1, params.bands, params.bits) * weights).sum(axis=2)


def vector_dimension(index: DataFrame, embedding: str = "embedding") -> int:
    """Dimension of the first vector (0 in a table without any)."""
    row = index.where(F.col(embedding).isNotNull()).select(F.size(embedding).alias("n")).first()
    return int(row.n) if row else 0


def signature_rows(index: DataFrame, params: LshParams, *, id_cols, group_col: str | None = None,
                   embedding: str = "embedding") -> DataFrame:
    """(band, bucket, group, key columns) of every row with a vector: narrow work, one pass."""
    ship_package(index.sparkSession)
    cols = ([group_col] if group_col and group_col not in id_cols else []) + list(id_cols)
    planes = _hyperplanes(params.dim, params.bands, params.bits, params.seed)
    fields = {f.name: f for f in index.schema.fields}
    schema = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("bucket", T.LongType())]
                          + [T.StructField(c, fields[c].dataType) for c in cols])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            if not batch.num_rows:
                continue
            named = lambda r: {c: batch.column(c)[r].as_py() for c in cols}
            codes = _buckets(_matrix(batch.column(0), params.dim, named) @ planes.T, params)
            rows = [batch.column(c) for c in cols]
            for b in range(params.bands):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, b), pa.int32()), pa.array(codes[:, b]), *rows],
                    names=["band", "bucket", *cols])

    return index.select(F.col(embedding).alias("_vector"), *cols).mapInArrow(run, schema)


def write_signatures(index: DataFrame, path: str, params: LshParams, *, id_cols, group_col: str,
                     embedding: str = "embedding") -> Signatures:
    """Sign ``index`` and store the signatures under ``path``; projects not in ``index`` keep theirs.

    Writing with other parameters than those of an existing table is an error.
    """
    spark = index.sparkSession
    rows = signature_rows(index, params, id_cols=id_cols, group_col=group_col, embedding=embedding)
    known = _stored_params(spark, path)
    if known is None:
        spark.createDataFrame([params], "dim int, bands int, bits int, seed int").coalesce(1) \
            .write.parquet(f"{path}/params")
    elif known != params:
        raise ValueError(f"signatures under {path} have {known}, not {params}")
    # the writer keeps the order inside each project's files
    (rows.hint("rebalance", group_col).sortWithinPartitions(group_col, "band", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(group_col).parquet(f"{path}/rows"))
    return read_signatures(spark, path, rows.schema)


def _stored_params(spark: SparkSession, path: str) -> LshParams | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/params")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return LshParams(*spark.read.parquet(f"{path}/params").select("dim", "bands", "bits", "seed").first())


def read_signatures(spark: SparkSession, path: str, schema=None) -> Signatures:
    """The signature table that ``write_signatures`` stored; group names are always strings."""
    params = _stored_params(spark, path)
    if params is None:
        raise ValueError(f"no signatures under {path}")
    if schema is None:
        found = spark.read.parquet(f"{path}/rows").schema
        group = found.fields[-1].name  # the partition column comes last
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == group else f.dataType) for f in found])
    return Signatures(spark.read.schema(schema).parquet(f"{path}/rows"), params)


def _probes(vectors: np.ndarray, params: LshParams, flips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, band, bucket): every own bucket, then those behind the ``flips`` least certain bits."""
    dots = vectors @ _hyperplanes(params.dim, params.bands, params.bits, params.seed).T
    own = _buckets(dots, params)
    shaky = np.argsort(np.abs(dots).reshape(-1, params.bands, params.bits), axis=2, kind="stable")[:, :, :flips]
    every = np.concatenate([own[:, :, None], own[:, :, None] ^ (np.int64(1) << shaky.astype(np.int64))], axis=2)
    q, b, _ = np.indices(every.shape)
    return q.ravel(), b.ravel(), every.ravel()


def _ask(vectors: np.ndarray, ids: np.ndarray, ks: np.ndarray, params: LshParams, flips: int, metric: str):
    """What a task gets of the queries of one group: vectors, ids, ks, and the queries of every probed bucket."""
    q, band, bucket = _probes(vectors, params, flips)
    codes = bucket * params.bands + band
    order = np.argsort(codes, kind="stable")
    codes, starts = np.unique(codes[order], return_index=True)
    rows = _normalise(vectors) if metric == "cosine" else vectors
    return rows, ids, ks, codes, np.r_[starts, len(order)], q[order].astype(np.int32)


def _bits(n: int, row: np.ndarray, code: np.ndarray, codes: int) -> np.ndarray:
    """(n x words) sets of bucket numbers as bits."""
    out = np.zeros((n, (codes + 63) // 64), np.uint64)
    np.bitwise_or.at(out, (row, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of each row of ``a`` share a bucket with those of each row of ``b``."""
    both = a[:, None, 0] & b[None, :, 0]
    for w in range(1, a.shape[1]):
        both |= a[:, None, w] & b[None, :, w]
    return both != 0


def _exact(a: np.ndarray, c: np.ndarray, q: np.ndarray, row: np.ndarray, metric: str) -> np.ndarray:
    d = np.empty(len(q))
    step = max(1, PAIR_CELLS // max(1, a.shape[1]))
    for lo in range(0, len(q), step):
        x, y = a[q[lo:lo + step]], c[row[lo:lo + step]]
        d[lo:lo + step] = (1.0 - np.einsum("ij,ij->i", x, y) if metric == "cosine"
                           else np.sqrt(np.maximum(((x - y) ** 2).sum(1), 0.0)))
    return d


def _listed(row: np.ndarray, code: np.ndarray, starts: np.ndarray, queries: np.ndarray, n: int):
    """(query, row) pairs of the buckets of rows, each once, ``PAIRS`` or one row's at a time."""
    counts = starts[code + 1] - starts[code]
    ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) + 1  # entries are ordered by row
    upto = np.cumsum(counts)
    lo = 0
    while lo < len(row):
        before = upto[lo - 1] if lo else 0
        at = max(np.searchsorted(upto[ends - 1], before + PAIRS, "right") - 1, np.searchsorted(ends, lo, "right"))
        hi = ends[at]
        c = counts[lo:hi]
        first = np.repeat(starts[code[lo:hi]] - (np.cumsum(c) - c), c)
        keys = np.unique(np.repeat(row[lo:hi], c) * n + queries[first + np.arange(len(first))])
        yield keys % n, keys // n
        lo = hi


def _dense(best: _Best, a, a_bits, c, c_bits, k: int, metric: str):
    """(query, row) pairs that meet and may be among the k best, by rough distances of all pairs."""
    tile = max(1, TILE_CELLS // TILE_ROWS)
    for at in range(0, len(a), tile):
        x, worst = a[at:at + tile], best.worst[at:at + tile, None]
        rough = x @ c.T
        if metric == "cosine":
            rough, far = 1.0 - rough, worst + 1e-9
        else:
            ours, theirs = (x * x).sum(axis=1), (c * c).sum(axis=1)
            rough = ours[:, None] + theirs[None, :] - 2.0 * rough
            slack = 1e-9 * (1.0 + ours[:, None] + np.nanmax(theirs))
            far = worst * worst + slack
        near = ~(rough > far)
        if np.count_nonzero(near) <= near.size // 16:
            q, row = np.nonzero(near)
            met = ((a_bits[at + q] & c_bits[row]) != 0).any(axis=1)
            q, row = q[met], row[met]
        else:
            near &= _meet(a_bits[at:at + tile], c_bits)
            if near.shape[1] > k:
                kth = np.partition(np.where(near, rough, np.inf), k - 1, axis=1)[:, k - 1:k]
                near &= ~(rough > kth + (1e-9 if metric == "cosine" else slack))
            q, row = np.nonzero(near)
        yield q + at, row


def _score_fn(sent, group_col, id_cols, metric: str, dim: int, out: pa.Schema):
    def run(batches):
        asked = sent.value
        found, bits = {}, {}
        for batch in batches:
            groups = pc.unique(batch.column(group_col)).to_pylist() if group_col else [None]
            for g in (g for g in groups if g in asked):
                mine = batch if group_col is None else batch.filter(pc.equal(batch.column(group_col), g))
                vectors, _, ks, codes, starts, queries = asked[g]
                n, k = len(vectors), int(ks.max())
                best = found.setdefault(g, _Best(n, k, id_cols))
                for lo in range(0, mine.num_rows, TILE_ROWS):
                    part = mine.slice(lo, TILE_ROWS)
                    named = lambda r: {c: part.column(c)[r].as_py() for c in id_cols}  # noqa: B023, E731
                    rows = _matrix(part.column("_vector"), dim, named)
                    rows = _normalise(rows) if metric == "cosine" else rows
                    lists = part.column("_codes")
                    code = lists.flatten().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    row, at = row[codes[at] == code], at[codes[at] == code]
                    if (starts[at + 1] - starts[at]).sum() >= DENSE * n * part.num_rows:
                        if g not in bits:
                            bits[g] = _bits(n, queries, np.repeat(np.arange(len(codes)), np.diff(starts)), len(codes))
                        pairs = _dense(best, vectors, bits[g], rows, _bits(len(rows), row, at, len(codes)), k, metric)
                    else:
                        pairs = _listed(row, at, starts, queries, n)
                    ids = part.select(id_cols)
                    for q, r in pairs:
                        best.add(q, _exact(vectors, rows, q, r, metric), r, ids)
        for g, best in found.items():
            _, qids, ks, *_ = asked[g]
            table = best.fold()
            if table is not None:
                q = table.column("q").to_numpy()
                cols = {"query_id": pa.array(qids[q]), **{c: table.column(c).combine_chunks() for c in id_cols},
                        "distance": table.column("d").combine_chunks(), "k": pa.array(ks[q], pa.int32())}
                yield from pa.table(cols, schema=out).to_batches()

    return run


def knn_stored(index: DataFrame, signatures: Signatures, queries: DataFrame, k, *, id_cols,
               group_col: str | None = None, query_id: str = "query_id", embedding: str = "embedding",
               metric: str = "cosine", flips: int = 0, settings: Settings = DEFAULT_SETTINGS) -> tuple[DataFrame, int]:
    """Approximate top-k by the stored signatures: ``(query_id, *id_cols, distance, rank)`` and the number
    of queries.

    With ``group_col`` queries only meet index rows of their own group. ``k`` is an int or the name of a
    per-query column; rows and queries without a vector take no part.
    """
    spark = index.sparkSession
    ship_package(spark)
    id_cols, params = list(id_cols), signatures.params
    group = [group_col] if group_col else []
    keys = [c for c in group if c not in id_cols] + id_cols
    k_col = F.lit(int(k)) if isinstance(k, int) else F.col(k)
    asked = queries.select(F.col(query_id).cast("long").alias(query_id), *group,
                           F.col(embedding).alias("_emb"), k_col.cast("int").alias("_k")).where("_emb is not null")
    fields = {f.name: f for f in index.schema.fields}
    out = pa.schema([pa.field("query_id", pa.int64())] + [pa.field(c, to_arrow_type(fields[c].dataType)) for c in id_cols]
                    + [pa.field("distance", pa.float64()), pa.field("k", pa.int32())])
    struct = T.StructType([T.StructField("query_id", T.LongType())] + [T.StructField(c, fields[c].dataType) for c in id_cols]
                          + [T.StructField("distance", T.DoubleType()), T.StructField("k", T.IntegerType())])
    rows = index.select(*keys, F.col(embedding).alias("_vector")).where("_vector is not null")
    n, blocks, probed = 0, [], None
    for table in _query_blocks(asked, query_id, settings):
        n += table.num_rows
        ids = table.column(query_id).to_numpy().astype(np.int64)
        vectors = _matrix(table.column("_emb").combine_chunks(), params.dim, lambda r: f"query {ids[r]}")
        ks = table.column("_k").to_numpy().astype(np.int64)
        own: dict = {}
        for i, g in enumerate(table.column(group_col).to_pylist() if group_col else [None] * table.num_rows):
            own.setdefault(g, []).append(i)
        own = {g: _ask(vectors[i], ids[i], ks[i], params, flips, metric) for g, i in own.items()}
        blocks.append(spark.sparkContext.broadcast(own))  # to a file: the driver holds one block at a time
        probes = {"_code": pa.array(np.concatenate([a[3] for a in own.values()]))}
        if group_col:
            names = pa.array(list(own), table.schema.field(group_col).type)
            probes[group_col] = names.take(pa.array(np.repeat(np.arange(len(own)), [len(a[3]) for a in own.values()])))
        probes = pa.table(probes)
        probes = probes if probed is None else pa.concat_tables([probed, probes])
        probed = probes.group_by(probes.column_names).aggregate([])
        del table, own, vectors
    if not blocks:
        return (spark.createDataFrame([], struct).withColumn("rank", F.lit(0)).drop("k")
                .withColumnRenamed("query_id", query_id)), n
    buckets = spark.createDataFrame(probed)
    if probed.num_rows * ROW_BYTES <= settings.knn_broadcast_max_bytes:
        buckets = F.broadcast(buckets)
    code = (F.col("bucket") * params.bands + F.col("band")).alias("_code")
    met = signatures.rows.select(code, *dict.fromkeys(group + keys)).join(buckets, ["_code", *group], "left_semi")
    # one row per wanted key with its probed buckets: at most one per band
    wanted = materialise(met.groupBy(*keys).agg(F.collect_set("_code").alias("_codes")), "wanted")
    size = wanted.select(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_codes")), F.lit(0)).alias("codes")).first()
    small = size.rows * ROW_BYTES + size.codes * 8 <= settings.knn_broadcast_max_bytes
    near = rows.join(F.broadcast(wanted) if small else wanted, keys) \
        .select(*dict.fromkeys(group + id_cols), "_vector", "_codes")
    if not small and len(blocks) > 1:
        near = materialise(near, "near")  # joined once for all blocks
    found, n_parts = _scan_blocks([(near, _score_fn(sent, group_col, id_cols, metric, params.dim, out)) for sent in blocks],
                                  struct)
    found = _tree_reduce(found, id_cols, n_parts, settings.knn_reduce_fanout)
    order = Window.partitionBy("query_id").orderBy("distance", *id_cols)
    ranked = found.withColumn("rank", F.row_number().over(order)).where("rank <= k").drop("k")
    return ranked.withColumnRenamed("query_id", query_id), n
