"""Nearest-neighbour retrieval: exact top-k and an LSH variant.

Exact top-k (``knn_exact``)
    The query table is small next to the index, so its vectors are shipped to every task once
    (a broadcast variable) - after a size check: the vectors and the k best rows of a block's queries
    must stay under ``TASK_BYTES`` and ``Settings.knn_broadcast_max_bytes``, otherwise the queries are
    split by a hash of their id into blocks that each fit, and every block is one scan of the index.
    What a task holds is therefore the same however many queries there are. Each task scores its
    index rows with a numpy matrix product per tile, per group (project), and keeps a running top-k
    per query; only those partial top-k rows leave the task. A window over
    ``query_id`` (at most partitions x k rows per query) gives the final ranks. No pair table is
    ever materialised and the index is never shuffled.

Approximate (``knn_lsh``)
    Random-hyperplane signatures split into bands; queries and index rows meet on equal
    ``(band, bucket)`` keys. Every (band, bucket, salt) group is scored with the same matrix
    kernel, emitting only its top-k per query, then candidates are merged exactly. Index rows of
    a bucket are spread over ``salts`` sub-groups (queries are replicated to each), so a hot
    bucket cannot land on a single task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.session import materialise, ship_package

# ---------------------------------------------------------------------------------------------
# Matrix kernel shared by both operators.
# ---------------------------------------------------------------------------------------------


def _as_matrix(arr: pa.Array, dim: int) -> np.ndarray:
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(-1, dim)


def _normalise(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(norms > 0, m / np.where(norms > 0, norms, 1.0), 0.0)
    return out


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """(queries x rows) distance matrix; for cosine both sides are normalised already."""
    if metric == "cosine":
        return 1.0 - q @ c.T
    sq = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (q @ c.T)
    return np.sqrt(np.maximum(sq, 0.0))


#: Cells of one distance matrix, and the index rows in it: both sides are tiled to stay within it.
TILE_CELLS = 4 << 20
TILE_ROWS = 8192
#: Bytes that a query block may take in a task (vectors and best rows), and those of one best row.
TASK_BYTES = 64 << 20
BEST_BYTES = 48


def _top_rows(dist: np.ndarray, k: int, order) -> tuple[np.ndarray, np.ndarray]:
    """(query_idx, row_idx) of exactly min(k, rows) rows per query: smallest distance, then ``order``.

    ``order()`` gives each row's place among the rows by id; it is only asked for when ties straddle
    the cut, e.g. for a zero query vector, to which every row is equally near.
    """
    n, m = dist.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
    keep = dist <= kth[:, None]
    many = np.flatnonzero(keep.sum(axis=1) > k)
    if len(many):
        place = order()
        for q in many:
            ties = np.flatnonzero(dist[q] == kth[q])
            spare = keep[q].sum() - k
            keep[q, ties[np.argsort(place[ties])[len(ties) - spare:]]] = False
    return np.nonzero(keep)


def _reduce(cands: pa.Table, id_cols: list[str], k: int) -> pa.Table:
    """The k best rows per query (distance, then ids) of a candidate table."""
    cands = cands.combine_chunks().sort_by([("q", "ascending"), ("d", "ascending")]
                                           + [(c, "ascending") for c in id_cols])
    q = cands.column("q").to_numpy()
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return cands.filter(pa.array(rank < k))


class _Best:
    """The k best rows per query that a task has met; rows beyond a full query's k-th are dropped at once."""

    def __init__(self, n: int, k: int, id_cols: list[str]):
        self.k, self.id_cols = k, id_cols
        self.worst = np.full(n, np.inf)  # distance of the k-th best row, where there are k
        self.held: list[pa.Table] = []
        self.kept = self.gathered = 0

    def add(self, q: np.ndarray, d: np.ndarray, row: np.ndarray, ids) -> None:
        """Pairs of query numbers and rows of ``ids`` with their distances."""
        near = ~(d > self.worst[q])
        if not near.any():
            return
        found = ids.take(pa.array(row[near]))
        self.held.append(pa.table({"q": pa.array(q[near], pa.int64()), "d": pa.array(d[near]),
                                   **{c: found.column(c) for c in self.id_cols}}))
        self.gathered += found.num_rows
        if not self.kept or self.gathered >= max(self.kept // 2, 1 << 16):
            self.fold()

    def fold(self) -> pa.Table | None:
        if self.gathered:
            best = _reduce(pa.concat_tables(self.held), self.id_cols, self.k)
            q, d = best.column("q").to_numpy(), best.column("d").to_numpy()
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
            full = last[np.diff(np.r_[-1, last]) == self.k]
            self.worst[q[full]] = d[full]
            self.held, self.kept, self.gathered = [best], best.num_rows, 0
        return self.held[0] if self.held else None


# ---------------------------------------------------------------------------------------------
# Exact top-k.
# ---------------------------------------------------------------------------------------------


def _collect_query_block(table: pa.Table, group_col, query_id: str, emb: str, k_col: str, metric: str):
    payload: dict = {}
    if table.num_rows == 0:
        return payload
    groups = (table.column(group_col).to_pylist() if group_col else [None] * table.num_rows)
    qids = table.column(query_id).to_numpy(zero_copy_only=False).astype(np.int64)
    ks = table.column(k_col).to_numpy(zero_copy_only=False).astype(np.int64)
    emb_col = table.column(emb).combine_chunks()
    dims = pc.list_value_length(emb_col).to_numpy(zero_copy_only=False)
    if len(set(dims.tolist())) != 1:
        raise ValueError("query vectors must all have the same dimension")
    mat = _as_matrix(emb_col, int(dims[0]))
    if metric == "cosine":
        mat = _normalise(mat)
    by_group: dict = {}
    for i, g in enumerate(groups):
        by_group.setdefault(g, []).append(i)
    for g, rows in by_group.items():
        idx = np.asarray(rows)
        payload[g] = (qids[idx], mat[idx], ks[idx])
    return payload


def _scan_fn(bc, group_col, id_cols, emb, metric, out_schema):
    def run(batches):
        payload = bc.value
        state: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            emb_col = batch.column(emb)
            valid = pc.is_valid(emb_col)
            if not pc.all(valid).as_py():
                batch = batch.filter(valid)
                emb_col = batch.column(emb)
            if batch.num_rows == 0:
                continue
            if group_col is None:
                keys = [None]
            else:
                keys = [g for g in pc.unique(batch.column(group_col)).to_pylist() if g in payload]
            for g in keys:
                if g not in payload:
                    continue
                part = batch if g is None else batch.filter(pc.equal(batch.column(group_col), g))
                if part.num_rows == 0:
                    continue
                _, qmat, ks = payload[g]
                vecs = part.column(emb)
                lengths = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
                if (lengths != qmat.shape[1]).any():
                    raise ValueError("index vector dimension differs from the query dimension")
                rows = _as_matrix(vecs, qmat.shape[1])
                if metric == "cosine":
                    rows = _normalise(rows)
                kmax = int(ks.max())
                best = state.setdefault(g, _Best(len(qmat), kmax, id_cols))
                tile = max(1, TILE_CELLS // TILE_ROWS)
                for lo in range(0, len(rows), TILE_ROWS):
                    ids = part.slice(lo, TILE_ROWS).select(id_cols)

                    def order(ids=ids):
                        place = np.empty(ids.num_rows, np.int64)
                        by_id = pc.sort_indices(ids, sort_keys=[(c, "ascending") for c in id_cols])
                        place[by_id.to_numpy()] = np.arange(ids.num_rows)
                        return place

                    for at in range(0, len(qmat), tile):
                        dist = _distances(qmat[at:at + tile], rows[lo:lo + TILE_ROWS], metric)
                        near = ~(dist > best.worst[at:at + tile, None])
                        few = np.count_nonzero(near) <= 4 * kmax * len(dist)
                        qi, ri = np.nonzero(near) if few else _top_rows(dist, kmax, order)
                        best.add(qi + at, dist[qi, ri], ri, ids)
        for g, best in state.items():
            qids, _, ks = payload[g]
            cands = best.fold()
            if cands is None:
                continue
            q = cands.column("q").to_numpy()
            cols = {"query_id": pa.array(qids[q], pa.int64())}
            for name in id_cols:
                cols[name] = cands.column(name).combine_chunks().cast(out_schema.field(name).type)
            cols["distance"] = cands.column("d").combine_chunks()
            cols["k"] = pa.array(ks[q], pa.int32())
            table = pa.table(cols, schema=out_schema)
            yield from table.to_batches()

    return run


# Largest per-group LSH bucket-size table that is broadcast (rows).
MAX_SIZES_BROADCAST = 1_000_000
# Largest group list pushed to the scan as an IN filter; longer lists become a semi join.
MAX_IN_LIST = 1000
# Dimension assumed when sizing the first collect of the query block before the dimension is known.
ASSUMED_MAX_DIM = 4096


def _query_blocks(qsel: DataFrame, query_id: str, settings: Settings):
    """Generator of Arrow tables of query rows, each within ``knn_broadcast_max_bytes`` and ``TASK_BYTES``.

    A query counts with its vector (``_emb``) and its ``_k`` best rows, which every task holds.

    One block is in the driver at a time: it is broadcast (to files) before the next is collected.

    Common case, one job: up to ``budget / (8 * ASSUMED_MAX_DIM)`` rows are collected directly and
    their real size checked. Larger query tables are counted, then split by a hash of the query id
    into blocks that each fit, and collected block by block.
    """
    budget = min(settings.knn_broadcast_max_bytes, TASK_BYTES)
    cap = max(1, budget // (8 * ASSUMED_MAX_DIM))
    first = qsel.limit(cap + 1).toArrow()
    if first.num_rows <= cap:
        dims = pc.list_value_length(first.column("_emb").combine_chunks())
        dim = int(pc.max(dims).as_py() or 0) if first.num_rows else 0
        k = int(pc.max(first.column("_k")).as_py() or 0) if first.num_rows else 0
        if first.num_rows * (dim * 8 + k * BEST_BYTES) <= budget:
            if first.num_rows:
                yield first
            return
    del first
    stats = qsel.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_emb")).alias("dim"),
                     F.max("_k").alias("k")).first()
    n, dim, k = int(stats["n"]), int(stats["dim"] or 0), int(stats["k"] or 0)
    blocks = max(1, math.ceil(n * (dim * 8 + k * BEST_BYTES) / budget))
    for b in range(blocks):
        block = qsel.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            yield block
        del block


def knn_exact_counted(index: DataFrame, queries: DataFrame, k, *, id_cols,
                      group_col: str | None = None, query_id: str = "query_id",
                      embedding: str = "embedding", metric: str = "cosine",
                      settings: Settings = DEFAULT_SETTINGS) -> tuple[DataFrame, int]:
    """``knn_exact`` plus the number of query rows (known from collecting the query block)."""
    spark = index.sparkSession
    ship_package(spark)
    id_cols = list(id_cols)
    k_expr = F.lit(int(k)) if isinstance(k, int) else F.col(k)
    sel = [F.col(query_id).cast("long").alias(query_id)]
    if group_col:
        sel.append(F.col(group_col))
    qsel = queries.select(*sel, F.col(embedding).alias("_emb"), k_expr.cast("int").alias("_k")) \
        .where(F.col("_emb").isNotNull())

    idx_fields = {f.name: f for f in index.schema.fields}
    arrow_fields = [pa.field("query_id", pa.int64())]
    from pyspark.sql.pandas.types import to_arrow_type
    for name in id_cols:
        arrow_fields.append(pa.field(name, to_arrow_type(idx_fields[name].dataType)))
    arrow_fields += [pa.field("distance", pa.float64()), pa.field("k", pa.int32())]
    out_arrow = pa.schema(arrow_fields)
    out_struct = T.StructType(
        [T.StructField("query_id", T.LongType())]
        + [T.StructField(name, idx_fields[name].dataType) for name in id_cols]
        + [T.StructField("distance", T.DoubleType()), T.StructField("k", T.IntegerType())])

    n = 0
    idx_cols = ([group_col] if group_col else []) + id_cols + [embedding]
    parts = []
    for table in _query_blocks(qsel, query_id, settings):
        n += table.num_rows
        payload = _collect_query_block(table, group_col, query_id, "_emb", "_k", metric)
        scan = index.select(*idx_cols)
        if group_col:
            groups = list(payload.keys())
            if len(groups) <= MAX_IN_LIST:
                scan = scan.where(F.col(group_col).isin(groups))  # partition pruning
            else:
                wanted = spark.createDataFrame([(g,) for g in groups], [group_col])
                scan = scan.join(F.broadcast(wanted), group_col, "left_semi")
        del table
        bc = spark.sparkContext.broadcast(payload)
        del payload
        parts.append((scan, _scan_fn(bc, group_col, id_cols, embedding, metric, out_arrow)))
    if not parts:
        empty = spark.createDataFrame([], out_struct).withColumn("rank", F.lit(0))
        return empty.drop("k").withColumnRenamed("query_id", query_id), n
    cands, n_parts = _scan_blocks(parts, out_struct)
    cands = _tree_reduce(cands, id_cols, n_parts, settings.knn_reduce_fanout)
    w = Window.partitionBy("query_id").orderBy("distance", *id_cols)
    ranked = cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k"))
    return ranked.drop("k").withColumnRenamed("query_id", query_id), n


def _scan_blocks(parts: list, struct: T.StructType) -> tuple[DataFrame, int]:
    """Candidates of all query blocks, given as (rows to scan, scan function), and the number of tasks.

    A task passes on its k best rows per query, so several blocks share the tasks instead of each
    cutting the rows as finely: candidates then grow with the queries, not with queries times tasks.
    """
    cores = parts[0][0].sparkSession.sparkContext.defaultParallelism
    width = max(1, math.ceil(3 * cores / len(parts)))
    found, n_parts = None, 0
    for scan, fn in parts:
        if len(parts) > 1:
            scan = scan.coalesce(width)
        part = scan.mapInArrow(fn, struct)
        n_parts += scan.rdd.getNumPartitions()
        found = part if found is None else found.unionByName(part)
    return found, n_parts


def _tree_reduce(cands: DataFrame, id_cols: list[str], n_parts: int, fanout: int) -> DataFrame:
    """First merge level for very wide scans.

    Every scan task emits up to k rows per query, so the final per-query group would hold
    ``n_parts * k`` rows. Above ``fanout`` tasks, rows are first ranked within
    ``(query, shard)`` where ``shard`` groups about ``sqrt(n_parts)`` scan tasks, keeping k per
    group; the final window then sees ``sqrt(n_parts) * k`` rows per query.
    """
    if n_parts <= fanout:
        return cands
    shards = max(2, int(math.ceil(math.sqrt(n_parts))))
    sharded = cands.withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(shards)))
    w = Window.partitionBy("query_id", "_shard").orderBy("distance", *id_cols)
    return (sharded.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("k"))
            .drop("_r", "_shard"))


def knn_exact(index: DataFrame, queries: DataFrame, k, *, id_cols, group_col: str | None = None,
              query_id: str = "query_id", embedding: str = "embedding", metric: str = "cosine",
              settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Exact top-k neighbours of every query row among index rows of the same group.

    Returns ``(query_id, *id_cols, distance, rank)``; ``rank`` counts from 1 per query ordered by
    distance, then the id columns. ``k`` is an int or the name of a per-query column.
    """
    return knn_exact_counted(index, queries, k, id_cols=id_cols, group_col=group_col,
                             query_id=query_id, embedding=embedding, metric=metric,
                             settings=settings)[0]


# ---------------------------------------------------------------------------------------------
# LSH (approximate).
# ---------------------------------------------------------------------------------------------


def _hyperplanes(dim: int, bands: int, bits: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((bands * bits, dim))


def lsh_signatures(df: DataFrame, embedding: str, *, dim: int, bands: int = 8, bits: int = 8,
                   seed: int = 7) -> DataFrame:
    """Adds ``signature`` (one bucket number per band): random-hyperplane signs.

    Rows without a vector are left out: they belong to no bucket. The result is narrow work and can
    be stored with the index.
    """
    planes = _hyperplanes(dim, bands, bits, seed)
    weights = (1 << np.arange(bits)).astype(np.int64)
    schema = T.StructType(df.schema.fields + [T.StructField("signature", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(embedding)))
            mat = _as_matrix(batch.column(embedding), dim) if batch.num_rows else np.zeros((0, dim))
            signs = (mat @ planes.T) > 0
            codes = (signs.reshape(-1, bands, bits) * weights).sum(axis=2)
            sig = pa.array(codes.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(batch.columns + [sig], names=batch.schema.names + ["signature"])

    return df.mapInArrow(run, schema)


def _by_band(signed: DataFrame) -> DataFrame:
    return signed.select(*[c for c in signed.columns if c != "signature"],
                         F.posexplode("signature").alias("band", "bucket"))


def knn_lsh(index: DataFrame, queries: DataFrame, k: int, *, id_cols, query_id: str = "query_id",
            embedding: str = "embedding", metric: str = "cosine", bands: int = 8, bits: int = 8,
            rows_per_group: int = 20000, queries_per_group: int = 2000,
            seed: int = 7, group_col: str | None = None) -> DataFrame:
    """Approximate top-k via banded random-hyperplane LSH; exact distances on the candidates.

    Bucket sizes of both sides are counted first (a table of at most ``bands * 2**bits`` rows,
    broadcast). A bucket with ``n`` index rows and ``m`` queries is cut into
    ``ceil(n / rows_per_group) x ceil(m / queries_per_group)`` sub-groups: each index row goes to
    one index salt and is copied to every query salt, each query the other way round. No group
    holds more than ``rows_per_group`` index rows or ``queries_per_group`` queries, however hot
    the bucket, and each group emits only its top-k per query. With ``group_col`` (the project)
    queries only meet index rows of their own group: the group is part of the bucket key.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(index.sparkSession)
    id_cols = list(id_cols)
    dim = int(queries.select(F.max(F.size(embedding))).first()[0] or 0)
    group = [group_col] if group_col else []
    # each side is signed once; sizes and buckets read what was written
    q = lsh_signatures(queries.select(F.col(query_id).cast("long").alias("query_id"), *group,
                                      F.col(embedding).alias("embedding")),
                       "embedding", dim=dim, bands=bands, bits=bits, seed=seed)
    q = _by_band(materialise(q, "lsh_queries"))
    ix = lsh_signatures(index.select(*id_cols, *[c for c in group if c not in id_cols],
                                     F.col(embedding).alias("embedding")),
                        "embedding", dim=dim, bands=bands, bits=bits, seed=seed)
    ix = _by_band(materialise(ix, "lsh_index"))
    keys = ["band", "bucket"] + group
    isizes = ix.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_group)).cast("int").alias("n_isalts"))
    qsizes = q.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(queries_per_group)).cast("int").alias("n_qsalts"))
    sizes = isizes.join(qsizes, keys)
    if not group and bands << bits <= MAX_SIZES_BROADCAST:
        sizes = F.broadcast(sizes)  # at most bands * 2**bits rows
    elif sizes.limit(MAX_SIZES_BROADCAST + 1).count() <= MAX_SIZES_BROADCAST:
        sizes = F.broadcast(sizes)  # checked: per-group bucket sizes can grow with the groups
    ix = (ix.join(sizes, keys)
          .withColumn("isalt", F.pmod(F.xxhash64(*id_cols), F.col("n_isalts")).cast("int"))
          .withColumn("qsalt", F.explode(F.sequence(F.lit(0), F.col("n_qsalts") - 1)))
          .drop("n_isalts", "n_qsalts"))
    q = (q.join(sizes, keys)
         .withColumn("qsalt", F.pmod(F.xxhash64("query_id"), F.col("n_qsalts")).cast("int"))
         .withColumn("isalt", F.explode(F.sequence(F.lit(0), F.col("n_isalts") - 1)))
         .drop("n_isalts", "n_qsalts"))
    idx_fields = {f.name: f for f in index.schema.fields}
    out_fields = ([pa.field("query_id", pa.int64())]
                  + [pa.field(n, to_arrow_type(idx_fields[n].dataType)) for n in id_cols]
                  + [pa.field("distance", pa.float64())])
    out_arrow = pa.schema(out_fields)
    out_struct = T.StructType(
        [T.StructField("query_id", T.LongType())]
        + [T.StructField(name, idx_fields[name].dataType) for name in id_cols]
        + [T.StructField("distance", T.DoubleType())])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out_arrow.empty_table()
        qmat = _as_matrix(left.column("embedding").combine_chunks(), dim)
        cmat = _as_matrix(right.column("embedding").combine_chunks(), dim)
        if metric == "cosine":
            qmat, cmat = _normalise(qmat), _normalise(cmat)
        ids = right.select(id_cols)

        def order():
            place = np.empty(ids.num_rows, np.int64)
            place[pc.sort_indices(ids, sort_keys=[(c, "ascending") for c in id_cols]).to_numpy()] = \
                np.arange(ids.num_rows)
            return place

        dist = _distances(qmat, cmat, metric)
        qi, ri = _top_rows(dist, k, order)
        cols = [left.column("query_id").combine_chunks().take(pa.array(qi))]
        cols += [right.column(n).combine_chunks().take(pa.array(ri)) for n in id_cols]
        cols.append(pa.array(dist[qi, ri], pa.float64()))
        return pa.Table.from_arrays(cols, schema=out_arrow)

    group = keys + ["isalt", "qsalt"]
    cands = q.groupBy(*group).cogroup(ix.groupBy(*group)).applyInArrow(apply, out_struct)
    best = cands.groupBy("query_id", *id_cols).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", *id_cols)
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumnRenamed("query_id", query_id))
