"""Pairs inside buckets of any size, without ever holding an unbounded bucket in one task.

``bucket_map`` streams key-sorted rows: a bucket of up to ``limit`` rows is judged at once; a larger
one is passed on in numbered blocks of ``limit`` rows as it streams by (it is never collected), and a
second shuffle brings every pair of its blocks together in a task of its own. Every pair of rows of a
bucket is therefore seen exactly once, and no task holds more than ``2 * limit`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise

Judge = Callable[[pa.RecordBatch, "pa.RecordBatch | None"], Iterator[dict]]


def _runs(batches, keys: list[str], limit: int | None, many: bool = False):
    """(rows, block) for runs of equal keys in sorted batches; block is None for a whole run.

    With ``many`` all whole runs of a batch come together as one batch of rows.

    Runs of one row are dropped. A run above ``limit`` comes in pieces of exactly ``limit`` rows
    (the last may be smaller) numbered from 0.
    """
    carry: pa.RecordBatch | None = None
    block = 0  # pieces of the carried run already handed out
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.concat_batches([carry, batch])
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        sizes = np.diff(edges)
        last = len(sizes) - 1
        todo = (sizes > 1) | (np.arange(len(sizes)) == 0)
        todo[last] = False
        if many:
            whole = (sizes > 1) & (sizes <= limit)
            whole[last] = False
            whole[0] &= block == 0
            if whole.any():
                yield batch.filter(pa.array(np.repeat(whole, sizes))), None
            todo &= ~whole
        for r in np.flatnonzero(todo):
            lo, hi = int(edges[r]), int(edges[r + 1])
            lead, block = (block, 0) if r == 0 else (0, 0)
            if lead or (limit and hi - lo > limit):
                for at in range(lo, hi, limit):
                    yield batch.slice(at, min(limit, hi - at)), lead
                    lead += 1
            elif hi - lo > 1:
                yield batch.slice(lo, hi - lo), None
        if last > 0:
            block = 0
        tail = batch.slice(int(edges[last]))
        while limit and tail.num_rows > limit:
            yield tail.slice(0, limit), block
            block += 1
            tail = tail.slice(limit)
        carry = tail
    if carry is not None:
        if block:
            yield carry, block
        elif carry.num_rows > 1:
            yield carry, None


def _batch(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        c = columns.get(f.name)
        if c is None:
            arrays.append(pa.nulls(n, f.type))
        elif isinstance(c, pa.Array):
            arrays.append(c.cast(f.type) if c.type != f.type else c)
        else:
            arrays.append(pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)


def bucket_pass(rows: DataFrame, key: str, judge: Judge, out: T.StructType, limit: int,
                order: str | None = None, many: bool = False,
                tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Judge whole buckets of up to ``limit`` rows; returns (results, rows of larger buckets).

    The rows of larger buckets come with ``_block``, the number of their block inside the bucket.
    With ``many`` the judge gets the rows of many small buckets at once and looks at the key itself.
    Buckets are dealt to ``tasks`` tasks, else to as many as their bytes ask for: too few where judging is slow.
    """
    rows = rows.where(F.col(key).isNotNull())
    payload = rows.schema.fields
    both = T.StructType([T.StructField(f.name, f.dataType) for f in out.fields]
                        + [T.StructField("_block", T.IntegerType())]
                        + [T.StructField(f"_p_{f.name}", f.dataType) for f in payload])

    def run(batches):
        schema = to_arrow_schema(both)
        for part, block in _runs(batches, [key], limit, many):
            if block is None:
                for cols in judge(part, None):
                    n = len(next(iter(cols.values())))
                    if n:
                        yield _batch(schema, n, cols)
            else:
                cols = {f"_p_{name}": part.column(name) for name in part.schema.names}
                yield _batch(schema, part.num_rows, cols | {"_block": [block] * part.num_rows})

    ordered = _dealt(rows, tasks, key).sortWithinPartitions(*[key] + ([order] if order else []))
    done = materialise(ordered.mapInArrow(run, both), "buckets")
    return (done.where("_block is null").select(*[f.name for f in out.fields]),
            done.where("_block is not null").select(
                "_block", *[F.col(f"_p_{f.name}").alias(f.name) for f in payload]))


def block_pass(waiting: DataFrame, key: str, judge: Judge, out: T.StructType,
               order: str | None = None, tasks: int | None = None) -> DataFrame:
    """Judge every pair of blocks of the large buckets, each pair in a group of its own."""
    payload = [c for c in waiting.columns if c != "_block"]
    blocks = waiting.groupBy(key).agg((F.max("_block") + 1).alias("_n"))
    dealt = (waiting.join(blocks, key)
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .withColumn("_i", F.least("_block", "_other"))
             .withColumn("_j", F.greatest("_block", "_other"))
             .select("_block", "_i", "_j", *payload))
    where = [key, "_i", "_j"]

    def run(batches):
        schema = to_arrow_schema(T.StructType(out.fields))
        for part, _ in _runs(batches, where, None):
            which = part.column("_block").to_numpy(zero_copy_only=False)
            i, j = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
            left = part.filter(pa.array(which == i))
            right = None if i == j else part.filter(pa.array(which == j))
            for cols in judge(left, right):
                n = len(next(iter(cols.values())))
                if n:
                    yield _batch(schema, n, cols)

    paired = _dealt(dealt, tasks, *where).sortWithinPartitions(*where, "_block", *([order] if order else []))
    return materialise(paired.mapInArrow(run, out), "blocks")


def bucket_map(rows: DataFrame, key: str, judge: Judge, out: T.StructType, limit: int = 1024,
               order: str | None = None, many: bool = False, tasks: int | None = None) -> DataFrame:
    """Judge all pairs of rows with equal ``key``, whatever the size of the buckets.

    ``judge(left, None)`` handles the pairs inside one batch of rows, ``judge(left, right)`` those
    between two batches; it yields dicts of equally long columns of ``out``. Rows with a NULL key
    take no part.
    """
    result, waiting = bucket_pass(rows, key, judge, out, limit, order, many, tasks)
    if waiting.isEmpty():
        return result
    return result.unionByName(block_pass(waiting, key, judge, out, order, tasks))


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two so far separate nodes (a spanning forest of the pairs)."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept
