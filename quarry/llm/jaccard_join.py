"""N-gram Jaccard self-join by chosen paths (operator 7).

Sets are the hashed five-word shingles of a text. Equal sets collapse into one class first. A class
is described by ``COORDS`` min-hashes, i.e. its sampled tokens. Each run starts at a root of its own
and splits the classes on sampled coordinates (one, with probability 1/similarity - 1 a second one):
the child node of a class is named by the path so far, the coordinate and the class's token there, so
classes meet in a node exactly if they share all tokens chosen along the path. Nodes with one class
vanish, nodes of up to ``LIMIT`` classes are brute-forced on their sketches, larger ones are split
again, and what is still large after ``DEPTH`` splits is compared block by block. Runs are repeated
until the recall target is met (``runs_for``). Pairs whose sketches agree enough are candidates;
they only ever leave a node as a spanning forest. The candidate components then meet once more, each
class with its whole set, and every pair of a component is verified exactly, in blocks.

No group is collected (see ``buckets``), copies are never expanded into pairs, no bucket is capped.

Edge cases: NULL, empty and wordless texts have no shingles: own class, no links. Texts of one to
four words are one shingle. Repeated rows count as copies of each other. A NULL ``doc_id`` is allowed
(its class id is the smallest non-NULL id of the class, else NULL). Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import block_pass, bucket_map, bucket_pass, forest
from .common import Words, binary_views, materialise, mix64, ready, shingle_hashes, slices
from .graph import components

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.999
COORDS = 64
LIMIT = 1024
DEPTH = 3
SET_LIMIT = 512

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**62, COORDS, dtype=np.uint64)
_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("node", T.LongType()), T.StructField("check", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType())),
])
_WHOLE = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.BinaryType())])
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND = T.StructType(_PAIRS.fields + [T.StructField("links", T.LongType())])


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair of that similarity shares a path of ``depth`` splits in one run."""
    second = 1 / similarity - 1
    p = 1.0
    for _ in range(depth):
        q = similarity * p
        p = (1 - second) * q + second * (1 - (1 - q) ** 2)
    return p


def runs_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair exactly at the threshold has met with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth))))


def chosen(node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates a node splits on: one always, a second (or -1) with chance 1/similarity - 1."""
    h = mix64(node ^ np.uint64(0x9E3779B97F4A7C15))
    first = (h % np.uint64(COORDS)).astype(np.int64)
    other = ((h >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)
    other = (first + 1 + other) % COORDS
    draw = (h >> np.uint64(32)).astype(np.float64) / 2.0**32
    return first, np.where(draw < 1 / similarity - 1, other, -1)


def child(node: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(mix64(node + coord.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                 ^ token.astype(np.uint64))


def text_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(raw, offsets)
    shingles, at = shingle_hashes(words.hashes(), words.first, width)
    return [np.unique(shingles[at[d]:at[d + 1]]) for d in range(len(offsets) - 1)]


def _sets(docs: DataFrame, width: int, similarity: float, runs: int) -> DataFrame:
    """One row per document row: size, 128-bit identity, sketch and first-level paths of its set."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                        ("check", pa.int64()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])
    roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    first, second = chosen(roots, similarity)
    starts = [(roots[r], c) for r in range(runs) for c in (first[r], second[r]) if c >= 0]

    def run(batches):
        for batch in batches:
            raw, offsets = binary_views(batch.column(1))
            for i, j in slices(offsets):
                sets = text_sets(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                sizes = np.array([len(s) for s in sets])
                has = np.flatnonzero(sizes)
                node = np.zeros(j - i, np.int64)
                check = np.zeros(j - i, np.int64)
                sketch: list[bytes | None] = [None] * (j - i)
                paths: list[list[int] | None] = [None] * (j - i)
                if len(has):
                    every = np.concatenate([sets[d] for d in has])
                    at = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
                    node[has] = np.add.reduceat(mix64(every), at).view(np.int64)
                    check[has] = np.bitwise_xor.reduceat(mix64(every + _B[0]), at).view(np.int64)
                    tokens = np.empty((len(has), COORDS), np.uint32)
                    for c in range(COORDS):
                        tokens[:, c] = np.minimum.reduceat(every * _A[c] + _B[c], at) >> np.uint64(32)
                    # the sketch keeps the low byte of a mixed token: equal tokens, equal bytes
                    small = (mix64(tokens.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                    keys = np.stack([child(np.full(len(has), root, np.uint64), np.full(len(has), c),
                                           tokens[:, c]) for root, c in starts], 1).view(np.int64)
                    for k, d in enumerate(has):
                        sketch[d] = small[k].tobytes()
                        paths[d] = keys[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(node),
                     pa.array(check), pa.array(sketch, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.xxhash64("text").alias("mark")).mapInArrow(run, _SETS)


def _binary_matrix(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _sketch_judge(least: int):
    """Forest of the pairs of a node whose sketches agree in ``least`` coordinates."""
    def judge(left, right):
        ids = left.column("class").to_numpy()
        a = _binary_matrix(left.column("sketch"), COORDS)
        if right is None:
            other, b = ids, a
        else:
            other, b = right.column("class").to_numpy(), _binary_matrix(right.column("sketch"), COORDS)
        pairs = []
        step = max(1, (4 << 20) // (len(b) * COORDS))
        for lo in range(0, len(a), step):
            agree = (a[lo:lo + step, None, :] == b[None, :, :]).sum(2, dtype=np.int16)
            x, y = np.nonzero(agree >= least)
            x += lo
            if right is None:
                x, y = x[x < y], y[x < y]
            pairs.append(np.stack([x, y], 1))
        pairs = np.concatenate(pairs)
        if not len(pairs):
            return
        shift = 0 if right is None else len(ids)
        kept = forest(len(ids) + shift, zip(pairs[:, 0].tolist(), (pairs[:, 1] + shift).tolist()))
        yield {"a": ids[[p for p, _ in kept]], "b": other[[q - shift for _, q in kept]]}
    return judge


def _children(waiting: DataFrame, similarity: float) -> DataFrame:
    """The rows of large nodes, one level further down."""
    schema = pa.schema([("path", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("path").to_numpy().view(np.uint64)
            sketch = _binary_matrix(batch.column("sketch"), COORDS)
            rows = np.arange(len(node))
            for coord in chosen(node, similarity):
                ok = np.flatnonzero(coord >= 0)
                key = child(node[ok], coord[ok], sketch[rows[ok], coord[ok]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("class").take(pa.array(ok)),
                     batch.column("sketch").take(pa.array(ok))], schema=schema)

    return waiting.select("path", "class", "sketch").mapInArrow(run, "path long, class long, sketch binary")


def candidate_edges(classes: DataFrame, similarity: float, limit: int, depth: int) -> DataFrame:
    """Edges whose components hold every pair that met in a node with agreeing sketches."""
    sigma = math.sqrt(similarity * (1 - similarity) * COORDS)
    judge = _sketch_judge(max(1, math.floor(similarity * COORDS - 4.75 * sigma)))
    rows = classes.select(F.explode("paths").alias("path"), F.col("node").alias("class"), "sketch")
    edges = None
    for level in range(depth):
        found, waiting = bucket_pass(rows, "path", judge, _PAIRS, limit, "class")
        edges = found if edges is None else edges.unionByName(found)
        if waiting.isEmpty():
            return edges
        if level < depth - 1:
            rows = _children(waiting, similarity)
    return edges.unionByName(block_pass(waiting, "path", judge, _PAIRS, "class"))


def _set_judge(similarity: float):
    """Exact Jaccard of all pairs: links of each class, and a forest of the linked pairs."""
    ratio = Fraction(similarity).limit_denominator(1000)

    def judge(left, right):
        parts = [left] if right is None else [left, right]
        ids = np.concatenate([p.column("class").to_numpy() for p in parts])
        copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
        sets = [np.frombuffer(s, np.uint64) for p in parts for s in p.column("set").to_pylist()]
        n, cut = len(sets), left.num_rows
        sizes = np.array([len(s) for s in sets], np.int64)
        if n == 2:
            common = np.zeros((2, 2), np.int64)
            common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        else:
            token, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(n), sizes)
            keep = times[where] > 1  # tokens of one set alone cannot be common
            rank = np.cumsum(times > 1) - 1
            col, doc = rank[where[keep]], doc[keep]
            order = np.argsort(col, kind="stable")
            col, doc = col[order], doc[order]
            common = np.zeros((n, n), np.float64)
            width = 4096
            for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
                i, j = np.searchsorted(col, [lo, lo + width])
                cells = np.zeros((n, width), np.float32)
                cells[doc[i:j], col[i:j] - lo] = 1
                common += cells @ cells.T
            common = np.rint(common).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        linked = common * ratio.denominator >= union * ratio.numerator
        np.fill_diagonal(linked, False)
        if right is not None:
            linked[:cut, :cut] = False
            linked[cut:, cut:] = False
        links = linked @ copies
        some = np.flatnonzero(links)
        yield {"a": ids[some], "links": links[some]}
        x, y = np.nonzero(np.triu(linked))
        kept = forest(n, zip(x.tolist(), y.tolist()))
        yield {"a": ids[[p for p, _ in kept]], "b": ids[[q for _, q in kept]]}
    return judge


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for batch in batches:
            raw, offsets = binary_views(batch.column(0))
            for i, j in slices(offsets):
                sets = text_sets(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                node = [int(np.sum(mix64(s), dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    schema=schema)

    return docs.select("text").mapInArrow(run, _WHOLE)


def jaccard_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY,
                    recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH,
                    set_limit: int = SET_LIMIT) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, class_id, n_links``.

    ``class_id`` is the smallest ``doc_id`` of the connected group of links (Jaccard >= similarity),
    ``n_links`` the number of other document rows linked to this one, copies included.
    """
    return _verdicts(docs, width, similarity, recall, limit, depth, set_limit).select(
        "doc_id", "n_shingles", "class_id", "n_links")


def _verdicts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL,
              limit: int = LIMIT, depth: int = DEPTH, set_limit: int = SET_LIMIT) -> DataFrame:
    """``jaccard_classes`` with the row's key (``doc_id`` and ``mark``, a digest of its text) and ``kept``.

    ``kept`` is the least (no id, ``doc_id``, ``mark``) of the class, NULL without shingles.
    """
    ready(docs.sparkSession)
    sets = materialise(_sets(docs, width, similarity, runs_for(similarity, recall, depth)), "sets")
    identity = ["node", "check", "n"]
    classes = materialise(sets.where("n > 0").groupBy(*identity).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(_rank()).alias("least"),
        F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "classes")
    candidates = components(candidate_edges(classes, similarity, limit, depth))
    met = materialise(candidates.join(classes.select("node", "rep", "copies"), "node")
                      .withColumnRenamed("component", "group"), "candidates")
    wanted = met.select(F.coalesce("rep", F.lit(-2**63)).alias("_rep")).distinct()
    again = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-2**63)).alias("_rep"), docs["text"])
    whole = (_whole_sets(again.join(wanted, "_rep", "left_semi"), width).dropDuplicates(["node"])
             .join(met.select("node", "group", "copies"), "node")
             .select("group", F.col("node").alias("class"), "copies", "set"))
    found = bucket_map(whole, "group", _set_judge(similarity), _FOUND, set_limit, "class")
    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    named = (joined.join(classes.select("node", "rep", "least"), "node")
             .groupBy("component").agg(F.min("rep").alias("class_id"), F.min("least").alias("kept")))
    info = (classes.select(*identity, "rep", "copies", "least").join(joined, "node", "left")
            .join(named, "component", "left").join(links, "node", "left")
            .select(*identity, F.coalesce("class_id", "rep").alias("class_id"),
                    F.coalesce("kept", "least").alias("kept"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    rows = sets.select("doc_id", "mark", *identity)
    return rows.join(info, identity, "left").select(
        "doc_id", "mark", "kept", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _rank() -> Column:
    """Order of the rows of a class: by ``doc_id`` (NULL last), then by the digest of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class stays: the row of the smallest ``doc_id`` (all its columns).

    Documents without shingles always stay. Rows are told apart by ``doc_id`` and text, so rows that
    share an id (or have none) stay or go each with its own class. Where several rows of a class have
    the smallest id, one stays (equal rows are interchangeable; else the smallest text digest); a class
    without any id keeps one row too.
    """
    verdict = materialise(_verdicts(docs, **options).where("n_shingles > 0")
                          .select("doc_id", "mark", (_rank() == F.col("kept")).alias("stays")), "verdict")
    row = [F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")]

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].cast("long").eqNullSafe(right["_id"]) & (F.xxhash64(left["text"]) == right["_mark"])

    gone = verdict.where("not stays").select(*row).distinct()
    # the ids have no size bound: a shuffle join at every size
    kept = docs.join(gone.hint("merge"), same(docs, gone), "left_anti")
    twice = verdict.where("stays").groupBy(*row).agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, same(kept, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same(kept, twice), "left_anti").unionByName(single)
