"""Ranked lexical search over bit-sliced Bloom signatures (operator 11).

``build_index`` gives every document a row in a bitmap block. A block holds documents of one size class
(distinct terms to the next power of two), so all its Bloom signatures have about the same load. The
signatures are stored by slice: slice b has one bit per document, set if the document has a key at bit b.
Keys are (term, tier): a term that occurs tf times is entered for the tiers 0 to floor(log2 tf). The AND
of a key's slices is a document-row bitmap that never misses a document and may name some too many. The
index keeps the dictionary (documents per term) beside the blocks.

``search`` reads blocks only. For an item, a document's upper bound is the sum over the item's terms of
weight times the largest score of the highest tier it seems to hold: slice bitmaps of all tiers, each
weighted with the step between tier scores. The documents of the highest bounds are scored exactly from
their texts; the tenth best of them is a score that any result must reach. Every document whose bound
reaches it is then scored exactly, so nothing is excluded without proof, and only texts of documents
with a bound in reach are tokenised again. Documents are found again by a 64-bit hash of their text; a
collision would only score one more document.

Scale: one pass over the texts for the blocks (no shuffle) and one for the dictionary (aggregated per
task before its shuffle); each search scans the blocks twice and joins the few surviving text hashes to
the documents, by broadcast only while their count allows (``BROADCAST_KEYS``), else by a shuffle join.
Items are handled in blocks of at most ``ITEM_TERMS`` terms, which bounds what a task receives. Each
task passes on its own best rows only, and these are ranked per (item, shard) before per item.

Edge cases: NULL text and texts without a term are no documents of the collection (not in N); a NULL
``doc_id`` takes part and ranks after all others at equal score; rows that share a ``doc_id`` or a text are
documents of their own; items without a known term, or NULL, have no results; items that share an
``item_id`` are ranked each for itself under that id; empty tables give empty results; other columns take
no part.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, binary_views, materialise, mix64, ready, slices

TOP = 10
#: Documents per item that are scored first, to learn what score a result must reach.
SEEDS = 32
#: Bits of a signature per key at least (up to twice as many), and bits set for each key.
BITS = 8
HASHES = 4
#: Documents of a block, and the bits of its bitmap above which it holds fewer.
BLOCK_ROWS = 512
BLOCK_BITS = 1 << 23
#: Terms of all items that are sent to the tasks at once.
ITEM_TERMS = 200_000
#: Text hashes that are broadcast (16 MB); more go through a shuffle join.
BROADCAST_KEYS = 2_000_000
SHARDS = 64
_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TIER = 0x9E3779B97F4A7C15
_BLOCK = "rows int, bits int, tiers int, keys array<long>, lengths array<int>, slices binary"


class Index(NamedTuple):
    """Blocks (bit-sliced signatures), dictionary (term, df) and the collection's N and L."""

    blocks: DataFrame
    dictionary: DataFrame
    documents: int
    terms: int


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, A-Z lower-cased."""
    return [t.translate(_LOWER) for t in _TERM.findall(text or "")]


def _key_bits(hashes: np.ndarray, tier: int, bits: int) -> np.ndarray:
    """(HASHES, n) bit numbers of the keys (term, tier); ``bits`` is a power of two."""
    a = mix64(hashes + np.uint64(_TIER * (tier + 1) % (1 << 64)))
    b = mix64(a) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(HASHES)]).astype(np.int64)


def _term_hashes(terms: list[str]) -> np.ndarray:
    """The hash of each term, the same as the block builder's."""
    return Words(*binary_views(pa.array(terms, pa.string()))).hashes()


class _Builder:
    """Open blocks of a task, one for each size class."""

    def __init__(self):
        self.open: dict[int, list[tuple]] = {}

    def add(self, key: int, length: int, hashes: np.ndarray, tf: np.ndarray):
        tier = np.floor(np.log2(tf)).astype(np.int64)
        load = int((tier + 1).sum())
        size = max(4, (load - 1).bit_length())
        rows = self.open.setdefault(size, [])
        rows.append((key, length, hashes, tier))
        if len(rows) >= max(8, min(BLOCK_ROWS, BLOCK_BITS // (BITS << size))):
            return self.close(size)
        return None

    def close(self, size: int) -> pa.RecordBatch:
        rows, bits = self.open.pop(size), BITS << size
        width = -(-len(rows) // 8)
        slices = np.zeros(bits * width, np.uint8)
        for r, (_, _, hashes, tier) in enumerate(rows):
            flag = np.uint8(128 >> (r & 7))
            for t in range(int(tier.max()) + 1):
                at = _key_bits(hashes[tier >= t], t, bits).ravel()
                slices[at * width + (r >> 3)] |= flag
        tiers = 1 + max(int(tier.max()) for *_, tier in rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(rows)], pa.int32()), pa.array([bits], pa.int32()), pa.array([tiers], pa.int32()),
             pa.array([[k for k, *_ in rows]], pa.list_(pa.int64())),
             pa.array([[n for _, n, *_ in rows]], pa.list_(pa.int32())), pa.array([slices.tobytes()], pa.binary())],
            names=["rows", "bits", "tiers", "keys", "lengths", "slices"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("text is not null")


def build_index(docs: DataFrame) -> Index:
    """Index the whole texts of ``docs`` (doc_id, text); its tables lie in the shared folder."""
    ready(docs.sparkSession)

    def run(batches):
        builder = _Builder()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = binary_views(batch.column(1))
            for i, j in slices(offsets):
                words = Words(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                hashes = words.hashes()
                for d in range(j - i):
                    lo, hi = words.first[d], words.first[d + 1]
                    if hi > lo:
                        own, tf = np.unique(hashes[lo:hi], return_counts=True)
                        full = builder.add(int(keys[i + d]), int(hi - lo), own, tf)
                        if full is not None:
                            yield full
        for size in sorted(builder.open):
            yield builder.close(size)

    blocks = materialise(_keyed(docs).select("key", "text").mapInArrow(run, _BLOCK), "blocks")
    held = docs.where("text is not null").select(F.explode(F.array_distinct(F.array_remove(F.split(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), ""))).alias("term"))
    dictionary = materialise(held.groupBy("term").agg(F.count("*").alias("df")), "dictionary")
    size = blocks.select(F.explode("lengths").alias("n")).agg(F.count("*").alias("d"), F.sum("n").alias("l")).first()
    return Index(blocks, dictionary, size.d, size.l or 0)


def weight(documents: int, df: int) -> int:
    """A term's weight in the ranking."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_part(n: int, documents: int, terms: int) -> int:
    """A document's m: its length against the mean, in per cent."""
    return 10 + (90 * n * documents) // terms


def term_score(tf: int, m: int) -> int:
    """What one unit of weight gives for ``tf`` occurrences; grows with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Items(NamedTuple):
    """A block of items as sent to the tasks: ids, and their terms in CSR form over ``terms``."""

    ids: list
    first: np.ndarray
    at: np.ndarray
    weights: np.ndarray
    terms: list[str]
    hashes: np.ndarray


def _item_blocks(items: DataFrame, index: Index, limit: int):
    """The items with at least one known term, in blocks of at most ``limit`` terms (one item at least)."""
    @F.udf("array<string>")
    def distinct_terms(text):
        return sorted(set(terms_of(text)))

    numbered = materialise(items.select("item_id", distinct_terms("text").alias("own"),
                                        F.monotonically_increasing_id().alias("no")), "terms")
    own = numbered.select("no", "item_id", F.explode("own").alias("term"))
    known = materialise(own.join(index.dictionary, "term").groupBy("no", "item_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms")), "items")
    ids, rows, size = [], [], 0
    for r in known.orderBy("no").toLocalIterator(prefetchPartitions=True):
        if rows and size + len(r.terms) > limit:
            yield _block(ids, rows, index)
            ids, rows, size = [], [], 0
        ids.append(r.item_id)
        rows.append([(t.term, t.df) for t in r.terms])
        size += len(r.terms)
    if rows:
        yield _block(ids, rows, index)


def _block(ids, rows, index: Index) -> _Items:
    terms = sorted({t for row in rows for t, _ in row})
    place = {t: i for i, t in enumerate(terms)}
    return _Items(ids, np.cumsum([0] + [len(r) for r in rows]),
                  np.array([place[t] for r in rows for t, _ in r], np.int64),
                  np.array([weight(index.documents, df) for r in rows for _, df in r], np.int64),
                  terms, _term_hashes(terms))


def _bounds(items: _Items, index: tuple[int, int], rows: int, bits: int, tiers: int, lengths, data) -> np.ndarray:
    """(items, rows) upper bounds of a block's documents."""
    width = -(-rows // 8)
    table = np.frombuffer(data, np.uint8).reshape(bits, width)
    m = [length_part(int(n), *index) for n in lengths]
    held = np.full((len(items.hashes), width), 255, np.uint8)
    out = np.zeros((len(items.ids), rows), np.int64)
    before = np.zeros(rows, np.int64)
    for t in range(tiers):
        live = np.flatnonzero(held.any(axis=1))
        if not len(live):
            break
        found = held[live]
        for at in _key_bits(items.hashes[live], t, bits):
            found &= table[at]
        held[:] = 0
        held[live] = found
        # tf of the tier is below 2 ** (t + 1), and at most the length
        best = np.array([term_score(min((2 << t) - 1, int(n)), x) for n, x in zip(lengths, m)], np.int64)
        step, before = best - before, best
        some = held.any(axis=1)
        for i in range(len(items.ids)):
            lo, hi = items.first[i], items.first[i + 1]
            use = np.flatnonzero(some[items.at[lo:hi]])
            if len(use):
                flags = np.unpackbits(held[items.at[lo:hi][use]], axis=1, count=rows)
                out[i] += step * (items.weights[lo:hi][use] @ flags)
    return out


def _scan(index: Index, items: _Items, sent, least, top: int | None) -> DataFrame:
    """(item, key, bound) of the documents whose bound reaches ``least`` (array by item) and is above 0.

    With ``top`` each task gives only its ``top`` highest bounds of every item.
    """
    size = (index.documents, index.terms)

    def run(batches):
        items, least = sent.value, floor.value
        best: list[list] = [[] for _ in items.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                rows, bits, tiers, keys, lengths, data = (batch.column(c)[r] for c in range(6))
                keys = np.array(keys.as_py(), np.int64)
                bound = _bounds(items, size, rows.as_py(), bits.as_py(), tiers.as_py(), lengths.as_py(), data.as_buffer())
                if top is None:
                    i, d = np.nonzero((bound > 0) & (bound >= least[:, None]))
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(i, pa.int32()), pa.array(keys[d]), pa.array(bound[i, d])], names=["item", "key", "bound"])
                    continue
                for i in np.flatnonzero(bound.max(axis=1) > 0):
                    for d in np.argsort(-bound[i], kind="stable")[:top]:
                        x = (int(bound[i, d]), int(keys[d]))
                        if x[0] <= 0 or len(best[i]) == top and x <= best[i][0]:
                            break
                        if len(best[i]) < top:
                            heapq.heappush(best[i], x)
                        else:
                            heapq.heapreplace(best[i], x)
        rows = [(i, k, b) for i, xs in enumerate(best) for b, k in xs]
        if rows:
            i, k, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int64()), pa.array(b, pa.int64())],
                                             names=["item", "key", "bound"])

    floor = index.blocks.sparkSession.sparkContext.broadcast(least)
    return index.blocks.mapInArrow(run, "item int, key long, bound long")


def _rank(found: DataFrame, order: list, top: int) -> DataFrame:
    """The ``top`` rows of every item by ``order``: per shard first, so no group holds the rows of all tasks."""
    for by in (["item", "_shard"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        found = found.withColumn("rank", place).where(F.col("rank") <= top)
    return found


def _exact(docs: DataFrame, wanted: DataFrame, sent, index: Index, top: int) -> DataFrame:
    """(item, doc_id, score) of the wanted (item, key) pairs, each task's ``top`` best of every item.

    The score is that of the whole text, whichever way the pair was found.
    """
    size = (index.documents, index.terms)

    def run(batches):
        items = sent.value
        best: dict[int, list] = {}
        for batch in batches:
            for doc_id, text, own in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc_id, tf = doc_id.as_py(), Counter(terms_of(text.as_py()))
                n = sum(tf.values())
                if not n:
                    continue
                m = length_part(n, *size)
                for i in set(own.as_py()):
                    lo, hi = items.first[i], items.first[i + 1]
                    score = 0
                    for at, w in zip(items.at[lo:hi].tolist(), items.weights[lo:hi].tolist()):
                        k = tf.get(items.terms[at], 0)
                        if k:
                            score += w * term_score(k, m)
                    if score > 0:
                        x = (score, doc_id is not None, -(doc_id or 0))
                        heap = best.setdefault(i, [])
                        if len(heap) < top:
                            heapq.heappush(heap, x)
                        elif x > heap[0]:
                            heapq.heapreplace(heap, x)
        rows = [(i, -d if known else None, s) for i, heap in best.items() for s, known, d in heap]
        if rows:
            i, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())],
                                             names=["item", "doc_id", "score"])

    asked = materialise(wanted.groupBy("key").agg(F.collect_set("item").alias("items")), "asked")
    small = asked.count() <= BROADCAST_KEYS
    texts = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    met = texts.join(F.broadcast(asked.select("key")) if small else asked.select("key").hint("shuffle_hash"), "key", "left_semi")
    # the surviving texts are few; the lists of items join them where they are
    met = met.join(asked.hint("merge"), "key")
    return met.select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def _best(scored: DataFrame, top: int) -> DataFrame:
    rows = scored.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))
    return _rank(rows, [F.desc("score"), F.asc_nulls_last("doc_id")], top).select("item", "rank", "doc_id", "score")


def search(index: Index, docs: DataFrame, items: DataFrame, top: int = TOP, seeds: int = SEEDS,
           item_terms: int = ITEM_TERMS) -> DataFrame:
    """The ``top`` documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` are the documents that were indexed, ``items`` has (item_id, text).
    """
    spark = docs.sparkSession
    ready(spark)
    result = None
    for block in _item_blocks(items, index, item_terms):
        sent = spark.sparkContext.broadcast(block)
        none = np.zeros(len(block.ids), np.int64)
        high = _rank(_scan(index, block, sent, none, seeds).withColumn("_shard", F.pmod("key", F.lit(SHARDS))),
                     [F.desc("bound"), F.asc("key")], seeds).select("item", "key")
        first = materialise(_best(_exact(docs, high, sent, index, top), top), "seeds")
        least = none.copy()
        for r in first.where(F.col("rank") == top).select("item", "score").collect():  # one row per item
            least[r.item] = r.score
        left = materialise(_scan(index, block, sent, least, None).select("item", "key").distinct(), "survivors")
        ranked = _best(_exact(docs, left, sent, index, top), top)
        names = spark.createDataFrame(list(enumerate(block.ids)), _names(items))
        part = materialise(ranked.join(names.hint("merge"), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        result = part if result is None else result.unionByName(part)
    if result is None:
        empty = items.select("item_id").limit(0)
        return empty.select("item_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                         (("rank", "int"), ("doc_id", "long"), ("score", "long"))])
    return result


def _names(items: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs`` and rank them for all ``items``."""
    return search(build_index(docs), docs, items, top)
