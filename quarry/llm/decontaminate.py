"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 4).

Every 13-word window of a benchmark item (the whole item when it is shorter) becomes one byte
pattern ``" w1 w2 ... "`` over normalised words, so a match always starts and ends at word borders.
Patterns of similar length share one set of Wu-Manber tables: for the block of ``B`` bytes that ends
at a text position the *shift table* tells how far the scan may jump without missing a pattern;
where the shift is zero the *suffix-hash bucket* lists the patterns that end in that block and a
direct byte comparison confirms the occurrence.

The scan itself runs in numpy over many lanes at once: the normalised bytes of a slice of documents
are cut into lanes and all lanes advance together by their own shifts. Documents stay where they
are (no shuffle). The patterns are shipped in blocks of bounded size; more benchmark text
than one block means further scans of the same rows in the same stage, whose word spans are merged.

Edge cases: NULL or empty text has no words (all counts 0, not contaminated); NULL or empty items
have no window; equal windows of several items count for every one of them; repeated ``doc_id`` rows
are kept as separate rows; documents may carry any extra columns (they are ignored); an empty
benchmark gives zero hits; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, binary_views, mix64, ready, slices

WINDOW = 13
#: Upper bound of pattern bytes shipped to the executors at once.
BLOCK_BYTES = 32 << 20
_TABLE_BITS = 18
_LANES = 2048

RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def joined_words(text: str | None) -> list[bytes]:
    """Normalised words of one text."""
    data = (text or "").encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    low = words.low.tobytes()
    return [low[a:b] for a, b in zip(words.start, words.end)]


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The patterns of one benchmark item."""
    words = joined_words(text)
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


class PatternGroup:
    """Wu-Manber tables of patterns whose lengths lie in one power-of-two class."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1) if b < 8 else np.uint64(2**64 - 1)
        self.shift = np.full(1 << _TABLE_BITS, m - b + 1, np.int32)
        self.bucket: dict[int, list[int]] = {}
        rows = np.frombuffer(b"".join(p[-m:] for p in patterns), np.uint8).reshape(-1, m)
        for end in range(b, m + 1):  # distance of the block from the end of the pattern
            slot = self.slots(self._codes(rows[:, end - b:end]))
            np.minimum.at(self.shift, slot, m - end)
        for i, code in enumerate(self._codes(rows[:, m - b:]).tolist()):
            self.bucket.setdefault(code, []).append(i)

    @staticmethod
    def _codes(cells: np.ndarray) -> np.ndarray:
        code = np.zeros(len(cells), np.uint64)
        for k in range(cells.shape[1]):
            code |= cells[:, k].astype(np.uint64) << np.uint64(8 * k)
        return code

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        return (mix64(codes) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def scan(self, buf: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(end position, pattern) of every occurrence in ``buf[:size]``; 8 spare bytes follow."""
        m, b = self.least, self.block
        if size < m:
            return []
        # one little-endian 8-byte code per position, read without copying the buffer
        codes = np.ndarray((size,), np.dtype("<u8"), buf, strides=(1,))
        lane = max(256, -(-(size - m + 1) // _LANES))
        pos = np.arange(m, size + 1, lane)  # exclusive end of the window under test
        stop = np.minimum(pos + lane, size + 1)
        text = buf.tobytes()
        found = []
        while len(pos):
            code = codes[pos - b] & self.mask
            step = self.shift[self.slots(code)]
            for at in np.flatnonzero(step == 0):
                end = int(pos[at])
                for p in self.bucket.get(int(code[at]), ()):
                    pattern = self.patterns[p]
                    if end >= len(pattern) and text[end - len(pattern):end] == pattern:
                        found.append((end, p))
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        return found


class Matcher:
    """All pattern groups of one block of windows, plus the items behind each window."""

    def __init__(self, windows: dict[bytes, list[str]]):
        by_class: dict[int, list[bytes]] = {}
        for p in sorted(windows):
            # one-byte-block groups only for the very short; else classes 1..15, 16..31, 32..63, ...
            by_class.setdefault(max(4, len(p).bit_length()), []).append(p)
        self.groups = [PatternGroup(ps) for ps in by_class.values()]
        self.items = windows
        self.words = {p: p.count(b" ") - 1 for p in windows}

    def match(self, raw: np.ndarray, offsets: np.ndarray):
        """Per text: number of words, merged word spans, sorted item ids."""
        words = Words(raw, offsets)
        n_docs = len(offsets) - 1
        counts = np.diff(words.first)
        lens = words.end - words.start
        # normalised buffer: for each text "\n", then " w" per word, then " "
        gaps = np.ones(len(lens), np.int64)
        extra = np.bincount(np.searchsorted(words.first, np.arange(len(lens)), side="right") - 1,
                            minlength=n_docs) if len(lens) else np.zeros(n_docs, np.int64)
        doc_of = np.repeat(np.arange(n_docs), extra)
        # start of word i in the buffer: bytes and gaps before it + 2 framing bytes per earlier text
        begin = np.cumsum(lens + gaps) - lens + 2 * doc_of + 1
        size = int((lens + gaps).sum() + 2 * n_docs)
        buf = np.full(size + 8, 0x20, np.uint8)
        total = int(lens.sum())
        if total:
            rel = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
            buf[np.repeat(begin, lens) + rel] = words.low[np.repeat(words.start, lens) + rel]
        doc_start = np.concatenate([[0], np.cumsum(np.bincount(doc_of, lens + gaps, n_docs)
                                                   .astype(np.int64) + 2)])[:-1]
        buf[doc_start] = 0x0A
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for group in self.groups:
            for end, p in group.scan(buf, size):
                pattern = group.patterns[p]
                # the match ends with the space after its last word
                last = int(np.searchsorted(begin, end - 1, side="left")) - 1
                doc = int(doc_of[last])
                k = self.words[pattern]
                rel_last = last - int(words.first[doc])
                spans.setdefault(doc, []).append((rel_last - k + 1, rel_last + 1))
                items.setdefault(doc, set()).update(self.items[pattern])
        return counts, spans, items


def merge_spans(spans) -> list[list[int]]:
    """Union of half-open word ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[dict[bytes, list[str]]]:
    """The distinct windows in blocks of at most ``block_bytes`` pattern bytes.

    Items are streamed block by block (``toLocalIterator``), so the driver holds one table of
    distinct windows; the contract's benchmark is a fixed, small table.
    """
    blocks: list[dict[bytes, list[str]]] = [{}]
    size = 0
    rows = benchmark.select("item_id", "text").where("item_id is not null").distinct()
    for row in rows.toLocalIterator():
        wins = set(item_windows(row.text, window))
        cost = sum(map(len, wins))
        if blocks[-1] and size + cost > block_bytes:
            blocks.append({})
            size = 0
        size += cost
        for p in wins:
            owners = blocks[-1].setdefault(p, [])
            if str(row.item_id) not in owners:
                owners.append(str(row.item_id))
    return blocks


_PARTIAL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                         T.StructField("items", T.ArrayType(T.StringType()))])
_SPANS = pa.list_(pa.list_(pa.int64()))
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                           ("n_items", pa.int64()), ("items_sha256", pa.string()),
                           ("contaminated", pa.bool_()), ("spans", _SPANS),
                           ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, windows: dict[bytes, list[str]], last: bool) -> DataFrame:
    """Add one block's spans and items to the rows; the last scan turns them into the result."""
    shipped = docs.sparkSession.sparkContext.broadcast(windows)  # <= BLOCK_BYTES of patterns
    out = T.StructType((RESULT if last else _PARTIAL).fields
                       + [f for f in docs.schema.fields if f.name == "row"])

    def run(batches):
        matcher = Matcher(shipped.value)
        for batch in batches:
            names = batch.schema.names
            ids, text = batch.column("doc_id"), batch.column("text")
            carried = [batch.schema.field(n) for n in names if n == "row"]
            raw, offsets = binary_views(text)
            earlier = list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())) \
                if "spans" in names else None
            for i, j in slices(offsets):
                counts, spans, items = matcher.match(raw[offsets[i]:offsets[j]],
                                                     offsets[i:j + 1] - offsets[i])
                rows = []
                for d in range(j - i):
                    s, it = list(spans.get(d, ())), set(items.get(d, ()))
                    if earlier:
                        s += map(tuple, earlier[i + d][0])
                        it.update(earlier[i + d][1])
                    rows.append((int(counts[d]), merge_spans(s), sorted(it)))
                own = ids.slice(i, j - i)
                more = [batch.column(f.name).slice(i, j - i) for f in carried]
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [own, text.slice(i, j - i), pa.array([r[1] for r in rows], _SPANS),
                         pa.array([r[2] for r in rows], pa.list_(pa.string())), *more],
                        schema=pa.schema([batch.schema.field("doc_id"), batch.schema.field("text"),
                                          ("spans", _SPANS), ("items", pa.list_(pa.string())), *carried]))
                    continue
                hit = [sum(b - a for a, b in r[1]) for r in rows]
                columns = [own, [r[0] for r in rows], hit, [len(r[2]) for r in rows],
                           [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows],
                           [h > 0 and 20 * h >= r[0] for h, r in zip(hit, rows)],
                           [r[1] for r in rows], [r[2] for r in rows]]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in zip(columns, _RESULT_ARROW)] + more,
                    schema=pa.schema([*_RESULT_ARROW, *carried]))

    return docs.mapInArrow(run, out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: counts, the contamination verdict, hit word spans and item ids.

    ``docs`` needs ``doc_id`` and ``text``; ``benchmark`` needs ``item_id`` and ``text``. Further
    pattern blocks are further scans of the same row in the same stage.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return _scan_all(rows, benchmark, window, block_bytes)


def _scan_all(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    ready(rows.sparkSession)
    blocks = pattern_blocks(benchmark, window, block_bytes)
    for k, block in enumerate(blocks):
        rows = _scan(rows, block, last=k == len(blocks) - 1)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The document rows that are not contaminated, with all their columns, decided row by row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _scan_all(rows, benchmark, window, block_bytes).where("not contaminated").select("row.*")
