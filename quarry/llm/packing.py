"""Order-preserving sequence packing by dynamic programming (operator 9).

Documents are tokenised and laid end to end in their input order (each followed by the end id). The
stream of a partition is cut into windows of at most ``size`` ids. Cuts are only made at document
ends, sentence ends or - inside sentences longer than ``STRIDE`` ids - at hard marks. The dynamic
program minimises ``padding + cut penalties``: for a cut ``j`` after a cut ``i``

    cost[j] = min over i with S[j] - S[i] <= size of cost[i] + size - (S[j] - S[i]) + penalty[j]

where ``S`` counts ids. The minimum over the sliding range of ``i`` is kept by a monotone queue
(every cut enters and leaves it once), and a window whose length is a power of two needs no padding,
which adds one lookup per power. A partition's work is done in bounded stretches: the best cut near
the end of a stretch closes it and the rest opens the next, so memory does not follow the partition.

Tokenising: the pre-tokens of the byte-level BPE are found with array operations over code points,
equal pre-tokens are encoded once per worker by the ``tokenizers`` library, and the ids are gathered
per occurrence. Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` (tested).

No shuffle: each partition packs what it holds; sequence ids are the partition number and a running
number, so a recomputed task gives the same rows. Rows of one sequence are in one partition.

Edge cases: NULL or empty text is the end id alone; very long documents span many sequences; repeated
rows are packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _POW, mix64, ready

SIZE = 2048
END_ID = 1
#: Penalties of a cut, in padding ids: at a document end, at a sentence end, inside a sentence.
PENALTIES = (0.0, 4.0, 64.0)
STRIDE = 512
#: Ids per stretch of the dynamic program.
STRETCH = 1 << 17
#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMORY = 800_000
SPECIAL = "<|endoftext|>"

_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("sequence_length", T.LongType()),
])


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = 1
        elif kind == "N":
            out[cp] = 2
    # the White_Space property
    for cp in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]:
        out[cp] = 3
    return out


_BYTE_LEVEL = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_spelling() -> dict[int, int]:
    """Code point that spells each byte in the vocabulary: itself if printable, else 256, 257, ..."""
    rest = [b for b in range(256) if b not in set(_BYTE_LEVEL)]
    return {b: b for b in _BYTE_LEVEL} | {b: 256 + k for k, b in enumerate(rest)}


class PreTokens:
    """Start offsets of the pre-tokens in an array of code points (texts framed by ``first``)."""

    table: np.ndarray | None = None

    @classmethod
    def starts(cls, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``first``: offset of each non-empty text. Every text starts a pre-token."""
        if cls.table is None:
            cls.table = _classes()
        n = len(cp)
        kind = cls.table[cp]
        edge = np.zeros(n + 1, bool)  # a text border stands before this code point
        edge[first] = True
        edge[n] = True
        run = edge[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        space = kind == 3
        # white space: all but its last character form one pre-token; the last joins what follows
        # if it is a blank, else it stands alone; at the end of a text the run stays whole
        last = np.flatnonzero(space & np.append(run[1:], True))
        last = last[~edge[last + 1]]
        start[last] = True
        blank = cp[last] == 0x20
        start[last[blank] + 1] = False
        # contractions: an apostrophe that starts a pre-token, followed by s t m d / re ve ll
        apo = np.flatnonzero((cp == 0x27) & start)
        apo = apo[(apo + 1 < n) & ~edge[np.minimum(apo + 1, n)]]
        if len(apo):
            padded = np.append(cp, [0, 0])
            inner = np.append(edge, [True, True])
            one, two = padded[apo + 1], padded[apo + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
                | ((one == ord("l")) & (two == ord("l")))
            pair &= ~inner[apo + 2]
            for hit, width in ((short, 2), (pair & ~short, 3)):
                at = apo[hit]
                start[at + 1] = False
                after = at + width
                after = after[after < n]
                # what follows the contraction begins a new pre-token unless it is a blank that
                # already does
                start[after] = True
        return np.flatnonzero(start)


class Encoder:
    """Ids of texts through one encoding per distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        ends = [False] * size
        for token, i in self.tokenizer.get_vocab().items():
            # bytes are spelled as printable characters: U+010A is the line feed
            ends[i] = token[-1:] in ".!?Ċ" or "Ċ" in token
        self.sentence_end = np.array(ends)
        self.spelling = byte_spelling()
        self.mix = mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        known = len(self.index)
        while known + len(keys) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        tokens = self.tokenizer.model.tokenize  # a pre-token needs the merges only
        ids = [[t.id for t in tokens(w.encode("utf-8", "surrogatepass").decode("latin-1")
                                     .translate(self.spelling))] for w in words]
        lens = np.array([len(x) for x in ids], np.int64)
        total = int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.fromiter((v for x in ids for v in x), np.uint16, total)
        self.begin[known:known + len(keys)] = self.used + np.cumsum(lens) - lens
        self.count[known:known + len(keys)] = lens
        self.used += total
        self.index.update(zip(keys, range(known, known + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts); no end ids."""
        special = [k for k, t in enumerate(texts) if SPECIAL in t]
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(lens)])
        if not len(cp):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        start = PreTokens.starts(cp, at[:-1][lens > 0])
        size = np.diff(np.append(start, len(cp)))
        pos = np.arange(len(cp)) - np.repeat(start, size)
        placed = self.mix[cp]
        if size.max() > 1024:
            placed = placed * _POW[pos & 1023] + (pos >> 10).astype(np.uint64)
        else:
            placed *= _POW[pos]
        keys = np.add.reduceat(placed, start)
        keys = mix64(keys + size.astype(np.uint64))
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(self.index) + len(names) > MEMORY:
            self.forget()
        fresh = [k for k, name in enumerate(names) if name not in self.index]
        if fresh:
            self._learn([names[k] for k in fresh],
                        [whole[start[w]:start[w] + size[w]] for w in where[fresh].tolist()])
        slot = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[back]
        count = self.count[slot]
        ends = np.cumsum(count)
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.begin[slot] - (ends - count), count)]
        offsets = np.concatenate([[0], ends])[np.searchsorted(start, at)]
        if special:  # rare: texts that spell a special token go through the tokenizer whole
            parts = [ids[offsets[k]:offsets[k + 1]] for k in range(len(texts))]
            for k in special:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint16)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, offsets


def cut_windows(cuts: np.ndarray, penalty: np.ndarray, size: int, final: bool) -> list[int]:
    """Positions at which windows end.

    ``cuts``: ascending candidate positions, the first is 0 (the start), gaps at most ``size``. With
    ``final`` the last candidate must be a cut; otherwise the windows end at the best candidate of
    the last ``size`` ids.
    """
    at = cuts.tolist()
    fee = penalty.tolist()
    n = len(at)
    cost = [0.0] * n
    back = [0] * n
    queue: deque[int] = deque([0])  # candidates with ascending cost[i] + at[i]
    # candidates exactly a power of two before each candidate, all looked up at once
    place = np.full(at[-1] + 1, -1, np.int64)
    place[cuts] = np.arange(n)
    exact: dict[int, list[int]] = {}
    for k in range(size.bit_length()):
        if 1 << k <= size:
            here = np.flatnonzero(cuts >= 1 << k)
            i = place[cuts[here] - (1 << k)]
            for a, b in zip(here[i >= 0].tolist(), i[i >= 0].tolist()):
                exact.setdefault(a, []).append(b)
    none: tuple = ()
    for j in range(1, n):
        here = at[j]
        while here - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = cost[i] + at[i] + size - here
        for k in exact.get(j, none):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j] = total = best + fee[j]
        back[j] = i
        total += here
        while queue and cost[queue[-1]] + at[queue[-1]] >= total:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        tail = [k for k in range(1, n) if at[k] > at[-1] - size]
        j = min(tail, key=lambda k: (cost[k] + (at[-1] - at[k]) * 1e-6, -k))
    out = []
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Cuts a stream of tokenised documents into sequences and yields rows of pieces."""

    def __init__(self, size: int, sentence_end: np.ndarray, partition: int, stretch: int = STRETCH):
        self.size, self.sentence_end, self.stretch = size, sentence_end, stretch
        self.sequence = partition << 33
        self.pieces: list[list] = []  # doc_id, start in the document, ids, document's number of ids
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.pieces.append([doc_id, 0, ids, len(ids)])
        self.held += len(ids)
        while self.held >= self.stretch:
            yield self.flush(False)

    def flush(self, final: bool) -> list[tuple]:
        if not self.held:
            return []
        # only a bounded stretch of the stream enters one dynamic program
        taken, total = [], 0
        for piece in self.pieces:
            room = self.stretch + self.size - total
            taken.append(piece[2][:room])
            total += len(taken[-1])
            if total >= self.stretch + self.size:
                break
        whole = final and total == self.held
        ids = np.concatenate(taken)
        fee = np.full(total + 1, np.inf)
        hard = np.arange(0, total + 1, min(STRIDE, max(1, self.size // 4)))
        fee[hard] = PENALTIES[2]
        fee[np.flatnonzero(self.sentence_end[ids]) + 1] = PENALTIES[1]
        ends = np.cumsum([len(t) for t in taken])
        done = [k for k in range(len(taken)) if len(taken[k]) == len(self.pieces[k][2])]
        fee[ends[done]] = PENALTIES[0]
        fee[0] = 0
        if whole:
            fee[total] = 0
        cuts = np.flatnonzero(np.isfinite(fee))
        rows = []
        begin = 0
        for end in cut_windows(cuts, fee[cuts], self.size, whole):
            rows += self._sequence(end - begin)
            begin = end
        return rows

    def _sequence(self, length: int) -> list[tuple]:
        rows, offset, used = [], 0, 0
        while offset < length:
            doc_id, start, ids, total = piece = self.pieces[used]
            n = min(len(ids), length - offset)
            part = ids[:n]
            crc = zlib.crc32(part.astype("<u4").tobytes())
            rows.append((doc_id, start, n, crc, total, self.sequence, offset, length))
            offset += n
            if n == len(ids):
                used += 1
            else:
                piece[1] += n
                piece[2] = ids[n:]
        del self.pieces[:used]
        self.held -= length
        self.sequence += 1
        return rows


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence (see the module docstring).

    ``path`` names the tokenizer file: a byte-level BPE of fewer than 65,536 ids with the usual
    pre-token pattern (default: the public one of 50k ids).
    """
    ready(docs.sparkSession)
    path = path or tokenizer_path()
    names = [f.name for f in _OUT]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        packer = Packer(size, encoder.sentence_end, TaskContext.get().partitionId())

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * len(names))], schema=schema)

        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            at, n = 0, len(ids)
            while at < n:  # texts of about a million characters at a time
                texts, chars, first = [], 0, at
                while at < n and (chars < 1 << 20 or not texts):
                    texts.append(text[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                tokens, offsets = encoder.encode(texts)
                rows = []
                for k in range(len(texts)):
                    own = np.append(tokens[offsets[k]:offsets[k + 1]], np.uint16(END_ID))
                    for part in packer.add(ids[first + k], own):
                        rows += part
                if rows:
                    yield out(rows)
        while packer.held:
            yield out(packer.flush(True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, _OUT)
