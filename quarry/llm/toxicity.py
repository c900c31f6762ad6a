"""Toxicity scoring: Levenshtein automata x lexicon trie, context windows (operator 5).

The lexicon is learned from a bounded labelled sample: words, and stems (prefixes) of inflected
words, that stand in toxic documents far more often than in others. Its entries form one trie. The
Levenshtein automata of the entries are intersected with that trie: a state is the set of (trie node,
errors) pairs reachable by what was read, determinised once into a transition table. All words of a
text run through the table together, one character per step; most leave it after a few characters.
A hit knows its entry and its number of errors.

The characters around a hit form its context window: a hit between quotation marks, or after a word of
reporting, is quotation, the rest abuse. Hits are weighted by how often an entry at that distance was
right in the sample, summed separately for abuse and quotation, and a logistic model over these sums
gives the score. Every document is scored where it lies (no shuffle).

Only learning uses a sample: at most ``sample`` labelled documents, chosen by a hash of ``doc_id``.

Edge cases: NULL and empty texts have no hits and get the model's score of none; conflicting labels of a
``doc_id`` count as toxic if any is; NULL labels are ignored; labels of one class only (or none) give every
text the sample's rate (0 without labels) as its score; repeated rows score alike; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, ready, slices
from .linear import Logistic, sigmoid

SAMPLE = 20_000
#: A learned entry stands in at least this many toxic sample documents (and 0.3 % of them) ...
SUPPORT = 6
#: ... and this many times more often than in the others.
RATIO = 25.0
STEM = (4, 8)
TERMS = 20_000
ENTRIES = 200
WINDOW = 60
THRESHOLD = 0.3
#: Words that report what others said.
REPORTING = ("said", "says", "wrote", "called", "quote", "quoted", "dit", "sagte", "dijo")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


def errors_allowed(entry: str, stem: bool) -> int:
    """Levenshtein tolerance by length: short entries must be exact."""
    if stem:
        return 0 if len(entry) < 7 else 1
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class Lexicon:
    """Deterministic automaton of all entries with their tolerances.

    ``entries``: (text, stem). ``table[state, class]`` is the next state (0: dead); ``whole`` / ``stem`` give,
    per state, the accepted entry * 4 + errors for a word that ends there / for any continuation (-1: none).
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        alphabet = sorted({c for e, _ in entries for c in e})
        self.letter = {ord(c): k + 1 for k, c in enumerate(alphabet)}
        # the trie: children, entries that end at a node, the largest tolerance below it
        child: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        slack = [0]
        for k, (text, stem) in enumerate(entries):
            at, most = 0, errors_allowed(text, stem)
            slack[0] = max(slack[0], most)
            for c in text:
                nxt = child[at].get(self.letter[ord(c)])
                if nxt is None:
                    nxt = child[at][self.letter[ord(c)]] = len(child)
                    child.append({})
                    ends.append([])
                    slack.append(0)
                at = nxt
                slack[at] = max(slack[at], most)
            ends[at].append(k)

        def closed(pairs: dict[int, int]) -> tuple:
            """Add what deletions reach (an entry's letter that the word lacks), keep least errors."""
            queue = list(pairs.items())
            while queue:
                node, e = queue.pop()
                if e > pairs.get(node, 99):
                    continue
                for nxt in child[node].values():
                    if e + 1 <= slack[nxt] and e + 1 < pairs.get(nxt, 99):
                        pairs[nxt] = e + 1
                        queue.append((nxt, e + 1))
            return tuple(sorted(pairs.items()))

        start = closed({0: 0})
        number = {(): 0, start: 1}
        todo = [start]
        rows = [[0] * (len(alphabet) + 1)]
        states = [(), start]
        while todo:
            state = todo.pop(0)
            row = []
            for c in range(len(alphabet) + 1):  # class 0: any letter outside the lexicon
                pairs: dict[int, int] = {}
                for node, e in state:
                    hit = child[node].get(c)
                    if hit is not None and e < pairs.get(hit, 99):
                        pairs[hit] = e
                    if e < slack[node]:  # an extra letter in the word
                        if e + 1 < pairs.get(node, 99):
                            pairs[node] = e + 1
                    for letter, nxt in child[node].items():
                        if letter != c and e + 1 <= slack[nxt] and e + 1 < pairs.get(nxt, 99):
                            pairs[nxt] = e + 1
                nxt = closed(pairs)
                if nxt not in number:
                    number[nxt] = len(states)
                    states.append(nxt)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.whole = np.full(len(states), -1, np.int32)
        self.stem = np.full(len(states), -1, np.int32)
        for s, state in enumerate(states):
            best: dict[bool, tuple] = {}
            for node, e in state:
                for k in ends[node]:
                    text, stem = entries[k]
                    if e <= errors_allowed(text, stem):
                        best[stem] = min(best.get(stem, (9, 0)), (e, k))
            for stem, target in ((False, self.whole), (True, self.stem)):
                if stem in best:
                    target[s] = best[stem][1] * 4 + best[stem][0]
        size = max([0x250, *self.letter]) + 2
        self.classes = np.zeros(size, np.int16)
        for cp, c in self.letter.items():
            self.classes[cp] = c
        for cp in range(0x41, 0x5B):  # upper case ASCII reads as lower case
            self.classes[cp] = self.letter.get(cp + 32, 0)

    def scan(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, entry * 4 + errors) of the words ``start[k]:end[k]`` that match."""
        kind = self.classes[np.minimum(cp, len(self.classes) - 1)]
        best = np.full(len(start), -1, np.int32)
        live = np.arange(len(start))
        pos = start.copy()
        state = np.ones(len(start), np.int32)
        while len(live):
            state = self.table[state, kind[pos]]
            keep = state > 0
            live, pos, state = live[keep], pos[keep] + 1, state[keep]
            found = self.stem[state]
            done = pos >= end[live]
            found = np.where(done & (self.whole[state] >= 0)
                             & ((found < 0) | ((self.whole[state] & 3) <= (found & 3))), self.whole[state], found)
            some = found >= 0
            if some.any():
                at, new = live[some], found[some]
                old = best[at]
                best[at] = np.where((old < 0) | ((new & 3) < (old & 3)), new, old)
            go = ~done
            live, pos, state = live[go], pos[go], state[go]
        word = np.flatnonzero(best >= 0)
        return word, best[word]


def word_ranges(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words (ASCII letters and digits, non-ASCII characters); texts begin at ``first``."""
    inside = (cp >= 0x80) | ((cp >= 0x30) & (cp <= 0x39)) | ((cp | 0x20) >= 0x61) & ((cp | 0x20) <= 0x7A)
    # quotation marks and other general punctuation outside ASCII separate words here
    inside &= ~(((cp >= 0x2000) & (cp <= 0x206F)) | (cp == 0xAB) | (cp == 0xBB) | (cp == 0xA0))
    border = np.zeros(len(cp) + 1, bool)
    border[first] = True
    border[len(cp)] = True
    start = inside & (border[:-1] | ~np.append(False, inside[:-1]))
    end = inside & (border[1:] | ~np.append(inside[1:], False))
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the context window shows a quotation rather than abuse."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    left, right = left[left.rfind("\n") + 1:], right.partition("\n")[0]
    for o, c in zip(_OPEN, _CLOSE):
        if o == c:
            if left.count(o) % 2 == 1 and c in right:
                return True
        elif left.rfind(o) > left.rfind(c) and c in right:
            return True
    before = left.lower().split()[-2:]
    return any(w.strip(".,:;") in REPORTING for w in before)


def _hits(lexicon: Lexicon, texts: list[str]):
    """Per text: number of words and hits (entry * 4 + errors, quoted)."""
    whole = "".join(texts)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out: list[list[tuple[int, bool]]] = [[] for _ in texts]
    if not len(cp):
        return np.zeros(len(texts), np.int64), out
    start, end = word_ranges(cp, at[:-1][np.diff(at) > 0])
    words = np.diff(np.searchsorted(start, at))
    word, code = lexicon.scan(cp, start, end)
    doc = np.searchsorted(at, start[word], side="right") - 1
    for w, c, d in zip(word.tolist(), code.tolist(), doc.tolist()):
        a = int(at[d])
        out[d].append((c, quoted(texts[d], int(start[w]) - a, int(end[w]) - a)))
    return words, out


def _texts(batch_column):
    """Lists of texts of about a million characters."""
    part, size = [], 0
    for v in batch_column:
        part.append(v.as_py() or "")
        size += len(part[-1])
        if size > 1 << 20:
            yield part
            part, size = [], 0
    if part:
        yield part


class Model:
    """Lexicon, hit weights by (entry, errors), and the logistic layer."""

    def __init__(self, lexicon: Lexicon | None, weights: dict[int, float], layer: Logistic | None, base: float):
        self.lexicon, self.weights, self.layer, self.base = lexicon, weights, layer, base

    def features(self, words, hits) -> np.ndarray:
        out = np.zeros((len(hits), 4))
        for d, own in enumerate(hits):
            if own:
                sums = [0.0, 0.0]
                for code, quotation in own:
                    sums[quotation] += self.weights.get(code, 0.0)
                out[d, :2] = np.log1p(sums)
                out[d, 2] = np.log1p(100 * sums[0] / max(1, words[d]))
                out[d, 3] = float(sums[0] >= 0.25)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.layer is None:
            return np.full(len(texts), self.base)
        return sigmoid(self.layer.logit(self.features(*_hits(self.lexicon, texts))))


def _terms_of(text: str) -> set[str]:
    """Words and stems of a text; stems are marked with a trailing ``*``."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return set()
    start, end = word_ranges(cp, np.array([0]))
    words = {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[a:b])
             if not text[a:b].islower() else text[a:b] for a, b in zip(start.tolist(), end.tolist())}
    out = {w for w in words if 3 <= len(w) <= 40}
    for w in words:
        out.update(w[:n] + "*" for n in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def _document_counts(rows: DataFrame, only: DataFrame | None = None, wanted=None) -> DataFrame:
    """(term, n): number of texts that hold each term."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for v in batch.column(0):
                terms = _terms_of(v.as_py() or "")
                counts.update(terms if wanted is None else terms & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def telling_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> set[str]:
    """Words and stems far more frequent in toxic documents."""
    least = max(SUPPORT, 0.003 * n_toxic)
    return {term for term, t in toxic.items()
            if t >= least and (t + 0.5) / n_toxic >= RATIO * (clean.get(term, 0) + 0.5) / max(1, n_clean)}


def choose_entries(documents: list[set[str]], least: float) -> list[tuple[str, bool]]:
    """Greedy discounted cover of the toxic documents by telling terms (``documents``: those of each).

    Every entry halves the weight of its documents for the entries after it, so words that merely
    share the copies of one toxic document with real entries soon weigh too little, while a real
    entry gathers weight from documents of all kinds. A word is preferred to its stems unless the stem
    gathers clearly more; terms that the new entry covers leave the race.
    """
    terms = sorted(set().union(*documents)) if documents else []
    index = {t: k for k, t in enumerate(terms)}
    holds = np.zeros((len(terms), len(documents)), np.float32)
    for d, own in enumerate(documents):
        holds[[index[t] for t in own], d] = 1
    size = holds.sum(1)
    prefer = np.array([1.0 if t.endswith("*") else 1.5 for t in terms])
    length = np.array([len(t) for t in terms])
    weight = np.ones(len(documents), np.float32)
    live = np.ones(len(terms), bool)
    entries: list[tuple[str, bool]] = []
    while live.any() and len(entries) < ENTRIES:
        gain = holds @ weight * live
        best = int(np.lexsort((length, np.round(gain * prefer, 3)))[-1])
        if gain[best] < least:
            live[best] = False
            live &= gain >= least
            continue
        stem, text = terms[best].endswith("*"), terms[best].rstrip("*")
        entries.append((text, stem))
        weight[holds[best] > 0] *= 0.5
        for k in np.flatnonzero(live):
            other = terms[k].rstrip("*")
            covered = stem and other.startswith(text)
            same = text.startswith(other) or other.startswith(text)
            live[k] &= not (covered or same and size[k] <= 1.5 * size[best])
    return entries


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    ready(spark)
    truth = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("label"))
             .where("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label")))
    some = F.broadcast(bounded_sample(truth, "_id", sample, 11))  # at most ``sample`` rows
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"]).join(some, "_id").select(
        "_id", "text", "label")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(None, {}, None, float(n_toxic > 0))
    least = max(SUPPORT, 0.003 * n_toxic)
    top = (_document_counts(rows.where("label = 1")).where(F.col("n") >= math.ceil(least))
           .orderBy(F.desc("n"), "term").limit(TERMS * 2).collect())  # a bounded list of terms
    toxic = {r.term: r.n for r in top}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r.term: r.n for r in _document_counts(rows.where("label = 0"), wanted=wanted).collect()}
    telling = spark.sparkContext.broadcast(telling_terms(toxic, clean, n_toxic, n_clean))

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(_terms_of(v.as_py() or "") & telling.value) for v in batch.column(0)],
                          pa.list_(pa.string()))], names=["terms"])

    documents = [set(t) for t in rows.where("label = 1").select("text").mapInArrow(held, "terms array<string>")
                 .toArrow()["terms"].to_pylist()]  # of at most ``sample`` documents
    entries = choose_entries(documents, least)
    if not entries:
        return Model(None, {}, None, n_toxic / (n_toxic + n_clean))
    shipped = spark.sparkContext.broadcast(Lexicon(entries))

    def run(batches):
        for batch in batches:
            done = 0
            for texts in _texts(batch.column("text")):
                words, hits = _hits(shipped.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(done, len(texts)), pa.array(words, pa.int64()),
                     pa.array([[2 * c + q for c, q in h] for h in hits], pa.list_(pa.int32()))],
                    names=["label", "words", "hits"])
                done += len(texts)

    got = rows.mapInArrow(run, "label int, words long, hits array<int>").toArrow()
    label, words = got["label"].to_numpy(), got["words"].to_numpy()
    hits = [[(v >> 1, bool(v & 1)) for v in h] for h in got["hits"].to_pylist()]
    tox, all_ = Counter(), Counter()
    for y, own in zip(label, hits):
        for code in {c for c, _ in own}:
            all_[code] += 1
            tox[code] += int(y)
    # how often a hit of this entry at this distance stood in a toxic document, shrunk to the base rate
    base = n_toxic / (n_toxic + n_clean)
    weights = {c: max(0.0, ((tox[c] + 2 * base) / (all_[c] + 2) - base) / (1 - base)) for c in all_}
    for k, (text, stem) in enumerate(entries):  # an unseen misspelling is worth half the next closer form
        for e in range(1, errors_allowed(text, stem) + 1):
            weights.setdefault(4 * k + e, 0.5 * weights.get(4 * k + e - 1, 0.5))
    model = Model(shipped.value, weights, None, base)
    model.layer = Logistic(l2=1e-4, steps=400).fit(model.features(words, hits), label)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every document row."""
    ready(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [shipped.value.score(t) for t in _texts(batch.column(1))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's result: learn outside the held-out fold, score everything."""
    train = labels.where(crc_mod(F.col("doc_id"), 4) != 2)
    model = learn(docs, train, sample)
    return score_toxicity(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
