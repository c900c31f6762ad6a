"""Language identification by mixture inference (operator 8).

Training counts byte trigrams (lower-cased, everything that is not a letter or digit is one gap) per
language over all training documents; the counts are summed as rows. A document is a mixture of
languages: expectation-maximisation over its trigram likelihoods estimates the proportions. The set of
languages is selected by a penalised likelihood: for m = 1, 2, ... the mixture of the m largest
proportions is refitted, and the m with the least ``-2 log L + penalty * (m - 1) * log n`` stays. The
prediction is the largest proportion of that set, the score its value.

EM depends on a trigram only through its normalised likelihood vector, so trigrams with nearly the same
vector share one of ``PROFILES`` profiles and a document enters EM as its profile histogram; all
documents of a slice run through EM together. Scoring needs no shuffle.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0; NULL ``lang`` rows do not train;
without any training row everything is ``und``; very long texts are counted whole; repeated rows predict
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, binary_views, crc_mod, ready, slices

BINS = 1 << 14
PROFILES = 256
STEPS = 25
MAX_SET = 4
#: Neighbouring trigrams overlap, so their evidence is worth less than independent draws.
PENALTY = 3.0
UNKNOWN = "und"


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, text) of the trigrams that start at each byte that is not inside a longer gap."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    low = np.zeros(len(raw) + 2 * n + 2, np.uint32)
    at = np.arange(len(raw)) + 2 * np.repeat(np.arange(n), lens)  # two gap bytes after each text
    low[at] = _LOWER[raw]
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    text = np.repeat(np.arange(n), lens)
    code = code[at]
    keep = (code & np.uint32(0xFFFF)) != 0  # two gaps at its head: nothing said
    code, text = code[keep], text[keep]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS.bit_length() + 1), text


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n) over all documents (``lang``, ``text``)."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = binary_views(batch.column(1))
            lang = np.array(batch.column(0).to_pylist(), object)
            for i, j in slices(offsets):
                bins, text = trigrams(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for name in set(lang[i:j]):
                    own = np.flatnonzero(lang[i:j] == name)
                    mine = np.zeros(j - i, bool)
                    mine[own] = True
                    total = counts.setdefault(name, np.zeros(BINS, np.int64))
                    total += np.bincount(bins[mine[text]], minlength=BINS)
        for name, total in counts.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some])],
                names=["lang", "bin", "n"])

    counted = docs.select(docs["lang"].cast("string"), docs["text"]).mapInArrow(run, "lang string, bin int, n long")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages, the profile of every trigram bin, and the profiles' likelihood vectors."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: languages x bins."""
        self.langs = langs
        like = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BINS)
        share = (like / like.sum(0)).T  # bins x languages: all that EM sees of a trigram
        weight = counts.sum(0) + 1e-3
        k = min(PROFILES, BINS)
        order = np.lexsort((*share.T[::-1], share.argmax(1)))
        # deterministic k-means, seeded at even steps of weight along the sorted vectors
        cut = np.searchsorted(np.cumsum(weight[order]), (np.arange(k) + 0.5) / k * weight.sum())
        centre = np.log(share[order[np.minimum(cut, BINS - 1)]])
        logs = np.log(share)
        for _ in range(12):
            near = ((logs * logs).sum(1)[:, None] - 2 * logs @ centre.T + (centre * centre).sum(1)).argmin(1)
            mass = np.bincount(near, weight, k)
            for c in range(logs.shape[1]):
                total = np.bincount(near, weight * logs[:, c], k)
                centre[:, c] = np.where(mass > 0, total / np.maximum(mass, 1e-12), centre[:, c])
        self.profile = near.astype(np.int16)
        self.like = np.exp(centre)
        self.like /= self.like.sum(1, keepdims=True)

    def histograms(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bins, text = trigrams(raw, offsets)
        n, k = len(offsets) - 1, len(self.like)
        return np.bincount(text * k + self.profile[bins], minlength=n * k).reshape(n, k).astype(float)

    def fit(self, hist: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log likelihood) of each document over its allowed languages."""
        total = np.maximum(hist.sum(1, keepdims=True), 1e-9)
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS):
            mix = np.maximum(pi @ self.like.T, 1e-300)
            pi = pi * ((hist / mix) @ self.like) / total
            pi /= np.maximum(pi.sum(1, keepdims=True), 1e-300)
        return pi, (hist * np.log(np.maximum(pi @ self.like.T, 1e-300))).sum(1)

    def infer(self, hist: np.ndarray) -> np.ndarray:
        """Selected proportions of each document (0 outside the selected set)."""
        n, langs = len(hist), len(self.langs)
        whole, _ = self.fit(hist, np.ones((n, langs)))
        rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
        best = np.full(n, np.inf)
        out = whole
        for m in range(1, min(MAX_SET, langs) + 1):
            pi, logl = self.fit(hist, (rank < m).astype(float))
            cost = -2 * logl + PENALTY * (m - 1) * np.log(np.maximum(hist.sum(1), 2))
            better = cost < best - 1e-9
            out = np.where(better[:, None], pi, out)
            best = np.where(better, cost, best)
        return out


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        part = raw[offsets[d]:offsets[d + 1]]
        if (part >= 0x80).any():
            out[d] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame) -> Mixture | None:
    """Mixture model from all rows with ``lang`` and ``text``."""
    ready(docs.sparkSession)
    rows = language_counts(docs.where("lang is not null and text is not null")).collect()  # languages x bins
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    index = {name: k for k, name in enumerate(langs)}
    counts = np.zeros((len(langs), BINS))
    for r in rows:
        counts[index[r.lang], r.bin] = r.n
    return Mixture(langs, counts)


def identify(docs: DataFrame, model: Mixture | None) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` of every document row."""
    ready(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("mixture", pa.map_(pa.string(), pa.float64()))])

    def run(batches):
        own = shipped.value
        for batch in batches:
            raw, offsets = binary_views(batch.column(1))
            for i, j in slices(offsets):
                part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                known = has_letter(part, at)
                pred, score, mixture = [UNKNOWN] * (j - i), np.zeros(j - i), [[] for _ in range(j - i)]
                if own is not None and known.any():
                    pi = own.infer(own.histograms(part, at))
                    top = pi.argmax(1)
                    for d in np.flatnonzero(known):
                        pred[d], score[d] = own.langs[top[d]], min(1.0, float(pi[d, top[d]]))
                        mixture[d] = [(own.langs[k], float(pi[d, k])) for k in np.flatnonzero(pi[d] > 1e-3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(pred), pa.array(score),
                     pa.array(mixture, schema.field("mixture").type)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def language_id(docs: DataFrame) -> DataFrame:
    """The contract's result: train outside the held-out fold, predict everything."""
    model = train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return identify(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
