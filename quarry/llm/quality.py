"""Quality classifier by co-training (operator 3).

Two views of a document: its *text content* (hashed byte trigrams and shares of
repeated words, a linear model that scores a text in one pass) and its *page metadata* (length, lines, line length, shares
of character kinds, language and source). Each view starts from the labelled sample. In every round
each view labels the unlabelled pool, hands its most confident positives and negatives to the other
view as pseudo-labels, and both are refitted. The final views are calibrated on labelled rows kept
out of the fit (Platt) and combined; every document is scored where it lies (no shuffle).

Only fitting uses samples: at most ``labelled`` labelled rows and ``pool`` unlabelled rows, chosen by
a hash of ``doc_id``. Scoring covers all rows and whole texts.

Edge cases: NULL or empty text scores 0 and is not accepted; conflicting labels of one ``doc_id`` go
by their mean (ties count as good), NULL labels are ignored; labels of one class only (or none) give
that class's constant (1.0 without any label) to every non-empty text; repeated rows score alike;
NULL ``lang`` / ``source`` are values of their own and missing columns are treated as NULL; extra columns
are kept by ``keep_good``; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, binary_views, bounded_sample, ready, slices
from .linear import Logistic, Platt, sigmoid

LABELLED = 4000
POOL = 4000
ROUNDS = 3
#: Pseudo-labels per view, round and class, as a share of the pool, and the confidence they need.
SHARE = 0.04
CONFIDENT = 0.95
BINS = 1 << 10
#: Shares of words that repeat the word 1, 2, ... places before.
LAGS = 4
_KINDS = 8
_HASHED = 16
META = 4 + _KINDS + 2 * _HASHED

_KIND = np.full(256, 7, np.uint8)  # 7: control characters
for _c in range(32, 256):
    _KIND[_c] = (0 if chr(_c).islower() and _c < 128 else 1 if chr(_c).isupper() and _c < 128 else
                 2 if 48 <= _c <= 57 else 3 if _c == 32 else 4 if _c >= 128 else
                 5 if chr(_c) in ".,;:'\"-()" else 6)


def trigram_bins(raw: np.ndarray) -> np.ndarray:
    """Bin of the three bytes that start at each position (two fewer than bytes)."""
    code = raw[:-2].astype(np.uint32)
    code |= raw[1:-1].astype(np.uint32) << np.uint32(8)
    code |= raw[2:].astype(np.uint32) << np.uint32(16)
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - BINS.bit_length() + 1)
    return code


def repeat_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text's words that equal the word ``k`` places before (k = 1 .. LAGS)."""
    words = Words(raw, offsets)
    h = words.hashes()
    counts = np.diff(words.first)
    place = np.arange(len(h)) - np.repeat(words.first[:-1], counts)
    out = np.zeros((len(counts), LAGS), np.float32)
    for k in range(1, LAGS + 1):
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) if len(h) > k else False
        same &= place >= k
        total = np.concatenate([[0], np.cumsum(same)])
        out[:, k - 1] = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(counts, 1)
    return out


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram frequencies (rows sum to 1; 0 for texts under three bytes), then repeat shares."""
    out = np.zeros((len(offsets) - 1, BINS + LAGS), np.float32)
    out[:, BINS:] = repeat_shares(raw, offsets)
    for d in range(len(offsets) - 1):
        part = raw[offsets[d]:offsets[d + 1]]
        if len(part) > 2:
            out[d, :BINS] = np.bincount(trigram_bins(part), minlength=BINS) / (len(part) - 2)
    return out


def text_scores(raw: np.ndarray, offsets: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """``text_features(...) @ coef`` without the matrix."""
    out = repeat_shares(raw, offsets) @ coef[BINS:]
    lens = np.diff(offsets)
    some = np.flatnonzero(lens > 2)
    if len(some):
        value = np.append(coef[:BINS][trigram_bins(raw)], [0.0, 0.0])
        total = np.concatenate([[0.0], np.cumsum(value)])
        out[some] += (total[offsets[some + 1] - 2] - total[offsets[some]]) / (lens[some] - 2)
    return out


def meta_features(raw: np.ndarray, offsets: np.ndarray, lang: list, source: list) -> np.ndarray:
    """The metadata view of each document."""
    import zlib
    n = len(offsets) - 1
    lens = np.diff(offsets)
    out = np.zeros((n, META), np.float32)
    kind = _KIND[raw]
    lines = np.zeros(n)
    for k in range(_KINDS):
        hits = np.concatenate([[0], np.cumsum(kind == k)])
        out[:, 4 + k] = (hits[offsets[1:]] - hits[offsets[:-1]]) / np.maximum(lens, 1)
    hits = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = hits[offsets[1:]] - hits[offsets[:-1]] + 1
    out[:, 0] = np.log1p(lens)
    out[:, 1] = np.log1p(lines)
    out[:, 2] = np.log1p(lens / lines)
    out[:, 3] = lens > 0
    for column, values in ((4 + _KINDS, lang), (4 + _KINDS + _HASHED, source)):
        for d, v in enumerate(values):
            out[d, column + zlib.crc32(repr(v).encode()) % _HASHED] = 1
    return out


class CoTrained:
    """Two fitted and calibrated views."""

    def __init__(self, text: Logistic, meta: Logistic, text_cal: Platt, meta_cal: Platt,
                 constant: float | None = None):
        self.text, self.meta, self.text_cal, self.meta_cal = text, meta, text_cal, meta_cal
        self.constant = constant

    def score(self, raw, offsets, lang, source):
        """(text view, metadata view, combined) probabilities of good quality."""
        empty = np.diff(offsets) == 0
        if self.constant is not None:
            p = np.where(empty, 0.0, self.constant)
            return p, p, p
        zt = self.text_cal(text_scores(raw, offsets, self.text.coef) + self.text.bias)
        zm = self.meta_cal(self.meta.logit(meta_features(raw, offsets, lang, source)))
        return tuple(np.where(empty, 0.0, sigmoid(z)) for z in (zt, zm, (zt + zm) / 2))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS,
             share: float = SHARE, confident: float = CONFIDENT) -> CoTrained:
    """Fit both views; ``label`` is 0, 1 or -1 (unlabelled)."""
    known = np.flatnonzero(label >= 0)
    y = label[known]
    if len(known) == 0 or y.min() == y.max():
        return CoTrained(None, None, None, None, float(y[0]) if len(known) else 1.0)
    # every fifth labelled row of each class calibrates, the rest train
    order = np.concatenate([np.flatnonzero(y == c) for c in (0, 1)])
    held = np.zeros(len(known), bool)
    held[order[::5]] = True
    train, cal = known[~held], known[held]
    if len(np.unique(label[train])) < 2:
        train, cal = known, known
    pool = np.flatnonzero(label < 0)
    views = {"text": text, "meta": meta}
    rows = {v: train for v in views}
    answers = {v: label[train].astype(np.float64) for v in views}
    models: dict[str, Logistic] = {}
    free = {v: np.ones(len(pool), bool) for v in views}  # not yet pseudo-labelled for that view
    for r in range(rounds + 1):
        for v, x in views.items():
            # every class weighs as in the labelled rows, however many pseudo-labels it got
            prior = label[train].mean()
            got = answers[v].mean()
            weight = np.where(answers[v] > 0, prior / got, (1 - prior) / (1 - got))
            models[v] = Logistic().fit(x[rows[v]], answers[v], weight)
        if r == rounds or not len(pool):
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(models[v].logit(views[v][pool]))
            most = max(1, int(share * len(pool)))
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                ok = np.flatnonzero((sure >= confident) & free[other])
                pick = ok[np.argsort(-sure[ok], kind="stable")[:most]]
                free[other][pick] = False
                rows[other] = np.concatenate([rows[other], pool[pick]])
                answers[other] = np.concatenate([answers[other], np.full(len(pick), value)])
    cals = {v: Platt().fit(models[v].logit(x[cal]), label[cal]) for v, x in views.items()}
    return CoTrained(models["text"], models["meta"], cals["text"], cals["meta"])


def _inputs(docs: DataFrame) -> list:
    have = set(docs.columns)
    return [docs["text"].alias("text"),
            *[(docs[c] if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]]


def training_rows(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> DataFrame:
    """(text, lang, source, label) of the bounded samples; label -1 marks the pool."""
    truth = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_q"))
             .where("_id is not null and _q is not null").groupBy("_id")
             .agg((F.avg("_q") >= 0.5).cast("int").alias("label")))
    some = bounded_sample(truth, "_id", labelled, 3)
    ids = docs.select(docs["doc_id"].cast("long").alias("_id")).where("_id is not null").distinct()
    rest = bounded_sample(ids.join(truth.select("_id"), "_id", "left_anti"), "_id", pool, 5) \
        .withColumn("label", F.lit(-1))
    wanted = F.broadcast(some.unionByName(rest))  # at most labelled + pool rows
    return docs.select(docs["doc_id"].cast("long").alias("_id"), *_inputs(docs)).join(wanted, "_id")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL,
        rounds: int = ROUNDS) -> CoTrained:
    """Co-train on bounded samples; features are computed on the executors."""
    ready(docs.sparkSession)
    rows = training_rows(docs, labels, labelled, pool).select("_id", "text", "lang", "source", "label")
    schema = pa.schema([("_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary()), ("m", pa.binary())])

    def run(batches):
        for batch in batches:
            raw, offsets = binary_views(batch.column("text"))
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, j in slices(offsets):
                part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                x = text_features(part, at).astype(np.float16)
                m = meta_features(part, at, lang[i:j], source[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i),
                     batch.column("label").slice(i, j - i).cast(pa.int32()),
                     pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([r.tobytes() for r in m], pa.binary())], schema=schema)

    out = rows.mapInArrow(run, "_id long, label int, x binary, m binary").toArrow()
    order = np.argsort(out["_id"].to_numpy(), kind="stable")
    label = out["label"].to_numpy()[order]
    # repeated rows of a sampled id would lift the bound: each id trains once
    ids = out["_id"].to_numpy()[order]
    order = order[np.append(True, ids[1:] != ids[:-1])] if len(ids) else order
    label = out["label"].to_numpy()[order]
    # filled row by row: the driver holds one copy of the features
    x = np.empty((len(order), BINS + LAGS), np.float32)
    m = np.empty((len(order), META), np.float32)
    xs, ms = out["x"].combine_chunks(), out["m"].combine_chunks()
    for k, r in enumerate(order.tolist()):
        x[k] = np.frombuffer(xs[r].as_buffer(), np.float16)
        m[k] = np.frombuffer(ms[r].as_buffer(), np.float32)
    del out, xs, ms
    return co_train(x, m, label, rounds)


def score_quality(docs: DataFrame, labels: DataFrame, model: CoTrained | None = None,
                  threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, p_text, p_meta, score, accepted`` of every document row."""
    model = model or fit(docs, labels, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("p_text", pa.float64()), ("p_meta", pa.float64()),
                        ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches):
        for batch in batches:
            p = _scored(model, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v) for v in p], pa.array(p[2] >= threshold)],
                schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_inputs(docs)).mapInArrow(
        run, "doc_id long, p_text double, p_meta double, score double, accepted boolean")


def _scored(model: CoTrained, batch) -> list[np.ndarray]:
    raw, offsets = binary_views(batch.column("text"))
    lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    parts = [model.score(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lang[i:j], source[i:j])
             for i, j in slices(offsets)]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3)]


def keep_good(docs: DataFrame, labels: DataFrame, model: CoTrained | None = None,
              threshold: float = 0.5, **options) -> DataFrame:
    """The accepted document rows with all their columns."""
    model = model or fit(docs, labels, **options)
    rows = docs.select(*_inputs(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            good = _scored(model, batch)[2] >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("row")], names=["row"]).filter(pa.array(good))

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")
