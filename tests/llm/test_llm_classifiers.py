import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import language_mix, quality, toxicity
from quarry.llm.common import crc_mod
from quarry.llm.toxicity import Lexicon, Model, choose_entries, errors_allowed, quoted


@pytest.fixture(scope="module")
def many(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


# ---- quality: co-training

def test_quality_on_held_out_labels(spark, many, labels):
    fold = crc_mod(F.col("doc_id"), 4)
    model = quality.fit(many, labels.where(fold != 2))
    got = quality.score_quality(many, None, model).join(labels.where(fold == 2), "doc_id").toPandas()
    right = got.accepted == (got.quality == 1)
    assert right.mean() >= 0.95 and got.accepted[got.quality == 1].mean() >= 0.97


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "some text", None), (3, "some text", None), (4, "long " * 50_000, "y")],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((r.doc_id, r.score, r.accepted) for r in quality.score_quality(docs, none).collect())
    assert got == [(1, 0.0, False), (2, 0.0, False), (3, 1.0, True), (3, 1.0, True), (4, 1.0, True)]
    one = spark.createDataFrame([(3, 0), (4, None), (3, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.keep_good(docs.limit(0), none).count() == 0


def test_co_training_uses_the_pool():
    """Views that are each informative learn from the other's confident labels."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    a = rng.normal(size=(2000, 5)) + 3.0 * y[:, None] * np.array([1, 0, 0, 0, 0])
    b = rng.normal(size=(2000, 5)) + 3.0 * y[:, None] * np.array([0, 1, 0, 0, 0])
    label = np.where(np.arange(2000) < 20, y, -1)
    model = quality.co_train(a, b, label)
    assert np.mean((model.text.logit(a) > 0) == y) > 0.9 and np.mean((model.meta.logit(b) > 0) == y) > 0.9


# ---- toxicity: automaton, context, model

def test_automaton_accepts_exactly_the_words_within_the_tolerance():
    entries = [("abcab", False), ("bcabcabca", False), ("cab", False), ("acbacba", True), ("bb", True)]
    lexicon = Lexicon(entries)
    rng = random.Random(1)
    words = {"".join(w) for n in range(1, 6) for w in itertools.product("abx", repeat=n)}
    words |= {"".join(rng.choice("abcx") for _ in range(rng.randrange(1, 12))) for _ in range(3000)}
    for e, _ in entries:
        for _ in range(200):
            w = list(e + rng.choice(["", "a", "xx"]))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["", "a", "x", "cb"])
            words.add("".join(w))
    words = sorted(w for w in words if w)
    text = " ".join(words)
    cp = np.array([ord(c) for c in text], np.uint32)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    at, code = lexicon.scan(cp, start, end)
    got = dict(zip(at.tolist(), (code & 3).tolist()))
    for k, w in enumerate(words):
        best = None
        for e, stem in entries:
            most = errors_allowed(e, stem)
            ways = [brute.levenshtein(w[:n], e) for n in range(len(w) + 1)] if stem else [brute.levenshtein(w, e)]
            if min(ways) <= most:
                best = min(ways) if best is None else min(best, min(ways))
        assert got.get(k) == best, (w, got.get(k), best)


def test_context_window_tells_quotation_from_abuse():
    text = 'He is a moron. She wrote "you moron" there. They called moron. A “moron” too.'
    at = [i for i in range(len(text)) if text.startswith("moron", i)]
    assert [quoted(text, i, i + 5) for i in at] == [False, True, True, True]


def test_copies_of_one_toxic_document_add_no_entries():
    rng = random.Random(2)
    bad = ["idiot", "moron", "scum"]
    docs = [{rng.choice(bad)} for _ in range(200)] + [{"idiot", "moron", "junkone", "junktwo"}] * 20
    assert sorted(e for e, _ in choose_entries(docs, 6)) == sorted(bad)


def test_misspelled_terms_and_held_out_labels(spark, many, labels):
    fold = crc_mod(F.col("doc_id"), 4)
    model = toxicity.learn(many, labels.where(fold != 2))
    got = toxicity.score_toxicity(many, model).join(labels.where(fold == 2), "doc_id").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() >= 0.95
    clean = "the and of that tion " * 20
    plain, wrong, right = model.score([clean, clean + "you worthlss loser", clean + "you worthless loser"])
    assert plain < 0.3 and wrong > plain and right >= 0.3


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "a b", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id, r.score, r.predicted) for r in got.collect()) == [(1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0)]
    ones = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, ones.where(crc_mod(F.col("doc_id"), 4) != 2)).collect()} == {1.0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


# ---- language: mixtures

def test_language_on_held_out_documents(spark, documents):
    got = language_mix.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and held.score.between(0, 1).all()


def test_mixture_proportions_and_selected_set(spark, documents):
    model = language_mix.train(documents)
    text = {r.lang: r.t for r in documents.groupBy("lang").agg(F.first("text").alias("t")).collect()}
    half = " ".join(text["en"].split()[:60]) + "\n" + " ".join(text["fr"].split()[:60])
    df = spark.createDataFrame([(1, half), (2, text["de"])], "doc_id long, text string")
    got = {r.doc_id: r.mixture for r in language_mix.identify(df, model).collect()}
    assert set(got[1]) == {"en", "fr"} and abs(got[1]["en"] - 0.5) < 0.2
    assert set(got[2]) == {"de"}


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?!", "en"), (4, "the and", None), (5, "中", "en"), (5, "中", "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_mix.identify(docs, None).collect()}
    assert set(got.values()) == {("und", 0.0)}
    model = language_mix.train(spark.createDataFrame([("en", "the and of"), ("fr", "le la les")], "lang string, text string"))
    got = {r.doc_id: r.lang_pred for r in language_mix.identify(docs, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[4] == "en" and got[5] in ("en", "fr")
    assert language_mix.train(docs.limit(0)) is None
    assert language_mix.language_id(docs.limit(0)).count() == 0
