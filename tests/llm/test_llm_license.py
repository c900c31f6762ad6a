"""Licence scan: base phrases against a plain search, notices with gaps, IDF over all documents."""

import random

import brute
from quarry.llm.license_scan import BASE, NOTICES, Template, document_counts, postings, scan

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction")


def base_places(text):
    w = brute.words(text)
    found = sorted((i, t.label) for t in BASE for p in [t.text.split()] for i in range(len(w)) if w[i:i + len(p)] == p)
    places = [i for i, _ in found]
    return (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))


def base_columns(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_base_phrases_equal_a_plain_search(spark):
    rng = random.Random(8)
    pieces = ["MIT", "License", "license", "apache", "general", "public", "licens\u00e9", "the", "\u212aeep", "a-b", "mit.license",
              "GENERAL public\nLICENSE", "x", "\u0130t"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    texts += ["", None, "mit license " * 20_000, "mit", "license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    for k, t in enumerate(texts):
        assert base_columns(got[k]) == base_places(t), (k, t and t[:80])
        assert set(got[k].base_labels.split(",")) <= set(got[k].labels.split(","))


def test_notices(spark):
    filler = "some other words before it "
    texts = [filler + MIT + " and more", filler + MIT.replace("associated ", "all the associated "),
             MIT.replace("hereby", "never"), "Licensed under CC BY-NC 4.0.", "CC by the way, licensed 4 people under 0 terms",
             "under the GNU General Public License, version 3.", "See the MIT license"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, filler * 3) for k in range(30)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(7)] == ["mit", "mit", "", "cc-by-nc-4.0", "", "gpl,gpl-3.0", "mit"]
    assert got[0].score == 1.0 and got[6].score == 0.5 and got[4].score == 0 and got[100].score == 0
    (match,) = [m for m in got[0].matches if not m.base]
    assert (match.start, match["size"], match.share) == (5, len(brute.words(NOTICES[0].text)), 1.0)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rare_words_come_from_all_documents(spark):
    t = Template("x", "alpha beta gamma", ("alpha",))
    rows = [("alpha beta",)] * 4 + [("Beta",)] * 3 + [("gamma",)] + [(None,), ("",)]
    counts = document_counts(spark.createDataFrame(rows, "text string"), [t])
    assert counts == (10, {"alpha": 4, "beta": 7, "gamma": 1})
    assert [w for w, *_ in postings([t], *counts, rare=2)[0]] == ["gamma", "alpha"]
    assert [q for _, q, _ in postings([t], *counts, rare=2)[0]] == [2, 0]


def test_given_documents_clashing_columns_and_empty_table(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    out = scan(documents.withColumnRenamed("n_chars", "labels").withColumnRenamed("source", "_x"))
    assert out.columns[:4] == ["doc_id", "text", "lang", "_x"]
    rows = out.collect()
    assert len(rows) == len(texts)
    assert all(base_columns(r) == base_places(texts[r.doc_id]) for r in rows)
    assert sum(r.n_base > 0 for r in rows) > 20
    assert scan(documents.limit(0)).count() == 0


def test_plan_is_native(spark, documents):
    plan = scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
