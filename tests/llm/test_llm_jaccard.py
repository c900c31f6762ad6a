import random

import brute
import pytest
from quarry.llm.jaccard_join import jaccard_classes, keep_one, runs_for, survival


@pytest.fixture(scope="module")
def rows(documents):
    rng = random.Random(5)
    out = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    base = out[20][1].split()[:150]
    for i in range(60):  # a group of near copies, most of them different texts
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["foo", "bar", "baz"])
        out.append((100_000 + i, " ".join(w)))
    return out + [(200_000, None), (200_001, ""), (200_002, "a b"), (200_003, "A b."), (200_004, "a b"),
                  (200_004, "a b"), (None, "a b"), (200_005, "... !")]


@pytest.mark.parametrize("limits", [{}, {"limit": 8, "set_limit": 4}])
def test_equals_brute_force(spark, rows, limits):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df, **limits).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    # texts without words are classes of their own
    want = [(d, c, n) for d, c, n in brute.jaccard(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_keep_one_row_of_each_group_with_all_columns(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long, "s"), (1, long + " x", "s"), (2, long, None), (1, long + " x", "s"), (7, "other words", "t"),
            (8, None, "t"), (9, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]
    assert keep_one(docs.limit(0)).count() == 0


def test_runs_reach_the_recall_target():
    for depth in (1, 2, 3):
        runs = runs_for(0.8, 0.999, depth)
        assert 1 - (1 - survival(0.8, depth)) ** runs >= 0.999
