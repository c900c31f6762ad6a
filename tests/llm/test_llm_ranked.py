"""Ranked search against scoring every document, and the bounds that allow to leave documents out."""

import math
import random
from collections import Counter

import brute
import numpy as np
from quarry.llm import ranked_search as R


def every_score(rows, items):
    docs = [(d, Counter(brute.words(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = set()
    for item_id, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(brute.words(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out |= {(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:10])}
    return out


def frames(spark, rows, items):
    return (spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4),
            spark.createDataFrame(items, "item_id long, text string"))


def test_equals_scoring_every_document(spark):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.7)) % 700 + 1)), 0) for k in range(400)]
    rows += [(1000 + k, rows[7][1], 0) for k in range(30)] + [(None, rows[7][1], 1), (5, "w1 w2", 1), (5, "w1 W2!", 1)]
    rows += [(2000, None, 0), (2001, "", 0), (2002, "...", 0), (2003, "w1 " * 50_000, 0)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40])))) for k in range(40)]
    items += [(100, rows[7][1]), (101, None), (102, ""), (103, "unseen"), (104, "w1 w1 W1"), (None, "w2")]
    docs, asked = frames(spark, rows, items)
    want = every_score([r[:2] for r in rows], items)
    assert {tuple(r) for r in R.ranked_search(docs, asked).collect()} == want
    index = R.build_index(docs)
    small = R.search(index, docs, asked, item_terms=60)  # several blocks of items
    assert {tuple(r) for r in small.collect()} == want


def test_bounds_never_fall_below_scores_and_exclude_most(spark, documents):
    index = R.build_index(documents)
    texts = {r.text for r in documents.collect()}
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(10).collect()]
    df = {r.term: r.df for r in index.dictionary.collect()}
    known = [[(t, df[t]) for t in sorted(set(R.terms_of(i))) if t in df] for i in items]
    block = R._block(list(range(len(items))), known, index)
    bounds = Counter()
    for b in index.blocks.collect():
        part = R._bounds(block, (index.documents, index.terms), b.rows, b.bits, b.tiers, b.lengths, b.slices)
        for i, d in np.argwhere(part >= 0):
            bounds[i, b["keys"][d]] = max(bounds[i, b["keys"][d]], int(part[i, d]))
    from pyspark.sql import functions as F
    key = {r.text: r.k for r in documents.select("text", F.xxhash64("text").alias("k")).collect()}
    reach = total = 0
    for i, terms in enumerate(known):
        scores = []
        for text in texts:
            tf = Counter(R.terms_of(text))
            m = R.length_part(sum(tf.values()), index.documents, index.terms) if tf else 0
            s = sum(R.weight(index.documents, n) * R.term_score(tf[t], m) for t, n in terms if tf[t])
            assert s <= bounds[i, key[text]]
            scores.append(s)
        least = sorted(scores)[-10]
        reach += sum(bounds[i, key[t]] >= least for t in texts)
        total += len(texts)
    assert reach < 0.2 * total, (reach, total)


def test_empty_tables(spark):
    docs, items = frames(spark, [], [(1, "a")])
    assert R.ranked_search(docs, items).count() == 0
    docs, items = frames(spark, [(1, "a", 0)], [])
    out = R.ranked_search(docs, items)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
