import hashlib
import random

import brute
from quarry.llm.decontaminate import contamination, drop_contaminated
from quarry.llm.queries import q_op4


def _rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in df.collect())


def test_equals_brute_force_with_one_and_many_pattern_blocks(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "é1", "the", "zz9", "x", "foo", "ba"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 13, 14, 20]))))
             for i in range(12)] + [(90, None), (91, "A, b! The"), (92, "a b the")]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 30, 200])))
        docs.append((i, text + ". " + (rng.choice(items)[1] or "").upper() if i % 7 == 0 else text))
    docs += [(500, None), (500, "a b the"), (501, ""), (502, "word " * 60_000 + "zz9 zz9")]
    want = sorted((d, n, h, its, c) for (d, _), (n, h, its, c)
                  in zip(docs, brute.contamination([t for _, t in docs[:-1]] + ["zz9 zz9"], items)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = _rows(contamination(df, bench))
    assert whole == _rows(contamination(df, bench, block_bytes=1))
    assert [r for r in whole if r[0] != 502] == [r for r in want if r[0] != 502]
    assert next(r for r in whole if r[0] == 502)[1] == 60_002


def test_digest_threshold_and_row_filter(spark):
    docs = spark.createDataFrame([(1, "x " * 57 + "a b c", "q"), (2, "x " * 58 + "a b c", "q"), (None, "a b c", None)],
                                 "doc_id long, text string, row string")
    bench = spark.createDataFrame([(10, "a b c"), (9, "B C")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert got[1].contaminated and not got[2].contaminated  # 3 of 60 words; 3 of 61
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).first().n_hit == 0


def test_query_equals_brute_force_on_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        w = brute.words(t)
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    sizes = {len(p) for p in windows}
    got = {r.doc_id: r for r in q_op4(spark, sf_dir).collect()}
    for doc in docs:
        w, hit, found = brute.words(doc.text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[doc.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
