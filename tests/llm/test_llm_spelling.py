"""Spelling variants against all edits of every word."""

import random
import re
import zlib
from collections import Counter

import pytest
from quarry.llm.spelling import _number, drop_letter, spelling_variants, variant_forms

LOWER = {c: c + 32 for c in range(65, 91)}


def contract_word(doc_id, run):
    low = run.translate(LOWER)
    h = zlib.crc32(f"{doc_id}:{low}".encode())
    return low[:h % len(low)] + low[h % len(low) + 1:] if h % 199 == 0 else low


def brute(counts, ratio=5):
    alphabet = sorted(set("".join(counts)))
    near = {}
    for w in counts:
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in ["", *alphabet]}
        near[w] = (edits & counts.keys()) - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_words(rng, letters, count, lengths):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([1, 2, 5, 6, 30, 200, 5000])
            for _ in range(count)}


@pytest.mark.parametrize("letters", ["ab", "aàÿZ", "abcdefgh"])
def test_equals_brute_force(spark, letters):
    words = random_words(random.Random(5), letters, 700, [1, 2, 3, 4, 5, 6, 9])
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert result(variant_forms(df)) == brute(words)


def test_paths_across_range_partitions(spark):
    """Numbers of equal prefixes agree although the sorted words lie in many partitions."""
    words = random_words(random.Random(6), "ab", 400, [8, 9, 10])
    words |= {"a" * 3000: 5, "a" * 2999: 40, "b" + "a" * 2999: 3}
    df = spark.createDataFrame([(w, w) for w in words], "word string, key string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = _number(df)
        rows = numbered.collect()
        full = result(variant_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.id >> 40 for r in rows}) > 3
    node = {}
    for r in rows:
        assert len(r.nodes) == len(r.word)
        for i, x in enumerate(r.nodes):
            assert node.setdefault(x, (i, hash(r.word[:i + 1]))) == (i, hash(r.word[:i + 1]))
    assert len(node) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == sorted(words)
    by = {r[0]: r for r in full}
    assert by["a" * 3000][4] == 2 and by["a" * 3000][1] == "a" * 2999


def test_given_documents(spark, documents):
    counts = Counter(contract_word(r.doc_id, w) for r in documents.collect()
                     for w in re.findall("[A-Za-z\u00C0-\u00FF]+", r.text or ""))
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert len(want) > 5000 and sum(w[1] is not None for w in want) > 100
    assert result(spelling_variants(documents, drop_letter)) == want


def test_nulls_repeats_case_and_other_columns(spark):
    text = "Kitten kitten KITTEN kitten\u00c9 sitten." * 5
    rows = [(1, text, "x"), (1, text, "y"), (None, "kitten " * 40, None), (2, None, ""), (3, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r for r in spelling_variants(df).collect()}
    assert got["kitten"].n == 70 and got["kitten\u00c9"].form == "kitten" and got["sitten"].form == "kitten"
    assert got["kitten"].form is None and got["kitten"].n_near == 2 and got["sitten"].form_n == 70
    assert drop_letter(None, "word") in {"word", "wrd", "wod", "wor", "ord"}


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
