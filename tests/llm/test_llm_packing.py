import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from quarry.llm.packing import Encoder, cut_windows, pack, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(4)
    parts = list("abS s'tremdvl \n\t  .,!?é中12'’ﬀ  x​") + ["'s", "'re", "'ll", " '", " 's", "  ", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    texts += ["", "x" * 3000, "'re'll's", " 's", "  ", "a's's", "''s", "\U0001f600 \U0001f600"]
    ids, at = Encoder(tokenizer_path()).encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_dynamic_program_is_optimal():
    rng = random.Random(7)

    def cost(begin, end, fee, size):
        n = end - begin
        return (0 if n & (n - 1) == 0 else size - n) + fee

    for _ in range(150):
        size = 16
        cuts = [0]
        while len(cuts) < 14:
            cuts.append(cuts[-1] + rng.randrange(1, 9))
        fee = [0.0] + [rng.choice([0.0, 4.0, 7.0]) for _ in cuts[1:]]
        best = {0: 0.0}
        for j, end in enumerate(cuts):
            for i, begin in enumerate(cuts[:j]):
                if end - begin <= size and begin in best:
                    best[end] = min(best.get(end, 1e9), best[begin] + cost(begin, end, fee[j], size))
        got = cut_windows(np.array(cuts), np.array(fee), size, True)
        total = sum(cost(a, b, fee[cuts.index(b)], size) for a, b in zip([0] + got[:-1], got))
        assert got[-1] == cuts[-1] and abs(total - best[cuts[-1]]) < 1e-9


def check(rows, texts, tokenizer, size=2048):
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[d])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / (padding + total)


def test_every_id_once_and_little_padding(spark, documents, tokenizer):
    rows = pack(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert check(rows, texts, tokenizer) < 0.02
    again = pack(documents).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edge_cases(spark, tokenizer):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "no end " * 3000 + "\n", 5: "a.", 6: "<|endoftext|> x"}
    df = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, start int")
    check(pack(df.coalesce(1)).collect(), texts, tokenizer)
    assert pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)
    assert len(pack(twice).collect()) == 2
