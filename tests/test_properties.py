"""Properties from the test strategy: coverage, bounds and density."""
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_text
from quarry.operators.lexical import with_lexical_bonus, with_query_terms
from quarry.operators.symbols import gap_ranges


@settings(max_examples=1, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_gaps_and_spans_partition_the_lines(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f in range(40):
        n = rng.randint(1, 60)
        spans = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(1, n)
            spans.append({"name": "s", "symbol_type": "function", "start_line": a,
                          "end_line": rng.randint(a, n), "text": "x"})
        rows.append((f, n, spans))
    df = spark.createDataFrame(rows, "f int, n int, spans array<struct<name:string, "
                               "symbol_type:string, start_line:int, end_line:int, text:string>>")
    got = {r.f: r.g for r in df.select("f", gap_ranges("spans", F.col("n")).alias("g")).collect()}
    for f, n, spans in rows:
        covered = set()
        for s in spans:
            covered.update(range(s["start_line"], s["end_line"] + 1))
        gap_lines = [x for g in got[f] for x in range(g.a, g.b + 1)]
        assert len(gap_lines) == len(set(gap_lines))          # gaps do not overlap each other
        assert not covered & set(gap_lines)                    # nor any span
        assert covered | set(gap_lines) == set(range(1, n + 1))  # together they cover 1..n


def test_chunks_cover_text_and_index_is_dense(spark):
    rng = random.Random(3)
    texts = []
    for i in range(30):
        words = [rng.choice(["alpha", "beta\n", "\n\n", "def f():", "x" * 40]) for _ in range(rng.randint(1, 900))]
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    pieces = {}
    for r in chunk_text(df, "text", keep=("doc_id",)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        s = text.strip()
        ps = sorted(pieces.get(i, []), key=lambda r: r.piece_index)
        assert [p.piece_index for p in ps] == list(range(len(ps)))
        covered = [False] * len(s)
        for p in ps:
            assert p.end_offset - p.start_offset <= 1600
            for k in range(p.start_offset, p.end_offset):
                covered[k] = True
        # every non-blank character belongs to some piece
        assert all(c or ch.isspace() for c, ch in zip(covered, s))


def test_bonus_bounds(spark):
    rng = random.Random(9)
    vocab = ["auth", "token", "login", "usuario", "senha", "permission", "alpha", "beta", "gamma",
             "autenticacao", "where", "the", "file", "path"]
    queries = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 8))),) for _ in range(30)]
    chunks = [(f"src/{rng.choice(vocab)}/{rng.choice(vocab)}.py", rng.choice(vocab + [None]),
               " ".join(rng.choice(vocab) for _ in range(30))) for _ in range(20)]
    q = spark.createDataFrame(queries, "query string")
    c = spark.createDataFrame(chunks, "file_path string, symbol_name string, content string") \
        .withColumn("path_tokens", F.lit("src py"))
    scores = [r.lexical_score for r in with_lexical_bonus(with_query_terms(q).crossJoin(c)).collect()]
    assert scores and all(0.0 <= s <= 1.05 + 1e-12 for s in scores)


def test_search_ranks_dense_and_within_limit(spark):
    import __spark_entry__ as entry

    df = entry.queries()["search_fallback"](spark, "/root/testdata/sf0.001")
    by_query = {}
    for r in df.collect():
        by_query.setdefault(r.query_id, []).append(r["rank"])
    for qid, ranks in by_query.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        assert len(ranks) <= 3 + qid % 4
