import numpy as np

from quarry.operators.knn import knn_exact, knn_lsh


def _frame(spark, mat, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(mat)],
                                 f"{name} long, embedding array<float>")


def test_exact_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    qs = rng.standard_normal((25, 16)).astype(np.float32)
    res = knn_exact(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 7,
                    id_cols=["vec_id"])
    got = {}
    for r in res.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    bn = base / np.linalg.norm(base, axis=1, keepdims=True)
    qn = qs / np.linalg.norm(qs, axis=1, keepdims=True)
    dist = 1 - qn.astype(np.float64) @ bn.astype(np.float64).T
    for q in range(len(qs)):
        exp = list(np.lexsort((np.arange(len(base)), dist[q]))[:7])
        assert [v for _, v in sorted(got[q])] == exp


def test_small_broadcast_bound_splits_blocks(spark):
    from quarry.config import DEFAULT_SETTINGS

    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 8)).astype(np.float32)
    qs = rng.standard_normal((40, 8)).astype(np.float32)
    tiny = DEFAULT_SETTINGS.with_(knn_broadcast_max_bytes=1024)
    a = knn_exact(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5,
                  id_cols=["vec_id"], settings=tiny)
    b = knn_exact(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5,
                  id_cols=["vec_id"])
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_lsh_recall_on_clustered_data(spark):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((10, 16))
    base = np.vstack([c + 0.05 * rng.standard_normal((40, 16)) for c in centers]).astype(np.float32)
    qs = (centers + 0.05 * rng.standard_normal((10, 16))).astype(np.float32)
    exact = knn_exact(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5,
                      id_cols=["vec_id"])
    approx = knn_lsh(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5,
                     id_cols=["vec_id"], bands=6, bits=4, rows_per_group=50)
    e = {(r.query_id, r.vec_id) for r in exact.collect()}
    a = {(r.query_id, r.vec_id) for r in approx.collect()}
    assert len(e & a) / len(e) >= 0.9


def test_two_level_merge_matches_single_level(spark):
    from quarry.config import DEFAULT_SETTINGS

    rng = np.random.default_rng(11)
    base = rng.standard_normal((400, 8)).astype(np.float32)
    qs = rng.standard_normal((12, 8)).astype(np.float32)
    index = _frame(spark, base, "vec_id").repartition(16)
    tree = DEFAULT_SETTINGS.with_(knn_reduce_fanout=1)
    a = knn_exact(index, _frame(spark, qs, "query_id"), 6, id_cols=["vec_id"], settings=tree)
    b = knn_exact(index, _frame(spark, qs, "query_id"), 6, id_cols=["vec_id"])
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_lsh_hot_bucket_salting_keeps_results(spark):
    rng = np.random.default_rng(21)
    centers = rng.standard_normal((4, 16))
    base = np.vstack([c + 0.05 * rng.standard_normal((60, 16)) for c in centers]).astype(np.float32)
    qs = np.vstack([c + 0.05 * rng.standard_normal((15, 16)) for c in centers]).astype(np.float32)
    args = dict(id_cols=["vec_id"], bands=4, bits=3)
    wide = knn_lsh(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5, **args)
    salted = knn_lsh(_frame(spark, base, "vec_id"), _frame(spark, qs, "query_id"), 5,
                     rows_per_group=7, queries_per_group=3, **args)
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    assert sorted(map(key, wide.collect())) == sorted(map(key, salted.collect()))


def test_ties_never_leave_more_than_k_rows(spark):
    """A zero query vector is equally near to every row: the k smallest ids come back, and no more."""
    base = np.random.default_rng(1).standard_normal((500, 8))
    index = _frame(spark, base, "vec_id").repartition(4)
    queries = spark.createDataFrame([(1, [0.0] * 8), (2, [0.0] * 8)], "query_id long, embedding array<float>")
    got = {}
    for r in knn_exact(index, queries, 10, id_cols=["vec_id"]).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(v) for q, v in got.items()} == {1: list(range(10)), 2: list(range(10))}


def test_kernel_keeps_exactly_k_with_ties_at_the_cut():
    from quarry.operators.knn import _top_rows

    dist = np.array([[1.0, 0.5, 1.0, 1.0], [2.0, 2.0, 2.0, 2.0]])
    q, r = _top_rows(dist, 2, lambda: np.array([3, 2, 1, 0]))
    assert list(zip(q.tolist(), r.tolist())) == [(0, 1), (0, 3), (1, 2), (1, 3)]


def test_many_query_tiles_equal_one(spark, monkeypatch):
    from quarry.operators import knn

    rng = np.random.default_rng(8)
    index, queries = _frame(spark, rng.standard_normal((200, 8)), "vec_id"), _frame(spark, rng.standard_normal((90, 8)), "query_id")
    rows = lambda: sorted((r.query_id, r["rank"], r.vec_id) for r in knn.knn_exact(index, queries, 5, id_cols=["vec_id"]).collect())
    want = rows()
    monkeypatch.setattr(knn, "TILE_CELLS", 1)
    assert rows() == want and len(want) == 450


def test_lsh_leaves_out_missing_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(99, None)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = index.withColumnRenamed("vec_id", "query_id")
    got = knn_lsh(index, queries, 3, id_cols=["vec_id"], bands=4, bits=2).collect()
    assert got and not {99} & {x for r in got for x in (r.query_id, r.vec_id)}


def test_lsh_recall_target_on_given_vectors(spark):
    """The registered queries' settings reach recall 0.9 at 10 on the given vectors."""
    from quarry.plans.driver import LSH_BANDS, LSH_BITS

    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = emb.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact = pairs(knn_exact(emb, queries, 10, id_cols=["vec_id"]))
    found = pairs(knn_lsh(emb, queries, 10, id_cols=["vec_id"], bands=LSH_BANDS, bits=LSH_BITS))
    assert len(exact & found) / len(exact) >= 0.9


def test_query_blocks_count_the_best_rows(spark, monkeypatch):
    """A block's bound covers what a task holds: the vectors and the k best rows of its queries."""
    from quarry.config import DEFAULT_SETTINGS
    from quarry.operators import knn

    queries = _frame(spark, np.ones((90, 8)), "query_id").selectExpr("query_id", "embedding AS _emb", "50 AS _k")
    wide = DEFAULT_SETTINGS.with_(knn_broadcast_max_bytes=64 * 1024)  # its vectors alone are 6 KB
    sizes = [t.num_rows for t in knn._query_blocks(queries, "query_id", wide)]
    assert sum(sizes) == 90 and len(sizes) > 1
    assert knn.TASK_BYTES <= 64 << 20


def test_best_rows_stay_bounded_and_equal_a_full_sort():
    """A task keeps k rows per query and what gathered since, and drops rows beyond a full query's k-th."""
    import pyarrow as pa

    from quarry.operators.knn import _Best

    rng = np.random.default_rng(13)
    best, seen = _Best(20, 3, ["id"]), []
    for at in range(0, 4000, 100):
        d = rng.integers(0, 50, (20, 100)).astype(float)  # many ties
        ids = pa.table({"id": np.arange(at, at + 100)[::-1].copy()})
        q, row = (x.ravel() for x in np.indices(d.shape))
        best.add(q, d.ravel(), row, ids)
        seen += zip(q.tolist(), d.ravel().tolist(), ids["id"].to_numpy()[row].tolist())
        assert best.kept + best.gathered <= 20 * 3 + 65536 + d.size
    got = best.fold()
    want = [x for i in range(20) for x in sorted(s for s in seen if s[0] == i)[:3]]
    assert list(zip(*(got[c].to_pylist() for c in ("q", "d", "id")))) == want
    assert _Best(2, 3, ["id"]).fold() is None
