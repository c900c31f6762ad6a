import numpy as np
from quarry.llm.permutation_index import nearest
from quarry.llm.queries import q_op1


def exact(ids, x, q, k=20):
    score = x @ x[q]
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], -score[keep]))[:k]
    return ids[keep][order], score[keep][order]


def test_recall_and_exact_scores(spark):
    """Unclustered 64-dimensional vectors over several shards: recall at least 0.9."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) * rng.uniform(0.5, 2, (3000, 1))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), shard_rows=1500, query_block=40).toPandas()
    found = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        want, _ = exact(ids, x, q)
        found += len(set(want) & set(own.vec_id))
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own.score, x[own.vec_id] @ x[q], rtol=1e-12)
        assert list(own.vec_id) == [i for _, i in sorted(zip(-own.score, own.vec_id))]
    assert found / (150 * 20) >= 0.9


def test_query_on_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = q_op1(spark, sf_dir).toPandas()
    hit = sum(len(set(exact(ids, x, int(np.searchsorted(ids, q)))[0]) & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert hit / len(got) >= 0.9 and got.query_id.nunique() == (ids % 20 == 0).sum()


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0]), (9, []), (10, [float("inf"), 1.0]), (20, [1.0, 1.0]), (40, [1.0])]
    rows += [(100 + i, [-1.0, 0.0]) for i in range(60)]  # more copies than a result can show
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[1][:3] == [(2, 2.0), (3, 1.0), (20, 1.0)] and len(got[1]) == 20
    assert got[130][:20] == [(100 + i, 1.0) for i in range(20)]
    assert got[100] == [(101 + i, 1.0) for i in range(20)]
    assert got[8] == [(40, 1.0)] and got[40] == [(8, 1.0)]
    assert not {4, 5, 6, 7, 9, 10} & set(got)
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_query_blocks_are_not_broadcast_once_per_shard(spark):
    """Every block meets every shard, whose number no size estimate knows: a broadcast would hold all pairs in the driver."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = nearest(df, df, k=5, shard_rows=40, query_block=25)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = plan[plan.index("MapInArrow"):]
    assert "CartesianProduct" in sent and "Broadcast" not in sent.split("CartesianProduct")[0]
    assert "files" not in "".join(part.split("\n")[0] for part in plan.split("BroadcastExchange")[1:])
    for q, own in got.groupby("query_id"):  # shards of at most 512 vectors are searched whole
        want, score = exact(np.arange(400), x, q, 5)
        own = own.sort_values("rank")
        assert list(own.vec_id) == list(want) and np.allclose(own.score, score)
