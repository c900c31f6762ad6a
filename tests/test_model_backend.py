"""Model backend: batches, order, checks and failures that stay with their rows."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import registry as rg
from quarry.operators.embed import model_column, model_embedding
from quarry.operators.lsh_index import LshParams, read_signatures


def numbers(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 7 == 3, None).otherwise(F.col("id").cast("string")).alias("t"))


def batched(most):
    def factory():
        def model(texts):
            assert 0 < len(texts) <= most and None not in texts
            return [[float(t), float(len(texts))] for t in texts]

        return model

    return factory


def test_fixed_batches_in_order_and_missing_texts(spark):
    rows = model_embedding(numbers(spark, 500).coalesce(1), "t", batched(16), batch_size=16, dim=2).collect()
    given = [r for r in rows if r.t is not None]
    assert all(r.embedding is None for r in rows if r.t is None) and len(rows) == 500
    assert all(r.embedding[0] == r.id for r in given)
    assert [r.embedding[1] for r in given[:416]] == [16.0] * 416


def test_one_model_per_task(spark, tmp_path):
    def factory():
        import uuid
        (tmp_path / uuid.uuid4().hex).touch()
        return lambda texts: [[1.0]] * len(texts)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert len(model_embedding(numbers(spark, 900).repartition(3), "t", factory).collect()) == 900
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 3


@pytest.mark.parametrize("factory, message", [
    (lambda: lambda texts: [[1.0, 2.0]] * len(texts), "2 dimensions instead of 3"),
    (lambda: lambda texts: [[1.0, 2.0, 3.0]] * (len(texts) + 1), "for 10 texts"),
    (lambda: lambda texts: [1.0] * len(texts), "for 10 texts")])
def test_wrong_vectors_are_errors(spark, factory, message):
    with pytest.raises(PythonException, match=message):
        model_embedding(spark.range(10).coalesce(1).selectExpr("string(id) t"), "t", factory, dim=3).collect()


def picky():
    """A model factory that executors get by value: they cannot import this file."""
    def factory():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no " + [t for t in texts if "bad" in t][0][:5])
            return [[float(len(t))] for t in texts]

        return model

    return factory


def test_errors_stay_with_their_rows(spark):
    df = spark.range(100).coalesce(1).select("id", F.when(F.col("id") % 40 == 5, "bad").otherwise("good text").alias("t"))
    rows = df.withColumn("e", model_column(picky(), 16, 1, errors=True)("t")).collect()
    assert {r.id: r.e.error for r in rows if r.e.error} == dict.fromkeys((5, 45, 85), "RuntimeError: no bad")
    assert all((r.e.vector is None) == (r.t == "bad") for r in rows)


def test_a_failing_project_keeps_its_rows_and_the_rest_is_indexed(spark, tmp_path):
    path, signed = str(tmp_path / "index"), str(tmp_path / "signatures")
    registry = rg.upsert_projects(rg.empty_registry(spark), spark.createDataFrame(
        [(p, "/x") for p in "abc"], "name string, project_path string"), "2024-01-01 00:00:00")

    def run(registry, now, **content):
        files = spark.createDataFrame([(p, f"{p}{k}.md", text) for p, texts in content.items() for k, text in enumerate(texts)],
                                      "project string, file_path string, content string")
        return ix.index_projects(files, path, model_column(picky(), dim=1, errors=True), registry, now=now, decoded=True,
                                 signatures=signed, lsh=LshParams(1, 2, 2))

    _, first = run(registry, "2024-01-02 00:00:00", a=["one"], b=["two", "three"])
    summary, second = run(first, "2024-01-03 00:00:00", a=["one", "more"], b=["two", "it is bad", "also bad"])
    got = {r.project: (r.files_indexed, r.status, r.error) for r in summary.collect()}
    assert got["a"] == (2, "ok", None) and got["c"] == (0, "no_chunks", None)
    assert got["b"][:2] == (0, "failed") and got["b"][2].startswith("RuntimeError: no")
    stamps = {r.name: (str(r.last_indexed_at)[:10], r.last_indexed_chunk_count) for r in second.collect()}
    assert stamps["a"] == ("2024-01-03", 2) and stamps["b"] == ("2024-01-02", 2)
    assert {r.project: r["count"] for r in ix.read_index(spark, path).groupBy("project").count().collect()} == {"a": 2, "b": 2}
    assert {r.project: r["count"] for r in read_signatures(spark, signed).rows.groupBy("project").count().collect()} == {"a": 4, "b": 4}
    assert ix.index_totals(summary).first().asDict() == {
        "projects": 3, "projects_indexed": 1, "projects_failed": 1, "files_indexed": 2, "chunks_indexed": 2}
    assert rg.compact_indexed(summary, registry).where("status = 'failed'").first().index_name.startswith("quarry-b")
