"""The embedding cache across runs: only texts that no run has seen reach the model."""

import pytest
from pyspark.errors import PythonException

from quarry.operators.embed import embed_cached, model_column, read_cache


def asked(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, q string")


def counting(spark, refuse="\0"):
    """A model and the accumulator of the texts it was given."""
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def model(texts):
            if any(refuse in t for t in texts):
                raise ValueError("refused")
            seen.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return model_column(factory, 8, 2), seen


def test_a_second_run_embeds_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    embed, seen = counting(spark)
    texts = [f"text {k % 40}" for k in range(400)] + [" text  3 ", None, "", "  "]
    first, added = embed_cached(asked(spark, texts), "q", embed, path)
    rows = {r.id: r.embedding for r in first.collect()}
    assert added == 41 and seen.value == 41  # the empty key is a text like any other
    assert len(rows) == 404 and rows[401] is None and rows[400] == rows[3] and rows[12] == [7.0, 1.0]
    second, added = embed_cached(asked(spark, texts), "q", embed, path)
    assert added == 0 and seen.value == 41
    assert {r.id: r.embedding for r in second.collect()} == rows
    third, added = embed_cached(asked(spark, ["text 1", "new"]), "q", embed, path, max_broadcast_bytes=0)
    assert added == 1 and seen.value == 42 and third.count() == 2


def test_a_failing_run_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    embed, _ = counting(spark, refuse="bad")
    embed_cached(asked(spark, ["a", "b"]), "q", embed, path)
    with pytest.raises(PythonException, match="refused"):
        embed_cached(asked(spark, ["c", "bad", *map(str, range(50))]), "q", embed, path)
    assert sorted(r.key for r in read_cache(spark, path).collect()) == ["a", "b"]


def test_keys_added_twice_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "cache")
    embed, seen = counting(spark)
    none, added = embed_cached(asked(spark, []), "q", embed, path)
    assert added == 0 and none.count() == 0 and none.columns == ["id", "q", "embedding"]
    embed_cached(asked(spark, ["a"]), "q", embed, path)
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(path)  # another run at the same time
    got, added = embed_cached(asked(spark, ["a", "a"]), "q", embed, path)
    assert added == 0 and got.count() == 2 and read_cache(spark, path).count() == 1
