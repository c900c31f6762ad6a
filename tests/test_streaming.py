import tempfile

from quarry.operators import index as ix
from quarry.streaming.query_stream import answer_query_stream


def test_query_stream_answers_each_batch(spark):
    base = tempfile.mkdtemp(prefix="quarry-stream-")
    index_path, q_path, out = f"{base}/index", f"{base}/queries", f"{base}/out"
    rows = spark.createDataFrame(
        [("p", f"f{i}.txt", 0, "txt", f"alpha {i}", "f txt", None, None, 1, 1,
          [1.0, float(i) / 10]) for i in range(8)],
        "project string, file_path string, chunk_index int, language string, content string, "
        "path_tokens string, symbol_name string, symbol_type string, start_line int, "
        "end_line int, embedding array<float>")
    ix.refresh_projects(rows, index_path)
    schema = "query_id long, project string, query string, embedding array<float>"
    spark.createDataFrame([(1, "p", "alpha", [1.0, 0.0]), (2, "p", "beta", [0.0, 1.0])],
                          schema).write.parquet(f"{q_path}/batch1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(q_path)
    q = answer_query_stream(stream, index_path, out, checkpoint=f"{base}/ckpt")
    q.awaitTermination(120)
    summary = {r.query_id: r["count"] for r in spark.read.parquet(f"{out}/summary").collect()}
    assert summary == {1: 5, 2: 5}
    assert spark.read.parquet(f"{out}/results").count() == 10
