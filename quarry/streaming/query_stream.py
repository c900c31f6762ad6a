"""Answer a stream of queries against the index with Structured Streaming.

The reference answers one query at a time as it arrives; here arriving query rows form a stream
and every micro-batch is answered by the batch ``search`` plan (``foreachBatch``). The index is
re-read per batch, so a project refreshed in between is seen by the next batch. Results and
summaries are written per epoch with dynamic partition overwrite, so a batch replayed after a
failure replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import DEFAULT_SETTINGS, Settings
from quarry.operators.index import read_index
from quarry.operators.search import search
from quarry.session import scratch_path


def _write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    (df.withColumn("epoch", F.lit(epoch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("epoch").parquet(path))


def answer_query_stream(queries: DataFrame, index_path: str, out_path: str,
                        checkpoint: str | None = None, settings: Settings = DEFAULT_SETTINGS,
                        registry: DataFrame | None = None, trigger: dict | None = None
                        ) -> StreamingQuery:
    """Start the stream; results go to ``out_path/results``, summaries to ``out_path/summary``.

    Pass a stable ``checkpoint`` (under the cluster's shared folder) to resume after a restart;
    without one a fresh folder is used, so two streams never share a checkpoint.
    """
    spark = queries.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "query-stream-checkpoint")

    def answer(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        results, summary = search(read_index(spark, index_path), batch, settings, registry)
        _write_epoch(results, f"{out_path}/results", epoch_id)
        _write_epoch(summary, f"{out_path}/summary", epoch_id)

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
