"""Ensemble statistics over a stream of realizations: an extension, the batch operator on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from braidflow.operators.ensemble import vector_stats


def running_stats(stream: DataFrame, keys: list[str], **options) -> DataFrame:
    """Statistics of each cell so far; the state is a row of sums for each cell."""
    return vector_stats(stream, keys, **options)


def write_running_stats(stats: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each batch's changed cells as Parquet under its number, so that a batch that runs again replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
