"""Incremental scoring: predictions that arrive as files are scored batch by batch, and a stopped run resumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_stream(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Scores the JSON-lines files of `source` that weren't scored yet, appends to `sink` and ends.

    Each batch goes to a folder by its number, written whole, so a batch that runs twice is there once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
