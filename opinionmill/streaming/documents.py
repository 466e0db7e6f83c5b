"""Streams of reviews. The row operators are stateless and run on a stream unchanged; scores
that aggregate per document run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opinionmill.operators.cleaning import drop_incomplete, with_review
from opinionmill.sources.reviews import REVIEW_SCHEMA


def read_review_stream(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA, file_format: str = "csv") -> DataFrame:
    """New review files in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        reader = reader.options(header=False, quote='"', escape='"')
    return reader.load(path)


def clean_stream(stream: DataFrame) -> DataFrame:
    return with_review(drop_incomplete(stream))


def score_stream(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    path: str,
    progress: str,
    once: bool = True,
) -> StreamingQuery:
    """Score each micro-batch and write it below ``path/batch=<id>``; a batch replayed after a
    failure overwrites its own folder, so every review is scored exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
