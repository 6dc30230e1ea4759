"""Requests that arrive as files: the batch functions on a stream.

Scoring keeps no state, so no watermark is needed; the checkpoint records which files
were read and the file sink commits each batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ridecast.plans.scoring import score
from ridecast.sources.files import stream_requests


def run_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    files_per_trigger: int = 1000,
    continuous: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Apply a stateless transformation to arriving requests and write Parquet.

    By default the query handles what has arrived and stops; `continuous` keeps it
    running.
    """
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    return (
        transform(stream_requests(spark, source, files_per_trigger))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(sink)
    )


def score_stream(
    spark: SparkSession, model: PipelineModel, source: str, sink: str, checkpoint: str, **options
) -> StreamingQuery:
    """Score arriving requests; the result equals `score` on the same rows as a batch."""
    return run_stream(spark, source, sink, checkpoint, lambda raw: score(raw, model), **options)
