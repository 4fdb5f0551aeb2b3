"""Incremental scoring of items as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_items(spark: SparkSession, path: str, schema: str, key: str = "image_id", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A file stream of JSON lines in which each key passes once. With an event time, keys are forgotten after ``delay``, so the state stays bounded."""
    stream = spark.readStream.schema(schema).json(path)
    stream = stream.where(F.col(key).isNotNull())
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def score_once(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Scores each batch and writes it under its number, ``batch=n``: a batch that is replayed after a failure replaces itself, so nothing is there twice
    and no batch reads what others wrote. Keys pass once by ``new_items``."""

    def batch(df: DataFrame, n: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
