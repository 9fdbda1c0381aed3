"""The event log as a stream: ingest, windowed counts with late data, and an idempotent upsert per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; a stream drops what is later than the watermark."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    out = events.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), kind, "n")


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_batches(events: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """merge(batch, id) for each batch; it is called again with the same id after a failure and must then change nothing."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
