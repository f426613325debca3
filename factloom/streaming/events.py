"""Streams of run events, incremental ingest, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampType

# The kinds of events of a run.
EVENT_KINDS = ("started", "stage", "evidence", "answer", "error")


def folder_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each key and window; rows later than ``late`` are dropped by the watermark.  (An extension.)"""
    stamped = events.withColumn(ts, F.col(ts).cast(TimestampType())).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def ingest_changes(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, key: str = "doc_id", digest: str = "content_hash") -> StreamingQuery:
    """Hand every batch's documents, one row per key and content, to ``upsert`` (which must bear repeats) until the folder is read."""

    def each(batch: DataFrame, number: int) -> None:
        upsert(batch.dropDuplicates([key, digest]), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ndjson_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append one JSON line per row to text files."""
    lines = stream.select(F.to_json(F.struct(*stream.columns)).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
