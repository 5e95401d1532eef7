"""The same work over streams: inventories, scores and dedup, each resumable from its checkpoint. Label folds are in `labels`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """New files as they arrive. Changed and deleted ones are for the batch snapshot_diff."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha1("content").alias("content_hash"))


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateless scoring of each row, as in batch, with the registry broadcast."""
    return score(stream)


def stream_dedup(stream: DataFrame, time: str, delay: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """The first row of each content within the watermark, without the contents that known (content_hash) has.

    The watermark bounds the state; a table of the contents given out before it, read anew in each micro-batch, covers the time before.
    """
    fresh = stream if known is None else stream.join(known.select("content_hash"), "content_hash", "left_anti")
    return fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to Parquet; a later call goes on where this one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
