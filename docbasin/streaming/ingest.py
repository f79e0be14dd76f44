"""Structured Streaming: chunks of arriving documents, and usage by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.operators.content import chunk


def documents(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def usage_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Turns and sums by window of event time; rows later than the watermark are left out once a window is closed."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("turns"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "turns", "total")


def ingest(stream: DataFrame, target: str, checkpoint: str, size: int = 600, overlap: int = 100):
    """Chunks of each micro-batch go to a folder named by the batch, so a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch, size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
