"""Append-only event logs as streams: each event once, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(events: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once within the watermark: state is dropped as time goes on."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over all that is there, with offsets kept for the next run, and ends."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregating stream over all that is there; each batch's changed rows are written with its number, anew if it is run again."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/{batch:09d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, *by: str) -> DataFrame:
    """The last batch's row of each key: what the aggregate has come to."""
    rest = [c for c in updates.columns if c not in (*by, "batch")]
    last = updates.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return last.select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])
