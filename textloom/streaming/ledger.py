"""A folder of events that is polled, and a sink with a ledger: every event is handled once, whenever a run is stopped.

Spark's offsets say which files a batch has, and say the same when the batch is run again. A batch's rows go to a folder of its own,
anew each time, and then its entry to the ledger; readers take the batches that the ledger names. So a run that stops before the entry
repeats the batch over what it has written, and one that stops after it has nothing left to do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom.sources.manifests import exists, write_text


@dataclass(frozen=True)
class Ledger:
    """Batches under path/rows and their entries under path/entries; the offsets of the stream that fills it stand in path/offsets."""

    spark: SparkSession
    path: str

    def entry(self, batch: int) -> str:
        return f"{self.path}/entries/{batch:09d}.json"

    def put(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch and enters it, unless it has been entered."""
        if exists(self.spark, self.entry(batch)):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{batch:09d}")
        write_text(self.spark, self.entry(batch), json.dumps({"batch": batch}))

    def batches(self) -> list[int]:
        """The numbers of the batches that have been entered: one small file each."""
        if not exists(self.spark, f"{self.path}/entries"):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch long").json(f"{self.path}/entries").collect())

    def rows(self, schema: StructType | str) -> DataFrame:
        """The rows of all batches that have been entered, with the number of their batch."""
        entered = self.batches()
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{9})/[^/]*$", 1).cast("long").alias("batch")
        if not entered:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{b:09d}" for b in entered]).select("*", name)

    def drain(self, stream: DataFrame, then: Callable[[DataFrame, int], None] | None = None) -> None:
        """Takes all that the stream has and ends; the next run goes on from there. then: is called with each batch between its rows and its entry; if it fails, the batch comes again."""

        def one(rows: DataFrame, batch: int) -> None:
            if then is None or exists(self.spark, self.entry(batch)):
                self.put(rows, batch)
                return
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/{batch:09d}")
            then(self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{batch:09d}"), batch)
            write_text(self.spark, self.entry(batch), json.dumps({"batch": batch}))

        stream.writeStream.option("checkpointLocation", f"{self.path}/offsets").foreachBatch(one).trigger(availableNow=True).start().awaitTermination()


def event_files(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.json", files_per_trigger: int = 1000) -> DataFrame:
    """The events of the files of a folder as they come, a line each: event (null where a line is no such record), line, file."""
    lines = spark.readStream.format("text").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("event"), F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def judged(events: DataFrame, supported: Column, step: Column, interval: int) -> DataFrame:
    """events with status: `damaged` for lines without a step, `unsupported` for events that are not to be handled, `due` at every interval-th step, else `passed`. All of them count as seen."""
    status = F.when(step.isNull(), "damaged").when(~F.coalesce(supported, F.lit(False)), "unsupported").when(step % interval == 0, "due").otherwise("passed")
    return events.withColumn("status", status)


def once_in_all(rows: DataFrame, key: str, *rest: str) -> DataFrame:
    """One row of each key over all batches, of the first batch that has it: a key that two files name is handled once."""
    return rows.groupBy(key).agg(F.min(F.struct("batch", *rest)).alias("__first")).select(key, *[F.col(f"__first.{c}").alias(c) for c in ("batch", *rest)])
