"""Structured Streaming: replayed event files, incremental member indexing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import shared_root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def hourly_counts(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(hour, event_type, n, total): tumbling hours over a file stream, all files that are there now.

    Counts are kept per key in the state store; each trigger writes the table of results anew to the shared folder.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        events = reader.parquet(path)
    else:  # a stream reads folders: this one file of its folder
        events = reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())
    counts = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )
    out, state = shared_path(spark, "hours"), shared_path(spark, "state")

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of a key within the watermark, so that the state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
