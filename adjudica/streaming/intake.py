"""A drop folder as a stream: the batch stages, which are all narrow, on each new file; and audit events without
repeats."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from adjudica.plans.pipeline import process_text
from adjudica.sources.files import decode_plain, describe, route


def drop_folder(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return route(describe(files)).withColumn("raw_text", decode_plain(F.col("content"))).drop("content")


def processed(files: DataFrame, as_of: date) -> DataFrame:
    return process_text(files, as_of)


def start(files: DataFrame, as_of: date, out: str, checkpoint: str):
    """Appends every processed claim to a table; each micro-batch is committed whole."""
    writer = processed(files, as_of).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def once(events: DataFrame, at: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Each event hash once within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_hash"])


def per_window(events: DataFrame, at: str = "timestamp", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.window(at, width), "event").agg(F.count("*").alias("n"))
