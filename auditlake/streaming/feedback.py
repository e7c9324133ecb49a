"""Streams of feedback and events: append log, keys once, and views kept by each batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans.store import shared_dir


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", at_once: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``at_once`` of them a batch."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", str(at_once)).parquet(folder)


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that late rows may take; state is dropped beyond it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window and the columns ``by``."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")


def run_to_table(stream: DataFrame, mode: str, label: str, run: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote so far.

    ``append`` adds new rows; ``complete`` keeps a table for each batch's whole result, of which the last counts. Tables
    and checkpoint lie in the shared folder under ``run``; with the same name the stream goes on where it stopped and
    meets only new files. Without a name the run stands alone.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/auditlake/{label}-{run or uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(schema).parquet(f"{root}/out")

    def replace(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own table only
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(folder)) if fs.exists(folder) else []
    if not numbers:
        return spark.createDataFrame([], schema)
    for number in numbers[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/out/batch={number}"), True)
    return spark.read.schema(schema).parquet(f"{root}/out/batch={numbers[-1]}")


def latest(df: DataFrame, time: str, most: int = 30) -> DataFrame:
    """The most recent rows, newest first."""
    return df.orderBy(F.desc(time)).limit(most)
