"""Iteration logs as streams: files that runs append are followed, summaries by window are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, ts timestamp, iteration long, value double"


def follow(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Rows of the CSV files (with header) that appear in a folder."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def windowed(log: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(run, from, to, rows, mean, least, last_iteration) for each run and window; rows later than the watermark are left out of closed windows."""
    grouped = log.withWatermark("ts", late).groupBy("run", F.window("ts", width).alias("w"))
    summed = grouped.agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("iteration").alias("last_iteration"))
    return summed.select("run", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "rows", "mean", "least", "last_iteration")
