"""Streams of trace rows: an extension, as the analyses are batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def first_of_each(stream: DataFrame, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; what is kept to tell goes with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, kind: str, value: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and sum of each kind in tumbling windows."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), kind)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
