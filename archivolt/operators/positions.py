"""Exact positions over a whole table: rows are dealt out by ranges of their order, each
range numbers its own, and begins where the counts of those before it end. Only a row for
each range meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored


def _offsets(ranges: DataFrame) -> DataFrame:
    """_part and _off, the rows of the ranges before; a row a range."""
    n = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def ordered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """The rows with their place, from 0, in an order that should tell all rows apart:
    rows of equal order are numbered in any order, by one task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = Stored(df.sparkSession).table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "placed", keep=True)  # the result reads it
    own = Window.partitionBy("_part").orderBy(*order)
    return placed.withColumn("_own", F.row_number().over(own) - 1).join(_offsets(placed), "_part").withColumn(name, F.col("_off") + F.col("_own")).drop("_part", "_own", "_off")


def as_read(df: DataFrame, name: str) -> DataFrame:
    """The rows with their place, from 0, in the order in which they are read: that of the
    parts of the scan, which for one file is the file's."""
    id_ = F.monotonically_increasing_id()
    placed = Stored(df.sparkSession).table(df.withColumn("_id", id_), "read", keep=True)  # the result reads it
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    return placed.join(_offsets(placed), "_part").withColumn(name, F.col("_off") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_off")
