"""Quantile sketches that can be stored and merged, a sketch for each gene and batch.

A sketch keeps a bounded number of values (``size`` sets how many), so a table of them is
small however many samples were counted; batches that come later are merged with those
stored before. Up to about ``size`` values a sketch is exact; beyond it, a rank is off by
``rank_error`` of the values with a confidence of 99 %. Merging in any order keeps that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored

#: Values that a sketch keeps on its highest level.
SIZE = 200


def rank_error(size: int = SIZE) -> float:
    """The share of the values by which a rank may be off."""
    return 2.296 / size**0.9021


def digests(m: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """by, sketch, n: of the non-zero values. Nulls, NaNs and zeros don't count; groups of
    nothing else have no row."""
    v = F.col(value).cast("double")
    return m.where(v.isNotNull() & ~F.isnan(v) & (v != 0)).groupBy(*by).agg(F.kll_sketch_agg_double(v, size).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, sketch, n of all given sketches; null ones don't count."""
    return parts.where("sketch is not null").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantile(sketch: Column, share: float) -> Column:
    """The smallest kept value whose rank reaches the share."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def medians(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, median over all given sketches."""
    return merged(parts, by).select(*by, "n", quantile(F.col("sketch"), 0.5).alias("median"))


def ranks(m: DataFrame, found: DataFrame, by: list[str], value: str, estimates: list[str]) -> DataFrame:
    """``found`` with below_ and upto_ of each estimate: the true shares of values under
    it, and of those not over it. ``found`` is written, so that its size is known, and the
    values meet it once."""
    v = F.col(value).cast("double")
    at = Stored(m.sparkSession).table(found.withColumn("_g", F.struct(*by)), "estimates", keep=True)  # a row a group
    rows = m.where(v.isNotNull() & ~F.isnan(v) & (v != 0)).select(F.struct(*by).alias("_g"), v.alias("_v"))
    share = lambda on: F.count_if(on) / F.count(F.lit(1))
    n = rows.join(at.select("_g", *estimates), "_g").groupBy("_g").agg(*(x for c in estimates for x in (share(F.col("_v") < F.col(c)).alias(f"below_{c}"), share(F.col("_v") <= F.col(c)).alias(f"upto_{c}"))))
    return at.join(n, "_g").drop("_g")


def rank_checked(m: DataFrame, found: DataFrame, by: list[str], value: str, share: float, estimate: str) -> DataFrame:
    """``found`` with below and upto: the true shares of values under ``estimate``, and of
    those not over it. A quantile is within the bound e where below - e <= share <= upto + e."""
    return ranks(m, found, by, value, [estimate]).withColumnsRenamed({f"below_{estimate}": "below", f"upto_{estimate}": "upto"})
