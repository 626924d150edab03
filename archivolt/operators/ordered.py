"""Running sums and quantiles of groups of any size, over their different values.

Rows of equal value are counted first, where they are; the counted table is written into
the shared folder once, and all that follows reads it. Groups of up to ``MOST`` different
values are ordered as they are. Larger ones are parted at quantiles of their own values,
as many parts as their size asks for: sums within a part, and the sums of the parts before.
No task holds a group of more values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored

#: Different values of a group that are ordered by one task.
MOST = 1 << 20


def counted(df: DataFrame, by: list[str], value: str, **counts: Column) -> DataFrame:
    """by, value (not null) and the sums of the given columns, ``n`` the rows if none is."""
    counts = counts or {"n": F.lit(1)}
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*(F.sum(c).cast("long").alias(k) for k, c in counts.items()))


def written(counts: DataFrame) -> DataFrame:
    """The counted table, in the shared folder."""
    return Stored(counts.sparkSession).table(counts, "counted", keep=True, spread=True)  # the result reads it


def running(counts: DataFrame, by: list[str], value: str, sums: list[str], held: DataFrame | None = None) -> DataFrame:
    """``counts`` (a row for each value of a group) with before_, the sum over smaller
    values, and total_, the group's, of each column; and ``next``, the next larger value.
    ``held``: the same, where it is written already."""
    held = written(counts) if held is None else held
    largest, every = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    largest, every = largest or 0, every or 0
    spark, zero = held.sparkSession, F.lit(0)
    # values that a task orders, of several groups or parts: not more than of one, about
    tasks = -(-every // MOST)
    dealt = lambda df, *key: df.repartition(tasks, *key) if key and tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    if largest <= MOST:
        held = dealt(held, *by)
        group = Window.partitionBy(*by)
        up = group.orderBy(value)
        earlier = up.rowsBetween(Window.unboundedPreceding, -1)
        return held.select(*by, value, *sums, *(x for s in sums for x in (F.coalesce(F.sum(s).over(earlier), zero).alias(f"before_{s}"), F.sum(s).over(group).alias(f"total_{s}"))), F.lead(value).over(up).alias("next"))
    parts = -(-largest // MOST)
    # a struct is equal to another also where its fields are null
    key = F.struct(*by, F.lit(0).alias("_")) if by else F.struct(F.lit(0).alias("_"))
    shares = [k / parts for k in range(1, parts)]
    large = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(F.col(value).cast("double"), shares, max(10_000, 20 * parts)).alias("_at")).where(F.col("_n") > MOST).select(key.alias("_of"), F.array_distinct("_at").alias("_at"))
    # written, so that its size is known: few rows are broadcast, and no group meets in a task
    large = Stored(spark).table(large, "parts", keep=True)
    found = held.withColumn("_g", key).join(large, F.col("_g") == F.col("_of"), "left")
    part = F.coalesce(F.size(F.filter("_at", lambda b: F.col(value) > b)), F.lit(0))
    placed = dealt(found.select(*by, value, *sums, F.struct("_g", F.greatest(part, F.lit(0)).alias("_k")).alias("_part")), "_part")
    each = placed.groupBy("_part").agg(*(F.sum(s).alias(f"_{s}") for s in sums), F.min(value).alias("_least"))
    group = Window.partitionBy("_part._g")
    up = group.orderBy("_part._k")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(F.col("_part").alias("_of"), F.lead("_least").over(up).alias("_after"), *(x for s in sums for x in (F.coalesce(F.sum(f"_{s}").over(earlier), zero).alias(f"_off_{s}"), F.sum(f"_{s}").over(group).alias(f"total_{s}"))))
    own = Window.partitionBy("_part").orderBy(value)
    within = placed.withColumns({f"_in_{s}": F.coalesce(F.sum(s).over(own.rowsBetween(Window.unboundedPreceding, -1)), zero) for s in sums} | {"_next": F.lead(value).over(own)})
    both = within.join(offsets, within["_part"] == offsets["_of"])
    return both.select(*by, value, *sums, *(x for s in sums for x in ((F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}"), F.col(f"total_{s}"))), F.coalesce("_next", "_after").alias("next"))


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and the wanted quantiles (name: share), by linear interpolation. Groups without a
    value have no row."""
    return of_counts(written(counted(df, by, value)), by, value, wanted)


def of_counts(held: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``quantiles`` of a written table of counts ``n``."""
    r = running(held, by, value, ["n"], held)
    v, before, n = F.col(value).cast("double"), F.col("before_n"), F.col("n")
    at = lambda k: F.max(F.when((before <= k) & (k < before + n), v))
    out = []
    for name, q in wanted.items():
        place = (F.col("total_n") - 1) * F.lit(float(q))
        out += [at(F.floor(place)).alias(f"_l_{name}"), at(F.ceil(place)).alias(f"_h_{name}"), F.first(place - F.floor(place)).alias(f"_p_{name}")]
    s = r.groupBy(*by).agg(*out)
    return s.select(*by, *((F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * F.col(f"_p_{k}")).alias(k) for k in wanted))


def beside(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their group's columns; null groups match."""
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    key = found.select(F.struct(*by).alias("_found"), *(c for c in found.columns if c not in by))
    return df.withColumn("_row", F.struct(*by)).join(key, F.col("_row") == F.col("_found")).drop("_row", "_found")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, _m and _d: the median, and the median deviation from it. Both are taken from
    counted values, so no rows are dealt out again."""
    return medians_of(written(counted(df, by, value)), by, value)


def medians_of(held: DataFrame, by: list[str], value: str) -> DataFrame:
    """``medians`` of a written table of counts ``n``."""
    m = Stored(held.sparkSession).table(of_counts(held, by, value, {"_m": 0.5}), "medians", keep=True)  # a row a group
    off = beside(held, m, by).select(*by, F.abs(F.col(value) - F.col("_m")).alias("_off"), "n").groupBy(*by, "_off").agg(F.sum("n").alias("n"))
    return beside(m, of_counts(written(off), by, "_off", {"_d": 0.5}), by)
