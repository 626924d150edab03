"""Joins, aggregates, windows and reshaping, with the null and tie rules of the
analyses they serve."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.ordered import quantiles


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ordered_rank(values: list[str], column: Column) -> Column:
    """The place of a value in a list; others come after all."""
    return reduce(lambda c, kv: c.when(column == kv[1], kv[0]), enumerate(values), F.when(F.lit(False), 0)).otherwise(len(values))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match each other; the keys are the left side's."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right, cond, how).drop(*(f"_r_{k}" for k in keys))


def override(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``changes`` win where they are not null."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return df.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def lookup(column: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, column), F.lit(default))


def contains_ladder(column: Column, rungs: list[tuple[str, str]], other: str = "Other") -> Column:
    """The label of the first pattern found; null and no match give ``other``."""
    return reduce(lambda c, r: c.when(column.rlike(r[0]), r[1]), rungs, F.when(F.lit(False), other)).otherwise(other)


def stage_funnel(df: DataFrame, stages: list[str], by: str) -> DataFrame:
    """For each stage column and group: rows that have a value, and their sum."""
    long = df.unpivot([by], stages, "stage", "amount")
    return long.groupBy("stage", by).agg(F.count("amount").alias("n"), F.sum("amount").alias("total"))


def pivot_total(df: DataFrame, index: str, column: str, values: list[str], value: str, total: str = "total") -> DataFrame:
    """Wide with a fixed set of columns, absent cells 0, and their sum."""
    wide = df.groupBy(index).pivot(column, values).agg(F.sum(value)).na.fill(0, values)
    return wide.withColumn(total, reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values]))


def relabel_small(df: DataFrame, label: str, least: int, other: str = "other") -> DataFrame:
    """Counts of labels, those under ``least`` added up as ``other``, and percentages."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    merged = n.groupBy(F.when(F.col("n") < least, other).otherwise(F.col(label)).alias(label)).agg(F.sum("n").alias("n"))
    return merged.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).withColumn("pct", F.round(100 * F.col("n") / F.col("_all"), 4)).drop("_all")


def crosstab(df: DataFrame, a: str, b: str, margin: str = "All") -> DataFrame:
    made = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return made.select(F.when(F.col("_a") == 1, margin).otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, margin).otherwise(F.col(b)).alias(b), "n")


def outer_all(frames: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def top_or_other(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """The column with all but its n most frequent values (ties by value) merged."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)
    kept = top.select(F.col(column).alias("_top"))
    return df.join(F.broadcast(kept), F.col(column) == F.col("_top"), "left").withColumn(column, F.coalesce("_top", F.lit(other))).drop("_top")


def average_rank(df: DataFrame, value: str, by: list[str], rank: str = "rank") -> DataFrame:
    """Ranks within groups, ties sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return df.withColumn(rank, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, of equals the least."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, by, [F.desc("n"), F.asc(value)], 1).drop("rank")


def left_chain(first: DataFrame, levels: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Left joins of one level after the other: (name, table, key). A level's columns that
    are there already get its name behind theirs; absent levels give nulls."""
    out = first
    for name, table, key in levels:
        clash = {c: f"{c}_{name}" for c in table.columns if c != key and c in out.columns}
        out = out.join(table.withColumnsRenamed(clash), key, "left")
    return out


def merged(frames: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """All rows, of equal keys that of the first table that has it, and there the first by
    ``order``."""
    every = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_at", F.lit(k)) for k, f in enumerate(frames)])
    return keep_first(every, key, [F.col("_at"), *order]).drop("_at")


def edges(df: DataFrame, value: str, rule: str, n: int = 10) -> list[float]:
    """Edges of bins: "even" (n of one width), "freedman" (of one width, by the range
    between the quartiles and the number of rows), "quantile" (n of about as many rows
    each) or "values" (the different values, n at most, else an error). One row comes to
    the driver."""
    v = F.col(value)
    if rule == "values":
        found = [r[0] for r in df.where(v.isNotNull()).select(value).distinct().limit(n + 1).collect()]
        if len(found) > n:
            raise ValueError(f"more than {n} different values")
        return sorted(map(float, found))
    if rule == "quantile":
        q = quantiles(df, [], value, {f"q{k}": k / n for k in range(n + 1)}).first()
        return sorted({float(x) for x in q}) if q and q[0] is not None else []
    one = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")).first()
    if not one["n"]:
        return []
    low, high = float(one["low"]), float(one["high"])
    if rule == "freedman":
        q = quantiles(df, [], value, {"a": 0.25, "b": 0.75}).first()
        width = 2 * (q["b"] - q["a"]) / one["n"] ** (1 / 3)
        n = max(1, math.ceil((high - low) / width)) if width > 0 else 1
    return [*(low + k * (high - low) / n for k in range(n)), high]


def bins(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in right-closed bins (the first also holds its left edge), their share,
    and the share up to each."""
    v = F.col(value)
    inner = F.array(*map(F.lit, map(float, edges[1:-1]))) if len(edges) > 2 else F.array().cast("array<double>")
    place = F.when((v >= edges[0]) & (v <= edges[-1]), 1 + F.size(F.filter(inner, lambda e: v > e)))
    n = df.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, len(edges)).select(F.col("id").cast("int").alias("bin"))
    full = every.join(n, "bin", "left").na.fill(0, ["n"])
    # a row a bin: the window's one partition is of that size
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return full.withColumn("share", F.round(share, 6)).withColumn("cumulative", F.round(F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(Window.partitionBy()), 6))
