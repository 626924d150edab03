"""Reshaping and summaries of annotation and count tables: renamed and collapsed
columns, missing and non-finite values, grids, cross references, group reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed(m: DataFrame, names: DataFrame, column: str, new: str, by: list[str], value: str) -> DataFrame:
    """Columns of a long matrix under new names, unmapped ones under their own; values
    that come under one name are added. ``names`` has one row a column."""
    named = m.join(names.select(column, new), column, "left")
    return named.groupBy(*by, F.coalesce(F.col(new), F.col(column).cast("string")).alias(column)).agg(F.sum(value).alias(value))


def aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows, with the columns of any; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filled(df: DataFrame, value: str, by: list[str], how: str) -> DataFrame:
    """Missing values dropped, set to zero, or to their group's mean."""
    if how == "drop":
        return df.where(F.col(value).isNotNull())
    if how == "zero":
        return df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return df.join(means, by, "left").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def finite(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Infinite values become their group's largest finite value, other missing ones its
    median; a group without finite values becomes zeros."""
    v = F.col(value)
    endless = v.isin(float("inf"), float("-inf"))
    good = F.when(~endless & ~F.isnan(v), v)
    s = df.groupBy(*by).agg(F.max(good).alias("_max"), F.median(good).alias("_median"))
    new = F.when(endless, F.col("_max")).when(v.isNull() | F.isnan(v), F.col("_median")).otherwise(v)
    return df.join(s, by, "left").withColumn(value, F.coalesce(new, F.lit(0.0))).drop("_max", "_median")


def variable(m: DataFrame, column: str, row: str, value: str, n: int, least: float = 0.0) -> DataFrame:
    """The n columns of largest variance over all rows, absent cells zero; of equals the
    first. Columns of variance ``least`` or less are left out."""
    rows = F.broadcast(m.agg(F.countDistinct(row).alias("_n")))  # one row
    s = m.groupBy(column).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).join(rows)
    v = s.select(column, F.round((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.col("_n"), 6).alias("variance"))
    return v.where(F.col("variance") > least).orderBy(F.desc("variance"), column).limit(n)


def one_hot(df: DataFrame, key: str, label: str, levels: list[str]) -> DataFrame:
    """An integer column for each level: 1 where the label is that level."""
    return df.select(key, *(F.coalesce((F.col(label) == x).cast("int"), F.lit(0)).alias(x.lower()) for x in levels))


def quality(m: DataFrame, row: str, value: str, marked: Column, total: tuple[float, float], columns: int, share: float) -> DataFrame:
    """Rows by their total, number of columns and percentage in marked columns."""
    s = m.groupBy(row).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("columns"), F.coalesce(F.sum(F.when(marked, F.col(value))), F.lit(0.0)).alias("_m"))
    s = s.withColumn("pct_marked", F.round(100 * F.col("_m") / F.col("total"), 6)).drop("_m")
    return s.where((F.col("total") > total[0]) & (F.col("total") < total[1]) & (F.col("columns") > columns) & (F.col("pct_marked") < share))


def share_text(df: DataFrame, index: str, column: str, values: list[str], value: str) -> DataFrame:
    """Wide with a fixed set of columns: the share of the row's sum in whole per cent,
    truncated, as text; blank where there is nothing."""
    wide = df.groupBy(index).pivot(column, values).agg(F.sum(value)).na.fill(0, values)
    total = reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    cell = lambda c: F.when(c == 0, "").otherwise(F.concat(F.floor(100 * c / total).cast("string"), F.lit("%")))
    return wide.select(index, *(cell(F.col(f"`{v}`")).alias(v) for v in values), total.alias("total"))


def mean_error(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error of each group; a single value has an error of 0."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).when(n == 1, 0.0).alias("sem"))


def capped(df: DataFrame, by: str, key: str, least: int, most: int) -> DataFrame:
    """Of groups with ``least`` rows or more, ``most`` rows each, drawn by a hash of the
    key: a sample by intent."""
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(by)
    order = [F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]
    w = Window.partitionBy(by).orderBy(*order)
    return df.join(large, by, "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def member_summary(means: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Mean and deviation (null for a single member) of the members' means, and the
    members. The table has a row a member."""
    return means.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.array_join(F.array_sort(F.collect_list(member)), ";").alias("members"))


def shares(df: DataFrame, group: str, label: str) -> DataFrame:
    """Count of each label, its share of the group, and the share up to it from the most
    frequent on."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    down = w.orderBy(F.desc("n"), label).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("n").over(w)
    return n.select(group, label, "n", (F.col("n") / whole).alias("share"), (F.sum("n").over(down) / whole).alias("cumulative"))


def grid(ids: DataFrame, levels: list[str], level: str, found: DataFrame, value: str) -> DataFrame:
    """Every id with every level of a fixed list; cells that aren't found are 0."""
    cells = ids.withColumn(level, F.explode(F.array(*map(F.lit, levels))))
    return cells.join(found, [*ids.columns, level], "left").na.fill(0, [value])


def in_all(df: DataFrame, key: str, group: str, groups: int) -> DataFrame:
    """Keys that are in each of the groups."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("_n")).where(F.col("_n") == groups).select(key)


def cross_reference(df: DataFrame, known: DataFrame, key: str, name: str, wanted: Column) -> DataFrame:
    """Beside each row the different names known for its key, in order and joined by
    "; " ("" if none), and whether any is the wanted one."""
    lists = known.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), "; ").alias("names"), F.bool_or(wanted).alias("matched"))
    return df.join(lists, key, "left").withColumns({"names": F.coalesce("names", F.lit("")), "matched": F.coalesce("matched", F.lit(False))})


def scrambled(m: DataFrame, column: str, row: str, value: str) -> DataFrame:
    """A control: each column's values dealt to its rows in the order of a hash."""
    w = Window.partitionBy(column)
    mixed = F.md5(F.concat_ws(":", F.col(column).cast("string"), F.col(row).cast("string")).cast("binary"))
    at = m.select(column, row, F.row_number().over(w.orderBy(row)).alias("_k"))
    dealt = m.select(column, value, F.row_number().over(w.orderBy(mixed, row)).alias("_k"))
    return at.join(dealt, [column, "_k"]).select(row, column, value)


def outcomes(df: DataFrame, by: list[str], said: Column, true: Column) -> DataFrame:
    """tp, tn, fp, fn and accuracy of each group."""
    n = lambda c: F.count_if(c)
    s = df.groupBy(*by).agg(n(said & true).alias("tp"), n(~said & ~true).alias("tn"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"))
    return s.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def exceeding(df: DataFrame, fences: DataFrame, by: list[str], entity: str, value: str) -> DataFrame:
    """Entities of which any value reaches its group's fences (``lower``, ``upper``) or
    lies beyond."""
    out = df.join(fences, by).where((F.col(value) <= F.col("lower")) | (F.col(value) >= F.col("upper")))
    return out.groupBy(entity).agg(F.count(F.lit(1)).alias("n_outside"))


def accepted_accuracy(df: DataFrame, by: list[str], truth: str, said: str, accepted: dict[str, list[str]]) -> DataFrame:
    """by, n, unsaid, right, accuracy of answers of which a truth accepts several; rows whose
    truth isn't listed are left out, a null answer is wrong."""
    pairs = F.create_map(*(x for t, labels in accepted.items() for x in (F.lit(t), F.array(*map(F.lit, labels)))))
    known = df.where(F.col(truth).isin(list(accepted)))
    right = F.coalesce(F.array_contains(pairs[F.col(truth)], F.col(said)), F.lit(False))
    n = F.count(F.lit(1))
    return known.groupBy(*by).agg(n.alias("n"), F.count_if(F.col(said).isNull()).alias("unsaid"), F.count_if(right).alias("right"), (F.count_if(right) / n).alias("accuracy"))
