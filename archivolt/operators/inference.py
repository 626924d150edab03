"""Enrichment, resampling, thresholds and classifiers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tail(k: pd.Series, term: pd.Series, drawn: pd.Series, every: pd.Series) -> pd.Series:
    g = math.lgamma
    choose = lambda n, r: g(n + 1) - g(r + 1) - g(n - r + 1)

    def one(x, t, d, n):
        return min(1.0, sum(math.exp(choose(t, i) + choose(n - t, d - i) - choose(n, d)) for i in range(x, min(t, d) + 1) if d - i <= n - t))

    return pd.Series([one(*map(int, r)) for r in zip(k, term, drawn, every, strict=True)], dtype=float)


def hypergeometric(k: Column, term: Column, drawn: Column, every: Column) -> Column:
    """The probability of k or more of a term's members among those drawn."""
    return F.pandas_udf(_tail, "double")(k, term, drawn, every)


def adjusted(df: DataFrame, p: str, by: list[str], order: list[str]) -> DataFrame:
    """False-discovery rates: the least p n / rank from the largest p on."""
    up = Window.partitionBy(*by).orderBy(p, *order)
    r = df.withColumn("_r", F.row_number().over(up)).withColumn("_q", F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*by)) / F.col("_r"))
    down = Window.partitionBy(*by).orderBy(F.desc("_r"))
    return r.withColumn("fdr", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_r", "_q")


def otsu(df: DataFrame, by: str, bin: str) -> DataFrame:
    """The bin that parts each group's histogram with the largest variance between the
    parts; of equals the first."""
    n = df.groupBy(by, bin).agg(F.count(F.lit(1)).alias("n"))
    up, whole = Window.partitionBy(by).orderBy(bin), Window.partitionBy(by)
    c = n.select(by, bin, F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col(bin)).over(up).alias("m"), F.sum("n").over(whole).alias("_n"), F.sum(F.col("n") * F.col(bin)).over(whole).alias("_m"))
    gap = (F.col("_m") * F.col("w") - F.col("_n") * F.col("m")).cast("double")
    s = c.where("w < _n").withColumn("_s", gap * gap / (F.col("w").cast("double") * (F.col("_n") - F.col("w"))))
    return s.withColumn("_k", F.row_number().over(whole.orderBy(F.desc("_s"), bin))).where("_k = 1").select(by, F.col(bin).alias("threshold"))


def bootstrap(df: DataFrame, key: str, value: str, flag: str, by: str, rounds: int = 100, level: float = 0.95) -> DataFrame:
    """Percentile interval of the difference of means. Each row counts in each round as
    often as a Poisson number of mean 1, from a hash of key and round, says; so rows are
    added up where they are."""
    u = F.pmod(F.xxhash64(F.col(key), F.col("round")), F.lit(1 << 30)) / float(1 << 30)
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append((k, total))
        p /= k + 1
    times = F.coalesce(*(F.when(u < t, k) for k, t in steps), F.lit(8))
    r = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", times)
    mean = lambda on: F.sum(F.when(on, F.col("_w") * F.col(value))) / F.sum(F.when(on, F.col("_w")))
    each = r.groupBy(by, "round").agg((mean(F.col(flag)) - mean(~F.col(flag))).alias("d"))
    return each.groupBy(by).agg(F.avg("d").alias("mean"), F.percentile("d", (1 - level) / 2).alias("low"), F.percentile("d", (1 + level) / 2).alias("high"))


def split(df: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """``train``: the first ``share`` of each class by a hash of the key."""
    w = Window.partitionBy(label)
    order = w.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("train", F.row_number().over(order) <= F.floor(F.count(F.lit(1)).over(w) * share))


def linear_svm(df: DataFrame, vector: str, label: Column, rounds: int = 20, several: bool = False) -> DataFrame:
    """y, prediction, n of the rows not in ``train``; classes weigh the same. ``several``
    classes (0, 1, ...) are each set against the others."""
    rows = df.select(array_to_vector(vector).alias("raw"), label.cast("double").alias("y"), "train")
    n = rows.where("train").groupBy("y").count()
    weights = F.broadcast(n.select("y", (1.0 / F.col("count")).alias("weight")))
    train = rows.where("train").join(weights, "y")
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    machine = LinearSVC(featuresCol="x", labelCol="y", weightCol="weight", maxIter=rounds)
    if several:
        machine = OneVsRest(classifier=machine, featuresCol="x", labelCol="y", weightCol="weight")
    held = machine.fit(scaler.transform(train)).transform(scaler.transform(rows.where("not train")))
    return held.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))
