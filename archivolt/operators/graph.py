"""Graphs as edge tables: layers, forced edges, strengths, communities."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder that the cluster names. Without one only local
    mode, as in tests, gets a temporary folder; on a cluster that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("no folder that all machines share: set spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="archivolt-"))
    return df.checkpoint()


def layer(neighbours: DataFrame, name: str, least: float) -> DataFrame:
    """a < b, type, weight of the pairs over a threshold (strictly, by absolute value)."""
    e = neighbours.where(F.abs("similarity") > least).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("similarity").alias("weight"))
    return e.select("a", "b", F.lit(name).alias("type"), "weight")


def forced(neighbours: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with each row's best neighbour added where it isn't there."""
    best = neighbours.where("rank = 1").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col("similarity").alias("weight")).distinct()
    return edges.select("a", "b", "weight").unionByName(best.join(edges, ["a", "b"], "left_anti"))


def strength(edges: DataFrame) -> DataFrame:
    """Degree and summed weight of each node."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def percentile_layer(neighbours: DataFrame, name: str, share: float) -> DataFrame:
    """The pairs whose absolute similarity reaches the given quantile of all pairs', as a
    fraction or, over 1, in per cent."""
    share = share / 100 if share > 1 else share
    e = neighbours.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("similarity").alias("weight"))
    bound = F.broadcast(e.agg(F.percentile(F.abs("weight"), share).alias("_t")))  # one row
    return e.crossJoin(bound).where(F.abs("weight") >= F.col("_t")).select("a", "b", F.lit(name).alias("type"), "weight")


def label_propagation(edges: DataFrame) -> DataFrame:
    """node, community: each round a node takes the label with the largest weight
    among its neighbours and itself, of equals the smallest, until the labels, or
    alternating ones, come again."""
    both = cut(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    now, seen = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), set()
    while True:
        votes = both.join(now, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "community", "weight").unionByName(now.withColumn("weight", F.lit(1e-6)))
        total = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        w = Window.partitionBy("node").orderBy(F.desc(F.round("w", 9)), "community")
        now = cut(total.withColumn("k", F.row_number().over(w)).where("k = 1").select("node", "community"))
        state = tuple(now.agg(F.bit_xor(F.xxhash64("node", "community")), F.sum(F.xxhash64("community", "node").cast("decimal(38,0)"))).first())
        if state in seen:
            return now
        seen.add(state)
