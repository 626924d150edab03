"""Vectors in an array column: cosine rankings, neighbour graphs, overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; one of no length becomes zeros. The length is bound as a
    variable, or it would be added up again for each component."""
    over = lambda n: F.transform(v, lambda x: F.when(n < 1e-12, 0.0).otherwise(x / n))
    return F.transform(F.array(F.sqrt(dot(v, v))), over)[0]


def units(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), unit(doubles(F.col(vector))).alias("v"))


def query_vector(u: DataFrame, ids: list[int]) -> DataFrame:
    """The sum of some rows' unit vectors, itself of unit length; one row."""
    parts = u.where(F.col("id").isin(ids)).select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("x"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(unit(F.transform("p", lambda p: p["x"])).alias("q"))


def ranked(u: DataFrame, query: DataFrame) -> DataFrame:
    """id, similarity, with the one-row query beside each vector."""
    return u.crossJoin(F.broadcast(query)).select("id", F.round(dot(F.col("v"), F.col("q")), 6).alias("similarity"))


#: Components that a task holds of the queries, and of the other rows; rows of either in
#: one matrix product.
HELD, QUERIES, BLOCK = 1 << 22, 256, 4096


def nearest(q: np.ndarray, qs: np.ndarray, x: np.ndarray, us: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, others and similarities of each query's best k rows. A block is compared
    with the k-th similarity so far; only what reaches it is rounded and ordered."""
    out = []
    order = np.argsort(x, kind="stable")
    x, us = x[order], us[order]
    for s in range(0, len(q), QUERIES):
        ids, mine = q[s : s + QUERIES], qs[s : s + QUERIES]
        at, to, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bound = np.full(len(ids), -np.inf)
        for u in range(0, len(x), BLOCK):
            others = x[u : u + BLOCK]
            r = mine @ us[u : u + BLOCK].T
            low, high = np.searchsorted(others, ids), np.searchsorted(others, ids, side="right")
            for i in np.flatnonzero(high > low).tolist():
                r[i, low[i] : high[i]] = -np.inf
            r[np.isnan(r)] = -np.inf
            if len(others) > k:
                bound = np.maximum(bound, np.partition(r, len(others) - k, axis=1)[:, len(others) - k] - 2e-6) if u == 0 else bound
            i, j = np.nonzero((r >= bound[:, None]) & (r > -np.inf))
            at, to, sim = np.r_[at, i], np.r_[to, others[j]], np.r_[sim, np.round(r[i, j], 6)]
            best = np.lexsort((to, -sim, at))
            at, to, sim = at[best], to[best], sim[best]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, to, sim, place = (c[place < k] for c in (at, to, sim, place))
            full = place == k - 1
            bound[at[full]] = np.maximum(bound[at[full]], sim[full] - 2e-6)
        out.append((ids[at], to, sim))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def neighbours(u: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """id, other, similarity, rank: each query row's k most similar other rows.

    The query rows are a stated set. They are dealt into groups and all rows into parts, as
    many as their components ask for; each group meets each part in one task, a block of
    both at a time, and only each query's best k of a part leave it. The final ranking is of
    these. Of equal (rounded) similarities the smaller id comes first."""
    spark = u.sparkSession
    known = lambda df: df.where("v is not null").select("id", "v")
    size = lambda df: known(df).agg(F.count("id"), F.max(F.size("v"))).first()
    (n, width), m = size(u), size(queries)[0]
    groups = max(1, -(-m * (width or 1) // HELD))
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-n * (width or 1) // HELD), min(2 * cores // groups, -(-n // BLOCK)))
    deal = lambda c, of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(c)
    every = lambda c, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(c)
    one = known(queries).select("id", "v", deal("_q", groups)).select("*", every("_u", parts))
    two = known(u).select("id", "v", deal("_u", parts)).select("*", every("_q", groups))

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("id").to_numpy().astype(np.int64), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = nearest(*rows(a), *rows(b), k) if len(a) and len(b) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table(dict(zip(("id", "other", "similarity"), found, strict=True)))

    near = one.groupBy("_q", "_u").cogroup(two.groupBy("_q", "_u")).applyInArrow(run, "id long, other long, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symmetric(edges: DataFrame, least: float) -> DataFrame:
    """a < b, weight: the larger of both directions, distance."""
    e = edges.where(F.col("similarity") >= least).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("similarity").alias("weight"))
    return e.withColumn("distance", F.greatest(F.round(1 - F.col("weight"), 6), F.lit(0.0)))


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Shared neighbours of two neighbour tables: how many, those of either, Jaccard index,
    overlap coefficient, and which, in order."""
    a = one.groupBy("id").agg(F.collect_set("other").alias("x"))
    b = two.groupBy("id").agg(F.collect_set("other").alias("y"))
    both = a.join(b, "id")
    shared, joined = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    listed = F.array_join(F.transform(F.array_sort(F.array_intersect("x", "y")), lambda i: i.cast("string")), ";")
    return both.select("id", shared.cast("long").alias("shared"), joined.cast("long").alias("joined"), F.round(shared / joined, 6).alias("jaccard"), F.round(shared / F.least(F.size("x"), F.size("y")), 6).alias("coefficient"), listed.alias("both"))


def drawn(u: DataFrame, draw: Column, target: DataFrame) -> DataFrame:
    """draw, similarity: the mean direction of each random set's vectors against the
    vector of ``target``, one row."""
    parts = u.select(draw.alias("draw"), F.posexplode("v")).groupBy("draw", "pos").agg(F.sum("col").alias("x"))
    whole = parts.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    q = F.broadcast(target.select(F.col("v").alias("q")))  # one row
    return whole.select("draw", unit(F.transform("p", lambda p: p["x"])).alias("c")).join(q).select("draw", F.round(dot(F.col("c"), F.col("q")), 6).alias("similarity"))


def random_sets(u: DataFrame, target: DataFrame, draws: int, size: int) -> DataFrame:
    """draw, similarity: for each draw the mean direction of ``size`` vectors, the first by
    a hash of draw and id, against the vector of ``target``, one row. A partition keeps
    the first ``size`` of a draw before any rows move."""
    drawn_rows = u.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    mixed = F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("id").cast("string")).cast("binary"))
    w = Window.partitionBy("draw").orderBy(mixed, "id")
    kept = drawn_rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size)
    return drawn(kept.drop("_k"), F.col("draw"), target)
