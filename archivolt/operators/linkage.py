"""Hierarchical clusters of a table of distances, in rounds of reciprocal nearest neighbours.

Between two clusters stands the sum of their members' distances (of their squares for
ward's), within one the sum of its own; the mean distance, and ward's distance of the
centres, follow from these sums and the sizes. In a round every cluster finds its nearest
other, of equals the smaller pair, and all pairs that are each other's nearest merge: for
both linkages later merges can't undo that, so the tree is that of one merge at a time.
Merging adds rows of the edge table up. So no task holds the distances of all, and the rows
are fewer each round. The tree is a table of merges; a cut takes those of the least heights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored


def merges(distances: DataFrame, how: str = "average", store: Stored | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """round, a, b, height of all merges (b goes into a < b), and of each round the stored
    table of its merges. ``distances`` has each pair (a, b, distance) of all nodes once."""
    if how not in ("average", "ward"):
        raise ValueError(f"linkage {how}")
    store = store or Stored(distances.sparkSession)
    d = F.col("distance").cast("double")
    edges = store.table(distances.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (d * d if how == "ward" else d).alias("s")), "distances")
    sizes = store.table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.lit(1.0).alias("n"), F.lit(0.0).alias("inner")), "sizes")
    kind = dict(edges.dtypes)["a"]
    rounds: list[DataFrame] = []
    while True:
        end = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("inner").alias(f"i{x}"))  # noqa: B023, E731
        known = edges.join(end("a"), "a").join(end("b"), "b")
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        if how == "ward":
            # squared distance of the centres, from sums over ordered pairs within
            gap = F.greatest(mean - F.col("ia") / (2 * F.col("na") * F.col("na")) - F.col("ib") / (2 * F.col("nb") * F.col("nb")), F.lit(0.0))
            height = F.sqrt(2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * gap)
        else:
            height = mean
        far = known.select("a", "b", F.round(height, 12).alias("height"))
        ways = F.array(F.struct(F.col("a").alias("of"), "height", "a", "b"), F.struct(F.col("b").alias("of"), "height", "a", "b"))
        nearest = far.select(F.explode(ways).alias("e")).select("e.*").groupBy("of").agg(F.min(F.struct("height", "a", "b")).alias("m"))
        # a pair that is the nearest of both its ends is there twice
        pairs = nearest.groupBy("m").agg(F.count(F.lit(1)).alias("_k")).where("_k = 2").select("m.a", "m.b", "m.height")
        found = store.table(pairs, "merges")
        if not found.take(1):
            break
        rounds.append(found)
        to = found.select(F.col("b").alias("node"), F.col("a").alias("to"))
        moved = lambda df, x: df.join(to.select(F.col("node").alias(x), F.col("to").alias(f"_{x}")), x, "left").withColumn(x, F.coalesce(f"_{x}", x)).drop(f"_{x}")  # noqa: B023, E731
        every = moved(moved(edges, "a"), "b")
        inside = every.where("a = b").groupBy(F.col("a").alias("node")).agg((2 * F.sum("s")).alias("_s"))
        parts = moved(sizes, "node").groupBy("node").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner"))
        sizes = store.table(parts.join(inside, "node", "left").select("node", "n", (F.col("inner") + F.coalesce("_s", F.lit(0.0))).alias("inner")), "sizes")
        edges = store.table(every.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")), "distances")
    none = distances.sparkSession.createDataFrame([], f"round int, a {kind}, b {kind}, height double")
    return reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("round"), "a", "b", "height") for k, r in enumerate(rounds)], none), rounds


def clusters(distances: DataFrame, k: int, how: str = "average") -> DataFrame:
    """node, cluster (from 0, in order of the clusters' first nodes) when k are left; all of
    them if there are fewer nodes."""
    store = Stored(distances.sparkSession)
    tree, rounds = merges(distances, how, store)
    nodes = distances.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keep = max(0, tree.count() + 1 - k)
    # heights never fall from a merge to the one that it goes into
    bound = tree.orderBy("height", "round", "a").limit(keep).agg(F.max(F.struct("height", "round", "a")).alias("m")).first()["m"] if keep else None
    at = nodes.select("node", F.col("node").alias("label"))
    for n, found in enumerate(rounds if bound else []):
        mine = (F.col("height") < bound["height"]) | ((F.col("height") == bound["height"]) & ((F.lit(n) < bound["round"]) | ((F.lit(n) == bound["round"]) & (F.col("a") <= F.lit(bound["a"])))))
        step = found.where(mine).select(F.col("b").alias("label"), F.col("a").alias("_to"))
        at = at.join(step, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    labels = store.table(at, "labels", keep=True)
    # a row a cluster; b goes into a < b, so a label is its cluster's first node
    order = labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("cluster"))
    store.clear()
    return labels.join(order, "label").select("node", "cluster")
