"""Communities of weighted graphs by modularity, for many resolutions at once.

The modularity of a partition at resolution g is the sum over communities of
(inner weight) / 2m - g (total degree / 2m)^2. All resolutions' graphs are one edge table
with a column for the resolution, so that a job moves the nodes of all of them.

A level begins with local moving. In a round each node adds up its weight to the
communities around it and finds the one of the largest gain, from the communities' total
degrees; it may also leave for a community of its own. Nodes only go where a hash of the
label and the round is larger, another order in each round, so no two swap places. A round
also yields the modularity of the partition that it began with; the best of them stays, so
a round that overshoots (several nodes that join one community at a time) does no harm.

Then each community is refined: its nodes start alone and merge with neighbours inside it,
tails into heads by a hash, where that gains modularity. What merged is connected, and
becomes a node of the next level, which begins with the communities found so far; a node
there may still leave. A resolution is done when a level makes it no better.

Every round reads and writes tables in the shared folder; only a row for each resolution
comes to the driver, no table is broadcast. Sums over a community or a node of many edges are partial sums before
they are shuffled. Edges are undirected, those given several times (in either direction)
are added up; null ends, self loops and weights that aren't above 0 are left out, and so
are nodes without any other edge. A graph without edges has no communities.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored

#: Gains below it don't count; sums of doubles depend on their order.
LEAST = 1e-9
#: What a round, or a level, must add to the modularity to count as better; and the rounds
#: without a better partition that end a level.
BETTER, PATIENCE = 1e-3, 2


def half(label: Column, turn: int) -> Column:
    """0 or 1, another one for each turn."""
    return F.xxhash64(label, F.lit(turn)).bitwiseAND(1)


def dealt(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that deals out both sides: a table of nodes or communities grows with the
    graph and is joined in every round, so it isn't collected and broadcast."""
    return a.join(b.hint("merge"), on, how)


def swept(links: DataFrame, state: DataFrame, m2: float, turn: int) -> DataFrame:
    """One round: the rows of ``state`` (r, gamma, node, k, self, c) with ``to``, the
    community that each node goes to, whether it ``wants`` to go anywhere, and its part
    ``q`` of the modularity before."""
    totals = state.groupBy("r", "c").agg(F.sum("k").alias("tot"))
    around = dealt(links.where("a <> b"), state.select("r", F.col("node").alias("b"), F.col("c").alias("at")), ["r", "b"])
    own = state.select("r", F.col("node").alias("a"), F.col("c").alias("at"), F.lit(0.0).alias("w"))
    options = around.select("r", "a", "at", "w").unionByName(own).groupBy("r", "a", "at").agg(F.sum("w").alias("w"))
    known = dealt(dealt(options, totals.withColumnRenamed("c", "at"), ["r", "at"]), state.withColumnRenamed("node", "a"), ["r", "a"])
    is_own = F.col("at") == F.col("c")
    gain = F.col("w") - F.col("gamma") * F.col("k") * (F.col("tot") - F.when(is_own, F.col("k")).otherwise(0.0)) / m2
    free = F.xxhash64("at", F.lit(turn)) > F.xxhash64("c", F.lit(turn))
    best = known.withColumns({"_own": is_own, "_gain": F.round(gain, 12), "_free": free}).groupBy("r", "gamma", "a", "k", "self", "c").agg(
        F.max(F.when(F.col("_own"), F.col("_gain"))).alias("stay"),
        F.max(F.when(F.col("_own"), F.col("w") + F.col("self") - F.col("gamma") * F.col("k") * F.col("tot") / m2)).alias("q"),
        F.max(F.when(~F.col("_own"), F.col("_gain"))).alias("most"),
        F.min(F.when(~F.col("_own") & F.col("_free"), F.struct((-F.col("_gain")).alias("g"), F.col("at")))).alias("go"),
    )
    alone = (F.col("stay") < -LEAST) & (F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0)) <= LEAST)
    mover = half(F.col("c"), turn) == 0
    goes = F.col("go").isNotNull() & (-F.col("go.g") > F.greatest(F.col("stay"), F.lit(0.0)) + LEAST)
    to = F.when(goes, F.col("go.at")).when(alone & mover, F.struct(F.col("a").alias("n"), F.lit(turn).alias("t"))).otherwise(F.col("c"))
    wants = alone | (F.coalesce("most", F.lit(0.0)) > F.greatest(F.col("stay"), F.lit(0.0)) + LEAST)
    return best.select("r", "gamma", F.col("a").alias("node"), "k", "self", "c", to.alias("to"), wants.alias("wants"), (F.col("q") / m2).alias("q"))


def merged(links: DataFrame, state: DataFrame, m2: float, turn: int) -> DataFrame:
    """r, node, super: tails go to the head of the same community that gains most."""
    end = lambda x: state.select("r", F.col("node").alias(x), F.col("k").alias(f"k{x}"), F.col("c").alias(f"c{x}"))
    tail, head = half(F.col("a"), turn) == 0, half(F.col("b"), turn) == 1
    inside = dealt(dealt(links.where(tail & head), end("a"), ["r", "a"]), end("b"), ["r", "b"]).where("ca = cb")
    gain = F.col("w") - F.col("gamma") * F.col("ka") * F.col("kb") / m2
    gamma = state.select("r", F.col("node").alias("a"), "gamma")
    best = dealt(inside, gamma, ["r", "a"]).withColumn("_g", F.round(gain, 12)).where(F.col("_g") > LEAST).groupBy("r", "a").agg(F.min_by("b", F.struct(-F.col("_g"), "b")).alias("super"))
    return dealt(state.select("r", "node"), best.withColumnRenamed("a", "node"), ["r", "node"], "left").select("r", "node", F.coalesce("super", "node").alias("super"))


def coarse(links: DataFrame, state: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the graph whose nodes were merged; edges within become loops."""
    a, b = (to.select("r", F.col("node").alias(x), F.col("super").alias(f"_{x}")) for x in ("a", "b"))
    e = dealt(dealt(links, a, ["r", "a"]), b, ["r", "b"]).groupBy("r", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w"))
    inner = F.sum(F.col("w"))
    loops = dealt(dealt(links, a, ["r", "a"]), b, ["r", "b"]).where("_a = _b").groupBy("r", F.col("_a").alias("node")).agg(inner.alias("self"))
    n = dealt(state, to, ["r", "node"]).groupBy("r", "gamma", F.col("super").alias("node")).agg(F.sum("k").alias("k"), F.first("c").alias("c"))
    return e, dealt(n, loops, ["r", "node"], "left").na.fill(0.0, ["self"]).select("r", "gamma", "node", "k", "self", "c")


def settled(store: Stored, links: DataFrame, state: DataFrame, m2: float, turn: int) -> tuple[DataFrame, dict[int, float], set[int], int]:
    """The best partition of each resolution that local moving found, its modularity, the
    resolutions that got better, and the turns so far."""
    best: dict[int, tuple[float, int]] = {}
    first: dict[int, float] = {}
    last: dict[int, tuple[float, int]] = {}  # the last round that was better, and its modularity
    rounds: list[DataFrame] = []
    active: list[int] | None = None
    while active is None or active:
        here = state if active is None else state.where(F.col("r").isin(active))
        rounds.append(store.table(swept(links if active is None else links.where(F.col("r").isin(active)), here, m2, turn), "sweep"))
        k, turn, active = len(rounds) - 1, turn + 1, []
        for row in rounds[k].groupBy("r").agg(F.sum("q").alias("q"), F.count_if("wants").alias("wants")).collect():  # a row for each resolution
            r = row["r"]
            first.setdefault(r, row["q"])
            if r not in best or row["q"] > best[r][0]:
                best[r] = row["q"], k
            if r not in last or row["q"] > last[r][0] + BETTER:
                last[r] = row["q"], k
            if row["wants"] and k - last[r][1] < PATIENCE:
                active.append(r)
        state = rounds[k].select("r", "gamma", "node", "k", "self", F.col("to").alias("c"))
    chosen = [rounds[k].where(F.col("r").isin(mine)) for k in range(len(rounds)) if (mine := [r for r, (_, at) in best.items() if at == k])]
    return reduce(DataFrame.unionByName, chosen).select("r", "gamma", "node", "k", "self", "c"), {r: q for r, (q, _) in best.items()}, {r for r, (q, _) in best.items() if q > first[r] + BETTER}, turn


def found(edges: DataFrame, resolutions: Sequence[float] = (1.0,)) -> DataFrame:
    """resolution, node, community (its smallest node) and modularity (of the whole
    partition at that resolution)."""
    spark = edges.sparkSession
    store = Stored(spark)
    good = edges.where("a is not null and b is not null and a <> b and weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = store.table(good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
    kind = both.schema["a"].dataType.simpleString()
    out = f"resolution double, node {kind}, community {kind}, modularity double"
    m2 = both.agg(F.sum("w")).first()[0]
    if not m2 or not resolutions:
        return spark.createDataFrame([], out)
    gammas = [float(g) for g in resolutions]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(g).alias("gamma")) for r, g in enumerate(gammas)))).alias("_e")
    links = both.select(each, "*").select("_e.r", "a", "b", "w")
    alone = F.struct(F.col("a").alias("n"), F.lit(-1).alias("t"))
    degree = both.groupBy("a").agg(F.sum("w").alias("k"))
    state = degree.select(each, "*").select("_e.r", "_e.gamma", F.col("a").alias("node"), "k", F.lit(0.0).alias("self"), alone.alias("c"))
    maps: list[DataFrame] = []  # from each level's nodes to the next one's
    ends: dict[int, DataFrame] = {}  # by level, of the resolutions that ended there
    quality: dict[int, float] = {}
    turn, left = 0, set(range(len(gammas)))
    while left:
        state, q, better, turn = settled(store, links, state, m2, turn)
        quality |= q
        state, level = store.table(state, "state"), len(maps)
        if done := left - better:
            ends[level] = state.where(F.col("r").isin(list(done))).select("r", "node", "c")
            left = left & better
            links, state = links.where(F.col("r").isin(list(left))), state.where(F.col("r").isin(list(left)))
        for _ in range(2 if left else 0):  # tails and heads by another hash
            to = store.table(merged(links, state, m2, turn), "merge")
            links, state = coarse(links, state, to)
            links, state = store.table(links, "links"), store.table(state, "nodes")
            maps.append(to)
            turn += 1
    # down to the first level's nodes
    labels = None
    for level in range(max(ends), -1, -1):
        if labels is not None:
            labels = dealt(maps[level], labels.withColumnRenamed("node", "super"), ["r", "super"]).select("r", "node", "c")
        if level in ends:
            labels = ends[level] if labels is None else labels.unionByName(ends[level])
    flat = store.table(labels, "flat")
    names = flat.groupBy("r", "c").agg(F.min("node").alias("community"))
    at = F.create_map(*(x for r, g in enumerate(gammas) for x in (F.lit(r), F.struct(F.lit(g).alias("g"), F.lit(quality[r]).alias("q")))))
    result = store.table(dealt(flat, names, ["r", "c"]).select(at[F.col("r")]["g"].alias("resolution"), "node", "community", at[F.col("r")]["q"].alias("modularity")), "communities", keep=True)
    store.clear()
    return result


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """resolution, modularity of given partitions (resolution, node, community), from the
    edges alone."""
    good = edges.where("a is not null and b is not null and a <> b and weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    end = lambda x: parts.select("resolution", F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    inner = good.join(end("a"), "a").join(end("b"), ["resolution", "b"]).where("ca = cb").groupBy("resolution", F.col("ca").alias("community")).agg((2 * F.sum("w")).alias("inner"))
    ends = good.select(F.explode(F.array("a", "b")).alias("node"), "w").join(parts, "node").groupBy("resolution", "community").agg(F.sum("w").alias("k"))
    whole = F.broadcast(good.agg((2 * F.sum("w")).alias("m2")))  # one row
    per = ends.join(inner, ["resolution", "community"], "left").na.fill(0.0, ["inner"]).crossJoin(whole)
    share = F.col("k") / F.col("m2")
    return per.groupBy("resolution").agg(F.sum(F.col("inner") / F.col("m2") - F.col("resolution") * share * share).alias("modularity"))


def summary(parts: DataFrame) -> DataFrame:
    """resolution, n_communities, largest, singles, modularity."""
    sizes = parts.groupBy("resolution", "modularity", "community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("resolution", "modularity").agg(F.count(F.lit(1)).alias("n_communities"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singles"))
