"""Effect sizes of two sides of many groups at once, and how sure they are; p-values of
markers and the summary of an enrichment."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.inference import adjusted, hypergeometric
from archivolt.operators.ordered import MOST, beside, counted, medians, quantiles, running
from archivolt.operators.statistics import distances_of, dominance_of, two_sides
from archivolt.operators.stored import Stored

#: Coefficients of the complementary error function's fit, relative error 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """The probability of a normal deviate as far out as z, on either side."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = reduce(lambda s, c: s * t + c, reversed(ERFC), F.lit(0.0))
    return F.least(t * F.exp(power - x * x), F.lit(1.0))


def glass(df: DataFrame, value: str, flag: str, by: list[str], least: float = 1e-12) -> DataFrame:
    """median_diff of the flagged side less the other; scale: the other side's scaled MAD,
    that of both together where it is none, else 1; delta, their ratio."""
    v, f = F.col(value), F.col(flag)
    rows = df.select(*by, flag, value).where(v.isNotNull())
    sides = medians(rows, [*by, flag], value).groupBy(*by).agg(F.max(F.when(f, F.col("_m"))).alias("_f"), F.max(F.when(~f, F.col("_m"))).alias("_c"), F.max(F.when(~f, F.col("_d"))).alias("_mad"))
    pooled = medians(rows, by, value).select(*by, F.col("_d").alias("_pooled"))
    d = beside(sides, pooled, by).withColumns({"_mad": 1.4826 * F.col("_mad"), "_pooled": 1.4826 * F.col("_pooled"), "median_diff": F.col("_f") - F.col("_c")})
    scale = F.when(F.col("_mad") > least, F.col("_mad")).when(F.col("_pooled") > least, F.col("_pooled")).otherwise(1.0)
    return d.select(*by, "median_diff", scale.alias("scale"), (F.col("median_diff") / scale).alias("delta_star"))


def detection(df: DataFrame, value: str, flag: str, by: list[str], threshold: float = 0.0) -> DataFrame:
    """The share of each side over a threshold, and the median of those that are."""
    v, f = F.col(value), F.col(flag)
    over = v > threshold
    rates = df.groupBy(*by).agg(*((F.count_if(on & over) / F.count_if(on)).alias(f"rate_{name}") for name, on in (("in", f), ("out", ~f))))
    med = quantiles(df.where(over), [*by, flag], value, {"_m": 0.5}).groupBy(*by).agg(F.max(F.when(f, F.col("_m"))).alias("positive_median_in"), F.max(F.when(~f, F.col("_m"))).alias("positive_median_out"))
    return rates.join(med, by, "left")


def compared(df: DataFrame, value: str, flag: str, by: list[str], trim: float = 0.2, threshold: float = 0.0, steps: int = 9, least: float = 1e-12) -> DataFrame:
    """All effect sizes of each group: counts, median and trimmed differences, the robust
    delta, dominance, distance, shift of the deciles, detection. Groups without either
    side are left out. ``by`` may be a grid of several columns: all its cells at once.

    The rows are counted once, by value and side. One order of these gives all but the
    deviations from the medians, which are orders of the counted table too."""
    v, f = F.col(value), F.col(flag)
    n = counted(df.where(f.isNotNull()), by, value, a=f.cast("long"), b=(~f).cast("long"))
    r = Stored(df.sparkSession).table(running(n, by, value, ["a", "b"]), "order", keep=True)  # read several times
    x = v.cast("double")
    names = {"a": "in", "b": "out"}
    out: list[Column] = []

    def quantile(side: str, total: Column, skip: Column, q: float) -> Column:
        place = (total - 1) * F.lit(float(q))
        at = lambda k: F.max(F.when((F.col(f"before_{side}") <= skip + k) & (skip + k < F.col(f"before_{side}") + F.col(side)), x))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    qs = [k / (steps + 1) for k in range(1, steps + 1)]
    for side in "ab":
        total, before = F.col(f"total_{side}"), F.col(f"before_{side}")
        cut = F.floor(total * trim)
        kept = F.greatest(F.least(before + F.col(side), total - cut) - F.greatest(before, cut), F.lit(0))
        out += [F.first(total).alias(f"n_{names[side]}"), (F.sum(kept * x) / F.sum(kept)).alias(f"_t{side}"), quantile(side, total, F.lit(0), 0.5).alias(f"_m{side}")]
        out += [F.sum(F.when(v > threshold, F.col(side)).otherwise(0)).alias(f"_o{side}"), F.sum(F.when(v > threshold, 0).otherwise(F.col(side))).alias(f"_s{side}")]
        out += [quantile(side, total, F.lit(0), q).alias(f"_q{k}{side}") for k, q in enumerate(qs)]
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / 2
    upto = lambda k: (F.col(f"before_{k}") + F.col(k)) / F.col(f"total_{k}")
    out += [F.sum(F.col("a") * rank).alias("_r"), F.sum(F.abs(upto("a") - upto("b")) * F.coalesce(F.col("next") - v, F.lit(0.0))).alias("wasserstein")]
    out.append(_middle(x, "a", "b").alias("_c"))  # of all rows
    g = r.where("total_a > 0 and total_b > 0").groupBy(*by).agg(*out)
    g = Stored(df.sparkSession).table(g, "compared", keep=True)  # a row for each group
    over = beside(r, g.select(*by, *(f"_{k}{side}" for side in "ab" for k in "os")), by)
    positive = over.groupBy(*by).agg(*(quantile(side, F.col(f"_o{side}"), F.col(f"_s{side}"), 0.5).alias(f"_p{side}") for side in "ab"))
    # the counted values' deviations from the other side's median, and from that of all
    centred = beside(r.select(*by, value, "a", "b"), g.select(*by, "_mb", "_c"), by)
    mad = _deviation(centred.where("b > 0").select(*by, F.abs(x - F.col("_mb")).alias("_off"), F.col("b").alias("n")), by)
    pooled = _deviation(centred.select(*by, F.abs(x - F.col("_c")).alias("_off"), (F.col("a") + F.col("b")).alias("n")), by)
    d = beside(beside(beside(g, positive, by), mad.withColumnRenamed("_d", "_mad"), by), pooled.withColumnRenamed("_d", "_pooled"), by)
    scale = F.when(1.4826 * F.col("_mad") > least, 1.4826 * F.col("_mad")).when(1.4826 * F.col("_pooled") > least, 1.4826 * F.col("_pooled")).otherwise(1.0)
    a = (F.col("_r") - F.col("n_in") * (F.col("n_in") + 1) / 2) / (F.col("n_in") * F.col("n_out"))
    median = F.col("_ma") - F.col("_mb")
    return d.select(
        *by, "n_in", "n_out", F.array(*(F.col(f"_q{k}a") - F.col(f"_q{k}b") for k in range(steps))).alias("shift"), median.alias("median_diff"), scale.alias("scale"), (median / scale).alias("delta_star"), (F.col("_ta") - F.col("_tb")).alias("trimmed_diff"),
        a.alias("a"), (2 * a - 1).alias("delta"), "wasserstein", *((F.col(f"_o{s}") / F.col(f"n_{names[s]}")).alias(f"rate_{names[s]}") for s in "ab"), F.col("_pa").alias("positive_median_in"), F.col("_pb").alias("positive_median_out"),
    )


def _middle(x: Column, *sums: str) -> Column:
    """The median of a group, of what ``running`` gives for these sums together."""
    n, before, total = (reduce(lambda s, c: s + c, (F.col(f"{k}{s}") for s in sums or ("n",))) for k in ("", "before_", "total_"))
    place = (total - 1) * 0.5
    at = lambda k: F.max(F.when((before <= k) & (k < before + n), x))
    return (at(F.floor(place)) + at(F.ceil(place))) / 2


def _deviation(off: DataFrame, by: list[str]) -> DataFrame:
    """by and _d, the median of counted deviations."""
    n = off.groupBy(*by, "_off").agg(F.sum("n").alias("n"))
    return running(n, by, "_off", ["n"]).groupBy(*by).agg(_middle(F.col("_off")).alias("_d"))


def poisson_times(key: Column, draw: Column) -> Column:
    """How often a row counts in a draw: a Poisson number of mean 1 by a hash of both."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(F.when(u < total, k))
        p /= k + 1
    return F.coalesce(*steps, F.lit(8))


def decile_intervals(df: DataFrame, key: str, value: str, flag: str, by: list[str], rounds: int = 50, steps: int = 9, level: float = 0.95) -> DataFrame:
    """by, q, low, high: percentile intervals of the shift at each decile, over draws in
    which rows count as often as ``poisson_times`` says. Rows of equal value are added up
    before any order is made; a weighted quantile is the first value whose summed weight
    reaches its share."""
    f = F.col(flag)
    drawn = df.where(F.col(value).isNotNull()).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    n = drawn.groupBy(*by, "draw", flag, value).agg(F.sum(poisson_times(F.col(key), F.col("draw"))).alias("w")).where("w > 0")
    up = Window.partitionBy(*by, "draw", flag).orderBy(value)
    c = n.withColumns({"_c": F.sum("w").over(up), "_t": F.sum("w").over(Window.partitionBy(*by, "draw", flag))})
    at = lambda q: F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col(value)))
    qs = [k / (steps + 1) for k in range(1, steps + 1)]
    each = c.groupBy(*by, "draw", flag).agg(F.array(*(F.struct(F.lit(q).alias("q"), at(q).alias("x")) for q in qs)).alias("s")).select(*by, "draw", flag, F.inline("s"))
    shift = each.groupBy(*by, "draw", "q").agg((F.max(F.when(f, F.col("x"))) - F.max(F.when(~f, F.col("x")))).alias("d"))
    return shift.groupBy(*by, "q").agg(F.percentile("d", (1 - level) / 2).alias("low"), F.percentile("d", (1 + level) / 2).alias("high"))


def least_mixed(df: DataFrame, key: str, flag: str, keys: list[str], rounds: int, digits: int = 3) -> DataFrame:
    """Of each side (``flag``) of each group and draw the first ``_m`` rows by a hash of key
    and draw. The rows are counted by the hash's first hexadecimal ``digits``, so most are
    known to be in or out; only those whose digits the border has are ordered."""
    every = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string")).cast("binary"))
    every = every.withColumn("_h", mixed).withColumn("_d", F.substring("_h", 1, digits))
    side = [*keys, flag]
    n = every.groupBy(*side, "_d").agg(F.count(F.lit(1)).alias("_n"), F.first("_m").alias("_m"))
    before = F.sum("_n").over(Window.partitionBy(*side).orderBy("_d")) - F.col("_n")
    border = n.withColumn("_left", F.col("_m") - before).where((F.col("_left") > 0) & (F.col("_left") <= F.col("_n"))).select(*side, F.col("_d").alias("_at"), "_left")
    border = Stored(df.sparkSession).table(border, "borders", keep=True)  # a row for each side and draw
    met = every.join(border, side)
    first = F.row_number().over(Window.partitionBy(*side).orderBy("_h", key))
    ends = met.where("_d = _at").withColumn("_k", first).where("_k <= _left").drop("_k")
    return met.where("_d < _at").unionByName(ends).drop("_h", "_d", "_at", "_left", "_m")


def balanced(df: DataFrame, key: str, value: str, flag: str, by: list[str], rounds: int = 10) -> DataFrame:
    """Mean and deviation, over draws of as many rows of both sides as the smaller one has,
    of the median difference, dominance and distance. Draws go by a hash of key and
    round: a sample by intent."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.groupBy(*by).agg(F.least(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).alias("_m"), F.count(F.lit(1)).alias("_rows")).where("_m > 0")
    store, f, keys = Stored(df.sparkSession), F.col(flag), [*by, "draw"]
    n = store.table(n, "sizes", keep=True)  # a row a group
    tasks = -(-2 * rounds * (n.agg(F.sum("_rows")).first()[0] or 0) // MOST)
    if tasks > df.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, key)  # so that no task makes much over half of MOST rows
    drawn = least_mixed(rows.where(f.isNotNull()).join(n.drop("_rows"), by), key, flag, keys, rounds)
    # one order of the drawn rows' counted values gives all three
    r = store.table(two_sides(drawn, value, flag, keys), "drawn", keep=True)
    x = F.col(value).cast("double")
    med = r.groupBy(*keys).agg((_middle(x, "a") - _middle(x, "b")).alias("median_diff"))
    each = med.join(dominance_of(r, keys).select(*keys, "a"), keys).join(distances_of(r, value, keys).select(*keys, "wasserstein"), keys)
    return each.groupBy(*by).agg(*(x for c in ("median_diff", "a", "wasserstein") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))))


def inner_range_fences(df: DataFrame, value: str, by: list[str], low: float = 0.05, high: float = 0.95, reach: float = 1.5) -> DataFrame:
    """lower and upper: the median less and plus ``reach`` times the range between two
    quantiles."""
    q = quantiles(df, by, value, {"_m": 0.5, "_l": low, "_h": high}).withColumn("_r", F.col("_h") - F.col("_l"))
    return q.select(*by, (F.col("_m") - reach * F.col("_r")).alias("lower"), (F.col("_m") + reach * F.col("_r")).alias("upper"))


def tested(markers: DataFrame, pct_in: float = 0.1, pct_out: float = 0.5, fold: float = 1.5) -> DataFrame:
    """Markers with p, fdr within their group, and kept: common inside, rare outside, and of
    a fold change as asked."""
    p = markers.withColumn("p", two_sided_p(F.col("z")))
    far = adjusted(p, "p", ["grp"], ["gene"])
    return far.withColumn("kept", (F.col("pct_in") >= pct_in) & (F.col("pct_out") <= pct_out) & (F.col("logfc") >= math.log2(fold)))


def enriched(members: DataFrame, terms: DataFrame, cluster: list[str], gene: str, term: str, least: int = 10, alpha: float = 0.05) -> DataFrame:
    """cluster, term, term_size, query_size, shared, p, fdr of the terms over-represented in
    clusters of ``least`` genes or more. The background is all genes with a term."""
    known = terms.select(gene, term).distinct()
    inside = members.join(known.select(gene).distinct(), gene, "left_semi").select(*cluster, gene).distinct()
    large = members.groupBy(*cluster).agg(F.count_distinct(gene).alias("_n")).where(F.col("_n") >= least).select(*cluster)
    query = inside.join(large, cluster, "left_semi")
    drawn = query.groupBy(*cluster).agg(F.count(F.lit(1)).alias("query_size"))
    size = known.groupBy(term).agg(F.count(F.lit(1)).alias("term_size"))
    every = F.broadcast(known.agg(F.count_distinct(gene).alias("_every")))  # one row
    shared = query.join(known, gene).groupBy(*cluster, term).agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(size, term).join(drawn, cluster).crossJoin(every)
    p = both.withColumn("p", F.round(hypergeometric(F.col("shared"), F.col("term_size"), F.col("query_size"), F.col("_every")), 9)).drop("_every")
    return adjusted(p, "p", cluster, [term]).where(F.col("fdr") <= alpha)


def enrichment_summary(found: DataFrame, members: DataFrame, cluster: list[str], setting: str, term: str) -> DataFrame:
    """Of each setting the significant terms, the different ones, and all its clusters."""
    n = members.groupBy(setting).agg(F.count_distinct(*cluster).alias("n_clusters"))
    terms = found.groupBy(setting).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(term).alias("unique"))
    return n.join(terms, setting, "left").na.fill(0, ["total", "unique"])
