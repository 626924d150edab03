"""Group statistics: effect sizes, distribution distances, fences, rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators.ordered import beside, counted, medians, medians_of, of_counts, quantiles, running, written
from archivolt.operators.stored import Stored


def two_medians(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """Median of both sides, their difference, and the other side's scaled MAD."""
    both = medians(df, [*by, flag], value)
    one, two = (F.max(F.when(F.col(flag) == side, F.col("_m"))) for side in (True, False))
    return both.groupBy(*by).agg(one.alias("med_in"), two.alias("med_out"), (one - two).alias("diff"), F.max(F.when(~F.col(flag), F.col("_d") * 1.4826)).alias("mad_out"))


def trimmed_mean(df: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """Mean without the floor(share n) smallest and largest values of each group."""
    r = running(counted(df, by, value), by, value, ["n"])
    cut = F.floor(F.col("total_n") * share)
    kept = F.greatest(F.least(F.col("before_n") + F.col("n"), F.col("total_n") - cut) - F.greatest(F.col("before_n"), cut), F.lit(0))
    return r.groupBy(*by).agg((F.sum(kept * F.col(value)) / F.sum(kept)).alias("trimmed"))


def two_sides(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """The different values of each group, with the rows of both sides (a: flagged, b) at
    and below each."""
    sides = counted(df, by, value, a=F.col(flag).cast("long"), b=(~F.col(flag)).cast("long"))
    return running(sides, by, value, ["a", "b"])


def dominance(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """Vargha-Delaney A of the flagged side, Cliff's delta, U and z of the rank sum."""
    return dominance_of(two_sides(df, value, flag, by), by)


def dominance_of(r: DataFrame, by: list[str]) -> DataFrame:
    """``dominance`` from what ``two_sides`` gives."""
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / 2
    side = r.groupBy(*by).agg(F.sum(F.col("a") * rank).alias("r"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    u = F.col("r") - F.col("n") * (F.col("n") + 1) / 2
    pairs = F.col("n") * F.col("m")
    sd = F.sqrt(pairs * (F.col("n") + F.col("m") + 1) / 12)
    return side.where("n > 0 and m > 0").select(*by, u.alias("u"), (u / pairs).alias("a"), (2 * u / pairs - 1).alias("delta"), ((u - pairs / 2) / sd).alias("z"))


def distances(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """1-Wasserstein and Kolmogorov-Smirnov distances of both sides of each group."""
    return distances_of(two_sides(df, value, flag, by), value, by)


def distances_of(r: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``distances`` from what ``two_sides`` gives."""
    upto = lambda k: (F.col(f"before_{k}") + F.col(k)) / F.col(f"total_{k}")
    gap, wide = F.abs(upto("a") - upto("b")), F.coalesce(F.col("next") - F.col(value), F.lit(0.0))
    return r.groupBy(*by).agg(F.sum(gap * wide).alias("wasserstein"), F.max(gap).alias("ks"))


def fences(df: DataFrame, value: str, by: list[str], kind: str) -> DataFrame:
    """lower and upper bound of each group: tukey, mad or quantile."""
    if kind == "mad":
        d = medians(df, by, value).withColumn("_d", 3 * 1.4826 * F.col("_d"))
        return d.select(*by, (F.col("_m") - F.col("_d")).alias("lower"), (F.col("_m") + F.col("_d")).alias("upper"))
    low, high = (0.25, 0.75) if kind == "tukey" else (0.01, 0.99)
    q = quantiles(df, by, value, {"l": low, "h": high})
    reach = (F.col("h") - F.col("l")) * (1.5 if kind == "tukey" else 0.0)
    return q.select(*by, (F.col("l") - reach).alias("lower"), (F.col("h") + reach).alias("upper"))


def welch(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    side = lambda on, f: f(F.when(F.col(flag) == on, F.col(value)))
    s = df.groupBy(*by).agg(*(side(on, f).alias(f"{n}{k}") for k, on in enumerate((True, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select(*by, ((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).alias("df"))


def curve_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """A row for each different score: rows, positives and negatives at it (n, tp, fp), and
    precision, recall and fpr of what scores so high or higher."""
    s = counted(df, [], score, tp=positive.cast("long"), fp=(~positive).cast("long"))
    r = running(s, [], score, ["tp", "fp"])
    above = lambda k: F.col(f"total_{k}") - F.col(f"before_{k}")
    return r.select(score, "tp", "fp", (above("tp") / (above("tp") + above("fp"))).alias("precision"), (above("tp") / F.col("total_tp")).alias("recall"), (above("fp") / F.col("total_fp")).alias("fpr"), "total_tp", "total_fp")


def curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Average precision, the same between chance and 1, and area under ROC over distinct
    scores, in one row."""
    c = curve_points(df, score, positive)
    share = F.col("tp") / F.col("total_tp")
    ap = F.sum(share * F.col("precision"))
    chance = F.max(F.col("total_tp") / (F.col("total_tp") + F.col("total_fp")))
    return c.agg(ap.alias("ap"), ((ap - chance) / (1 - chance)).alias("normalised_ap"), F.sum(F.col("fp") / F.col("total_fp") * (F.col("recall") - share / 2)).alias("auc"))


def cramer_von_mises(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """The two-sample statistic T of each group, ties at their mean rank."""
    r = two_sides(df, value, flag, by)
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / 2

    def off(k):
        """Summed squares of rank less place, over the k rows of one value."""
        c, n = (rank - F.col(f"before_{k}")).cast("double"), F.col(k).cast("double")
        return n * c * c - c * n * (n + 1) + n * (n + 1) * (2 * n + 1) / 6

    s = r.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(off("a")).alias("x"), F.sum(off("b")).alias("y"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return s.where("n > 0 and m > 0").select(*by, ((n * F.col("x") + m * F.col("y")) / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m))).alias("t"))


def anderson_darling(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """The two-sample statistic A2 of each group in its form for ties, over the distinct
    values."""
    d = lambda c: c.cast("double")
    r = two_sides(df, value, flag, by)
    l, n = d(F.col("a") + F.col("b")), d(F.col("total_a") + F.col("total_b"))  # noqa: E741
    c = r.select(*by, l.alias("l"), (d(F.col("before_a") + F.col("before_b")) + l / 2).alias("b"), (d(F.col("before_a")) + d(F.col("a")) / 2).alias("ca"), n.alias("n"), d(F.col("total_a")).alias("na"))
    below = F.col("b") * (F.col("n") - F.col("b")) - F.col("n") * F.col("l") / 4
    term = lambda mine, size: F.col("l") / F.col("n") * (F.col("n") * mine - size * F.col("b")) ** 2 / below / size
    both = term(F.col("ca"), F.col("na")) + term(F.col("b") - F.col("ca"), F.col("n") - F.col("na"))
    return c.where((below > 0) & (F.col("na") > 0) & (F.col("na") < F.col("n"))).groupBy(*by).agg((F.sum(both) * (F.first("n") - 1) / F.first("n")).alias("a2"))


def markers(m: DataFrame, groups: DataFrame) -> DataFrame:
    """One group's samples against all others, for each gene: U, z, log2 of the means'
    ratio (1 added), and the shares of samples with the gene.

    ``groups`` (sample, grp) lists all samples. Absent cells are zeros that share one
    rank, added without being made; so the work is that of the cells there are. Gene and
    group pairs without any cell are rows too."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(groups.agg(F.count(F.lit(1)).alias("total")))  # one row
    there = m.where("value > 0").join(groups, "sample")
    w = Window.partitionBy("gene")
    ranked = there.withColumns({"_c": F.count(F.lit(1)).over(w), "_r": F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("gene", "value")) - 1) / 2})
    genes = ranked.groupBy("gene").agg(F.first("_c").alias("cc"), F.sum("value").alias("tt"))
    cells = ranked.groupBy("gene", "grp").agg(F.sum("_r").alias("r"), F.count(F.lit(1)).alias("c"), F.sum("value").alias("t"))
    levels = F.broadcast(sizes.agg(F.collect_list(F.struct("grp", "n")).alias("levels")))  # as many as groups
    every = genes.join(levels).select("gene", "cc", "tt", F.inline("levels")).join(cells, ["gene", "grp"], "left").na.fill(0, ["r", "c", "t"]).join(total)
    zeros = F.col("total") - F.col("cc")
    rank = F.col("r") + F.col("c") * zeros + (F.col("n") - F.col("c")) * (zeros + 1) / 2
    rest = F.col("total") - F.col("n")
    u = rank - F.col("n") * (F.col("n") + 1) / 2
    z = (u - F.col("n") * rest / 2) / F.sqrt(F.col("n") * rest * (F.col("total") + 1) / 12)
    fold = F.log2((F.col("t") / F.col("n") + 1) / ((F.col("tt") - F.col("t")) / rest + 1))
    return every.select("gene", "grp", u.alias("u"), z.alias("z"), fold.alias("logfc"), (F.col("c") / F.col("n")).alias("pct_in"), ((F.col("cc") - F.col("c")) / rest).alias("pct_out"))


def winsorised(df: DataFrame, value: str, by: list[str], low: float, high: float) -> DataFrame:
    """Values beyond their group's ``low`` and ``high`` quantiles set to these."""
    near = beside(df, quantiles(df, by, value, {"_low": low, "_high": high}), by)
    return near.withColumn(value, F.greatest(F.least(value, "_high"), "_low")).drop("_low", "_high")


def robust_scaled(df: DataFrame, value: str, by: list[str], least: float = 1e-12, within: tuple[float, float] | None = None) -> DataFrame:
    """Values less their group's median, over its scaled MAD; over its standard deviation
    where that is none. Groups with neither are left out. With ``within`` values beyond
    these quantiles of their group are set to them first.

    All is taken from counted values; the rows meet their group's figures once."""
    held, x = written(counted(df, by, value)), F.col(value)
    bounds = None
    if within:
        bounds = Stored(df.sparkSession).table(of_counts(held, by, value, {"_low": within[0], "_high": within[1]}), "bounds", keep=True)  # a row a group
        cut = beside(held, bounds, by).select(*by, F.greatest(F.least(x, "_high"), "_low").alias(value), "n")
        held = written(cut.groupBy(*by, value).agg(F.sum("n").alias("n")))
    mean = Stored(df.sparkSession).table(held.groupBy(*by).agg((F.sum(x * F.col("n")) / F.sum("n")).alias("_mean"), F.sum("n").alias("_n")), "means", keep=True)
    squares = beside(held, mean, by).groupBy(*by).agg(F.sum(F.col("n") * (x - F.col("_mean")) ** 2).alias("_q"), F.first("_n").alias("_n"))
    spread = squares.select(*by, F.when(F.col("_n") > 1, F.sqrt(F.col("_q") / (F.col("_n") - 1))).alias("_s"))
    d = 1.4826 * F.col("_d")
    scale = F.when(d > least, d).when(F.col("_s") > least, F.col("_s"))
    found = beside(medians_of(held, by, value), spread, by).withColumn("_scale", scale).where("_scale is not null").select(*by, "_m", "_scale")
    found = Stored(df.sparkSession).table(beside(found, bounds, by) if within else found, "scales", keep=True)
    kept = F.when(x.isNotNull(), F.greatest(F.least(x, "_high"), "_low")) if within else x
    return beside(df, found, by).withColumn(value, (kept - F.col("_m")) / F.col("_scale")).drop("_m", "_scale", "_low", "_high")


def sliced_distance(df: DataFrame, x: str, y: str, flag: str, by: list[str], slices: int = 8) -> DataFrame:
    """The mean 1-Wasserstein distance of both sides' points, seen along ``slices`` evenly
    spread directions."""
    turns = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: F.struct(k.alias("k"), (F.cos(k * F.pi() / slices) * F.col(x) + F.sin(k * F.pi() / slices) * F.col(y)).alias("at")))
    seen = df.select(*by, flag, F.inline(turns))
    return distances(seen, "at", flag, [*by, "k"]).groupBy(*by).agg(F.avg("wasserstein").alias("sliced"))
