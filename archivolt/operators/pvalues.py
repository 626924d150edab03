"""Probabilities of two-sample statistics, as columns.

Series and continued fractions run as aggregates over short sequences, so they stay in the
JVM. The limits are those for large samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators import statistics
from archivolt.operators.effects import two_sided_p
from archivolt.operators.ordered import beside

# Stirling's series of the logarithm of the gamma function, and the fit of the
# limit of the Anderson-Darling statistic (Marsaglia and Marsaglia, 2004), below 2 and above.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
AD_LOW = (2.00012, 0.247105, -0.0649821, 0.0347962, -0.0116720, 0.00168691)
AD_HIGH = (1.0776, -2.30695, 0.43424, -0.082433, 0.008056, -0.0003146)


def log_gamma(x: Column) -> Column:
    """Of x > 0: Stirling's series at x + 8."""
    y = x + 8
    series = reduce(lambda s, c: s / (y * y) + c, reversed(STIRLING), F.lit(0.0)) / y
    below = reduce(lambda s, k: s + F.ln(x + k), range(8), F.lit(0.0))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def fraction(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    begin = 1 / tiny(1 - (a + b) * x / (a + 1))

    def term(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        out = F.struct(s["c"].alias("c"), s["d"].alias("d"), s["h"].alias("h"))
        for step in (even, odd):
            d, c = 1 / tiny(1 + step * out["d"]), tiny(1 + step / out["c"])
            out = F.struct(c.alias("c"), d.alias("d"), (out["h"] * d * c).alias("h"))
        return out

    first = F.struct(F.lit(1.0).alias("c"), begin.alias("d"), begin.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), first, term)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    near = x < (a + 1) / (a + b + 2)
    inner = F.when(near, front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def student(t: Column, df: Column) -> Column:
    """The probability of a Student's t as far out, on either side."""
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def kolmogorov(x: Column) -> Column:
    """The probability that the limit of sqrt(n) D exceeds x."""
    given, x = x, F.greatest(x, F.lit(0.04))
    every = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: k.cast("double"))
    total = lambda f: F.aggregate(every, F.lit(0.0), lambda s, k: s + f(k))
    small = 1 - math.sqrt(2 * math.pi) / x * total(lambda k: F.exp(-((2 * k - 1) * (2 * k - 1)) * math.pi**2 / (8 * x * x)))
    large = 2 * total(lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return F.when(given <= 0.04, 1.0).when(x < 1, small).otherwise(large)


def cramer_limit(x: Column) -> Column:
    """The probability that the limit of the Cramer-von Mises statistic exceeds x: a series
    of Bessel functions of order 1/4, each an integral by the trapezoid rule."""
    given, x = x, F.greatest(x, F.lit(0.003))
    nodes, width = 96, 0.0625
    out = F.lit(0.0)
    for k in range(6):
        z = (4 * k + 1) ** 2 / (16 * x)
        # exp(-z) K(z) = integral of exp(-z (1 + cosh t)) cosh(t / 4)
        inner = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(nodes)), lambda i: i * width), F.exp(-2 * z) / 2, lambda s, t: s + F.exp(-z * (1 + F.cosh(t))) * F.cosh(t / 4)) * width
        out = out + math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / math.pi**1.5 * math.sqrt(4 * k + 1) * inner / F.sqrt(x)
    return F.when(given < 0.003, 1.0).otherwise(F.greatest(1 - out, F.lit(0.0)))


def anderson_limit(x: Column) -> Column:
    """The probability that the limit of the Anderson-Darling statistic exceeds x."""
    given, x = x, F.greatest(x, F.lit(1e-3))
    fit = lambda cs: reduce(lambda s, c: s * x + c, reversed(cs), F.lit(0.0))
    low = F.exp(-1.2337141 / x) / F.sqrt(x) * fit(AD_LOW)
    high = F.exp(-F.exp(fit(AD_HIGH)))
    return F.when(given <= 0, 1.0).when(x < 2, 1 - low).otherwise(1 - high)


def two_sample_tests(df: DataFrame, value: str, flag: str, by: list[str]) -> DataFrame:
    """by, test, statistic, p of five tests of both sides of each group: ks, ad, cvm, ttest
    (of unequal variances) and mannwhitney, whose statistic is the share of pairs and whose
    p has the corrections for ties and continuity."""
    r = statistics.two_sides(df.where(F.col(flag).isNotNull()), value, flag, by)
    d = lambda c: F.col(c).cast("double")
    l = d("a") + d("b")  # noqa: E741
    rank = d("before_a") + d("before_b") + (l + 1) / 2
    upto = lambda k: (d(f"before_{k}") + d(k)) / d(f"total_{k}")
    n, m, v = d("total_a"), d("total_b"), d(value)

    def off(k: str) -> Column:
        c, size = rank - d(f"before_{k}"), d(k)
        return size * c * c - c * size * (size + 1) + size * (size + 1) * (2 * size + 1) / 6

    b, ca = d("before_a") + d("before_b") + l / 2, d("before_a") + d("a") / 2
    under = b * (n + m - b) - (n + m) * l / 4
    ad = F.when(under > 0, l / (n + m) * (((n + m) * ca - n * b) ** 2 / n + ((n + m) * (b - ca) - m * b) ** 2 / m) / under).otherwise(0.0)
    side = lambda k: (F.sum(d(k) * v).alias(f"s{k}"), F.sum(d(k) * v * v).alias(f"q{k}"), F.sum(off(k)).alias(f"o{k}"))
    g = r.where("total_a > 0 and total_b > 0").groupBy(*by).agg(F.first(n).alias("n"), F.first(m).alias("m"), F.sum(d("a") * rank).alias("r"), F.max(F.abs(upto("a") - upto("b"))).alias("ks"), F.sum(ad).alias("ad"), F.sum(l * l * l - l).alias("ties"), *side("a"), *side("b"))
    # variances from sums about the group's mean, which is near both
    centre = r.groupBy(*by).agg((F.sum((d("a") + d("b")) * v) / F.sum(d("a") + d("b"))).alias("_mean"))
    spread = beside(r, centre, by).groupBy(*by).agg(*(x for k in "ab" for x in (F.sum(d(k) * (v - F.col("_mean"))).alias(f"d{k}"), F.sum(d(k) * (v - F.col("_mean")) ** 2).alias(f"e{k}"))))
    g = beside(g, spread, by)
    n, m = F.col("n"), F.col("m")
    total, pairs = n + m, n * m
    var = lambda k, size: F.greatest((F.col(f"e{k}") - F.col(f"d{k}") ** 2 / size) / F.greatest(size - 1, F.lit(1.0)), F.lit(0.0)) / size
    va, vb = F.when(n > 1, var("a", n)), F.when(m > 1, var("b", m))
    t = F.when(va + vb > 0, (F.col("sa") / n - F.col("sb") / m) / F.sqrt(F.greatest(va + vb, F.lit(1e-300))))
    free = F.when(va + vb > 0, (va + vb) ** 2 / F.greatest(va * va / F.greatest(n - 1, F.lit(1.0)) + vb * vb / F.greatest(m - 1, F.lit(1.0)), F.lit(1e-300)))
    u = F.col("r") - n * (n + 1) / 2
    sd = F.sqrt(pairs / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.when(sd > 0, F.greatest(F.abs(u - pairs / 2) - 0.5, F.lit(0.0)) / F.greatest(sd, F.lit(1e-300)))
    cvm = (n * F.col("oa") + m * F.col("ob")) / (pairs * total) - (4 * pairs - 1) / (6 * total)
    mean, variance = (1 + 1 / total) / 6, (total + 1) * (4 * pairs * total - 3 * (n * n + m * m) - 2 * pairs) / (45 * total * total * 4 * pairs)
    # columns of their own first: the functions below name their arguments many times
    g = g.withColumns({"_ad": F.col("ad") * (total - 1) / total, "_cvm": cvm, "_far": 1 / 6 + (cvm - mean) / F.sqrt(F.greatest(45 * variance, F.lit(1e-300))), "_t": t, "_free": free, "_u": u / pairs, "_z": z, "_x": F.sqrt(pairs / total) * F.col("ks")})
    g = g.withColumns({"_half": F.col("_free") / 2, "_near": F.col("_free") / (F.col("_free") + F.col("_t") * F.col("_t"))})
    c = F.col
    tests = {"ks": (c("ks"), kolmogorov(c("_x"))), "ad": (c("_ad"), anderson_limit(c("_ad"))), "cvm": (c("_cvm"), cramer_limit(c("_far"))), "ttest": (c("_t"), incomplete_beta(c("_half"), F.lit(0.5), c("_near"))), "mannwhitney": (c("_u"), two_sided_p(c("_z")))}
    rows = F.array(*(F.struct(F.lit(name).alias("test"), s.cast("double").alias("statistic"), p.cast("double").alias("p")) for name, (s, p) in tests.items()))
    return g.select(*by, F.explode(rows).alias("_t")).select(*by, "_t.*")
