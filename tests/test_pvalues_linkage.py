"""Probabilities against tabulated values; clusters against one merge at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import learning, linkage, pvalues

# Tables of the distributions.
KOLMOGOROV = {0.5: 0.9639452436, 1.0: 0.2699996717, 1.358099: 0.05, 1.627624: 0.01}
STUDENT = {(2.228139, 10): 0.05, (12.706205, 1): 0.05, (2.776445, 4): 0.05, (3.169273, 10): 0.01, (1.644854, 10**7): 0.1, (0.0, 3): 1.0, (1.0, 1): 0.5}
CRAMER = {0.34730: 0.10, 0.46136: 0.05, 0.74346: 0.01, 0.11888: 0.50}
ANDERSON = {1.9330: 0.10, 2.4922: 0.05, 3.8784: 0.01, 0.7742: 0.50}


@pytest.mark.parametrize(("f", "table", "near"), [(pvalues.kolmogorov, KOLMOGOROV, 1e-6), (pvalues.cramer_limit, CRAMER, 2e-5), (pvalues.anderson_limit, ANDERSON, 2e-4)])
def test_limits(spark, f, table, near):
    df = spark.createDataFrame([(x, p) for x, p in table.items()], "x double, p double").withColumn("got", f(F.col("x")))
    assert all(abs(r.got - r.p) < near for r in df.collect()), [(r.x, r.got, r.p) for r in df.collect()]


def test_student(spark):
    df = spark.createDataFrame([(t, float(n), p) for (t, n), p in STUDENT.items()], "t double, n double, p double").withColumn("got", pvalues.student(F.col("t"), F.col("n")))
    assert all(abs(r.got - r.p) < 1e-6 for r in df.collect()), df.collect()
    g = spark.createDataFrame([(x,) for x in (0.3, 0.5, 1.0, 7.7, 1e6)], "x double").withColumn("g", pvalues.log_gamma(F.col("x")))
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-9 * max(1, abs(r.g)) for r in g.collect())


def test_two_sample_tests(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([round(rng.gauss(0.4 * f, 1), 1), 0.0])), f) for g in ("a", None) for f in (True, False) for _ in range(80)] + [("one side", 1.0, True), ("same", 2.0, True), ("same", 2.0, False)]
    got = {(r.g, r.test): r for r in pvalues.two_sample_tests(spark.createDataFrame(rows, "g string, v double, f boolean"), "v", "f", ["g"]).collect()}
    assert {g for g, _ in got} == {"a", None, "same"} and got["same", "ttest"].p is None
    for g in ("a", None):
        x, y = (np.array([v for h, v, f in rows if h == g and f == on]) for on in (True, False))
        va, vb = x.var(ddof=1) / 80, y.var(ddof=1) / 80
        assert got[g, "ttest"].statistic == pytest.approx((x.mean() - y.mean()) / math.sqrt(va + vb))
        share = (np.sign(x[:, None] - y[None, :]).mean() + 1) / 2
        assert got[g, "mannwhitney"].statistic == pytest.approx(share)
        counts = np.unique(np.r_[x, y], return_counts=True)[1]
        sd = math.sqrt(6400 / 12 * (161 - (counts**3 - counts).sum() / (160 * 159)))
        assert got[g, "mannwhitney"].p == pytest.approx(math.erfc((abs(share - 0.5) * 6400 - 0.5) / sd / math.sqrt(2)), rel=1e-5)
        d = max(abs(np.mean(x <= v) - np.mean(y <= v)) for v in np.r_[x, y])
        assert got[g, "ks"].statistic == pytest.approx(d)
        # all five tell the same story: a permutation's share is near each p
        spread = np.random.default_rng(1)
        both = np.r_[x, y]
        drawn = []
        for _ in range(400):
            spread.shuffle(both)
            drawn.append(abs(both[:80].mean() - both[80:].mean()))
        assert abs(np.mean(np.array(drawn) >= abs(x.mean() - y.mean())) - got[g, "ttest"].p) < 0.06
        assert all(0 <= got[g, t].p <= 1 for t in ("ks", "ad", "cvm", "ttest", "mannwhitney"))



def merge(d: np.ndarray, k: int, how: str = "average") -> np.ndarray:
    """The cluster of each of n items, from their distances, when k are left; clusters are
    numbered in the order of their first items. ``how``: average or ward."""
    n = len(d)
    d = (d.astype(float) ** 2 if how == "ward" else d.astype(float)).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(max(0, n - k)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        if how == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


@pytest.mark.parametrize("how", ["average", "ward"])
def test_rounds_equal_one_merge_at_a_time(spark, how):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (12, 2)) for c in (0, 2, 5)])
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(x)) for j in range(i + 1, len(x))], "a int, b int, distance double")
    for k in (3, 7):
        got = sorted((r.node, r.cluster) for r in linkage.clusters(pairs, k, how).collect())
        assert [c for _, c in got] == merge(d, k, how).tolist()
    with pytest.raises(ValueError):
        linkage.clusters(pairs, 3, "single")


def test_clusters_of_little(spark):
    none = spark.createDataFrame([], "a string, b string, distance double")
    assert linkage.clusters(none, 2).count() == 0
    two = spark.createDataFrame([("x", "y", 1.0)], "a string, b string, distance double")
    assert sorted(map(tuple, linkage.clusters(two, 5).collect())) == [("x", 0), ("y", 1)]
    assert sorted(map(tuple, linkage.clusters(two, 1).collect())) == [("x", 0), ("y", 0)]


def test_clusters_of_groups_far_apart(spark):
    rows = [(g, float(at + i)) for g, at in (("a", 0), ("b", 1), ("c", 500), ("d", 502)) for i in range(50)]
    far = learning.group_distances(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    assert {(r.a, r.b): r.distance for r in far.collect()}[("a", "d")] == pytest.approx(502)
    assert {r.node: r.cluster for r in linkage.clusters(far, 2).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
