"""Components, classifiers, fences and clusters against plain versions."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivolt.operators import inference, learning, ordered


def test_components(spark):
    x = np.random.default_rng(1).normal(size=(200, 5)) * [5, 3, 2, 1, 0.5]
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = learning.components(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 3).orderBy("component").toPandas()
    assert np.allclose(got["share"], (values / values.sum())[:3])
    assert np.allclose(got["cumulative"], np.cumsum(values / values.sum())[:3])


def test_radial_machine_tells_a_ring_from_its_middle(spark):
    draw = np.random.default_rng(2)
    turn, wide = draw.uniform(0, 2 * math.pi, 600), np.where(np.arange(600) % 2, 2.0, 0.5) + draw.normal(0, 0.1, 600)
    rows = [(i, [float(r * math.cos(t)), float(r * math.sin(t))], i % 2) for i, (t, r) in enumerate(zip(turn, wide, strict=True))]
    df = inference.split(spark.createDataFrame(rows, "i long, v array<double>, y int"), "i", "y")
    got = learning.radial(df, "i", "v", F.col("y") == 1, 2, 1.0).toPandas()
    assert len(got) == 120 and ((got["probability"] > 0.5) == (got["y"] == 1)).mean() > 0.97


def test_boosted_trees_tell_boxes_apart(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(i % 3) + float(draw.uniform(0, 0.8)), float(draw.uniform())], i % 3) for i in range(300)]
    df = inference.split(spark.createDataFrame(rows, "i long, v array<double>, y int"), "i", "y")
    got = learning.boosted(df, "v", "y", 3).toPandas()
    assert sorted(got["label"]) == [0, 1, 2] and got["f1"].min() > 0.95


def brute_medcouple(x):
    m = np.median(x)
    return np.median([((b - m) - (m - a)) / (b - a) for a in x if a <= m for b in x if b >= m and b != a])


@pytest.mark.parametrize("skewed", [False, True])
def test_skew_fences(spark, skewed):
    draw = np.random.default_rng(4)
    x = draw.exponential(size=1000) if skewed else draw.normal(size=1000)
    got = learning.skew_fences(spark.createDataFrame([("g", float(v)) for v in x], "g string, v double"), "v", ["g"]).first()
    assert abs(got.mc - brute_medcouple(x)) < 0.02
    low, high = np.quantile(x, [0.25, 0.75])
    assert got.lower < low and got.upper > high
    assert learning._medcouple([1.0, 1.0, 1.0]) == 0.0


@pytest.mark.parametrize("most", [1 << 20, 16])
def test_medcouple_of_all_pairs(spark, monkeypatch, most):
    """Over all pairs, however many values a task holds; repeated values too."""
    monkeypatch.setattr(ordered, "MOST", most)
    draw = np.random.default_rng(8)
    groups = {"a": draw.exponential(size=401), None: np.round(draw.exponential(3, 300), 1), "few": np.array([1.0, 2.0, 9.0, 10.0]), "same": np.ones(5)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(3)
    got = {r.g: r.mc for r in learning.skew_fences(df, "v", ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        m, x = np.median(x), np.sort(x)
        low, high = x[x <= m] - m, x[x >= m] - m
        p = int((x == m).sum())
        h = [np.sign(i + j - (p - 1)) if a == b == 0 else (b + a) / (b - a) for i, b in enumerate(high) for j, a in enumerate(low[::-1])]
        assert got[g] == pytest.approx(np.median(h), abs=1e-9)


def test_tail_fence_without_a_tail(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", float(i)) for i in range(1000)], "g string, v double")
    got = {r.g: r.upper for r in learning.tail_fence(df, "v", ["g"]).collect()}
    assert got["a"] == 1.0 and 949 < got["b"] < 1005


def test_features_are_one_flat_array(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1300, 2))  # several slices of rows
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<double>").coalesce(1)
    got = np.array([r.f for r in df.select("i", learning.fourier(F.col("v"), 2, 1.0, 16).alias("f")).orderBy("i").collect()])
    draw = np.random.default_rng(42)
    w, b = draw.normal(0, np.sqrt(2.0), (2, 16)), draw.uniform(0, 2 * np.pi, 16)
    assert np.allclose(got, np.sqrt(2 / 16) * np.cos(v @ w + b))


def test_features_take_no_more_memory_than_their_result():
    v = np.random.default_rng(4).normal(size=(10_000, 64))
    vs = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 64, dtype=np.int32)), pa.array(v.ravel()))
    tracemalloc.start()
    got = learning.cosines(vs, np.ones((64, 256)), np.zeros(256))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10_000 and most < 1.2 * 10_000 * 256 * 8
