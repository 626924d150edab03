"""Intervals against numpy on the rows as often as each draw counts them."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from archivolt.operators import effects, resampled


def plain(rows, draws, trim=0.2, threshold=0.0, steps=9):
    """effect: values in all slots, of (value, flag, hash) rows of one group."""
    v, f = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = resampled.weights(np.array([r[2] for r in rows]), draws)
    off = np.median(v[~f])
    pooled_off = np.median(v)
    out = {}
    for s in range(draws + 1):
        x, y, every = (np.repeat(u, w[on, s]) for u, on in ((v[f], f), (v[~f], ~f), (v, np.ones(len(v), bool))))
        add = lambda name, z: out.setdefault(name, []).append(z)
        med = np.median(x) - np.median(y) if len(x) and len(y) else np.nan

        def trimmed(z):
            cut = int(len(z) * trim)
            return np.sort(z)[cut : len(z) - cut].mean() if len(z) else np.nan

        mad, pooled = 1.4826 * np.median(np.abs(y - off)) if len(y) else np.nan, 1.4826 * np.median(np.abs(every - pooled_off))
        a = (np.sign(x[:, None] - y[None, :]).mean() + 1) / 2 if len(x) and len(y) else np.nan
        grid = np.unique(v)
        gap = [abs(np.mean(x <= g) - np.mean(y <= g)) for g in grid[:-1]] if len(x) and len(y) else np.nan
        add("median_diff", med)
        add("trimmed_diff", trimmed(x) - trimmed(y))
        add("mad_control", mad)
        add("delta_star", med / (mad if mad > 1e-12 else pooled if pooled > 1e-12 else 1.0))
        add("a", a)
        add("delta", 2 * a - 1)
        add("wasserstein", np.sum(np.array(gap) * np.diff(grid)))
        for k in range(1, steps + 1):
            add(f"shift_{k}", np.quantile(x, k / (steps + 1)) - np.quantile(y, k / (steps + 1)) if len(x) and len(y) else np.nan)
        add("rate_diff", np.mean(x > threshold) - np.mean(y > threshold) if len(x) and len(y) else np.nan)
        px, py = x[x > threshold], y[y > threshold]
        add("positive_median_diff", np.median(px) - np.median(py) if len(px) and len(py) else np.nan)
    return {k: np.array(z) for k, z in out.items()}


def test_intervals(spark):
    rng = random.Random(8)
    rows = []
    for g, n in (("many", 400), ("few", 30), (None, 60), ("flat", 40), ("one side", 5)):
        for _ in range(n):
            flag = g != "one side" and rng.random() < 0.4
            value = 2.0 if g == "flat" else rng.choice([0.0, 0.0, round(rng.gauss(1 + flag, 1.5), 2), -1.0])
            rows.append((len(rows), g, 1 if g == "few" else 2, value, flag))
    rows += [(9000, "many", 2, None, True), (9001, "many", 2, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, g string, h int, x double, f boolean").repartition(3)
    draws = 25
    got = {}
    for r in resampled.intervals(df, "id", "x", "f", ["g", "h"], draws).collect():
        got.setdefault((r.g, r.h), {})[r.effect] = (r.point, r.low, r.high)
    hashes = {r.id: r.k for r in df.selectExpr("id", "xxhash64(id) AS k").collect()}
    assert got.keys() == {("many", 2), ("few", 1), (None, 2), ("flat", 2)}
    for (g, h), effects in got.items():
        want = plain([(x, f, hashes[i]) for i, gg, hh, x, f in rows if (gg, hh) == (g, h) and x is not None and f is not None], draws)
        assert effects.keys() == want.keys()
        for name, z in want.items():
            drawn = z[1:][np.isfinite(z[1:])]
            expected = (z[0], *(np.quantile(drawn, [0.025, 0.975]) if len(drawn) else (np.nan, np.nan)))
            assert np.allclose([np.nan if v is None else v for v in effects[name]], expected, atol=1e-9, equal_nan=True), (g, name)


def test_weights_are_poisson():
    w = resampled.weights(np.arange(20_000), 9)[:, 1:].astype(float)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w.T)[0, 1]) < 0.03
    assert (resampled.weights(np.arange(5), 9)[:, :4] == resampled.weights(np.arange(5), 3)).all()


def test_part_is_added_up_by_blocks(monkeypatch):
    """A part's numbers don't depend on how many values are held at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, draws = 500, 9
    v, f, h = rng.integers(0, 120, n).astype(float), rng.random(n) < 0.4, rng.integers(-(1 << 60), 1 << 60, n)
    runs = list(resampled.added(h[:20], np.array([8, 12]), draws))
    assert (runs[0] == resampled.weights(h[:8], draws).sum(0)).all() and (runs[1] == resampled.weights(h[8:20], draws).sum(0)).all()
    w = [None] * (n - 1) + [runs[0].tobytes()]
    t = pa.table({"_v": v, "_f": f, "_h": h, "_w": pa.array(w, pa.binary())})
    layout = resampled.Layout(draws, [0.3, 0.5], 0.2, 40.0, True)
    total, before = layout.totals(t), np.zeros((4, draws + 1), np.int64)
    made, held = [], []
    real = resampled.matrix
    monkeypatch.setattr(resampled, "matrix", lambda *x: held.append(real(*x)) or held[-1])
    for size in (10_000, 7):
        held.clear()
        monkeypatch.setattr(resampled, "VALUES", size)
        made.append(layout.numbers(t, before, total, None))
        assert max(len(x[0]) for x in held) <= size
    assert np.allclose(*made)


def test_balanced_draws_order_only_rows_at_the_border(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("g").alias("g"), (F.col("id") % 3 == 0).alias("side"), F.lit(1000).alias("_m"))
    for digits in (1, 3):
        got = effects.least_mixed(df, "k", "side", ["g", "draw"], 2, digits).select("draw", "side", "k").collect()
        for draw in (1, 2):
            order = sorted((k for k in range(3000) if k % 3), key=lambda k: (hashlib.md5(f"{k}:{draw}".encode()).hexdigest(), k))
            assert sorted(r.k for r in got if r.draw == draw and not r.side) == sorted(order[:1000])
            assert sorted(r.k for r in got if r.draw == draw and r.side) == list(range(0, 3000, 3))
