"""Tiled correlations against dense numpy; sketches merged in any order."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivolt.operators import correlated, sketches
from archivolt.operators.stored import Stored


@pytest.mark.parametrize(("band", "cells"), [(1000, 1000), (7, 1000), (7, 40)])
def test_tiles_equal_dense(spark, band, cells):
    rng = random.Random(3)
    cells_of = {(f"s{s}", f"g{g}"): float(rng.randrange(1, 9)) for s in range(13) for g in range(30) if rng.random() < 0.25}
    cells_of |= {(f"s{s}", "flat") : 2.0 for s in range(13)}
    rows = [(s, g, v) for (s, g), v in cells_of.items()] + [("s1", None, 1.0), (None, "g1", 1.0), ("s1", "g2", None), ("s0", "flat", 0.0)]
    m = spark.createDataFrame(rows, "sample string, gene string, value double")
    genes, samples = sorted({g for _, g in cells_of}), sorted({s for s, _ in cells_of})
    x = np.zeros((len(genes), len(samples)))
    for (s, g), v in cells_of.items():
        x[genes.index(g), samples.index(s)] = v
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x)
    got = {(r.a, r.b): r.r for r in correlated.tiles(m, "gene", None, band, cells).collect()}
    assert len(got) == len(genes) * (len(genes) - 1) // 2
    for (a, b), r in got.items():
        w = want[genes.index(a), genes.index(b)]
        assert a < b and (r is None and "flat" in (a, b) or abs(r - w) < 1e-9)
    best = {}
    for r in correlated.strongest(m, 3, "gene", 0.0, band, cells).collect():
        best.setdefault(r.id, []).append((r.rank, r.other))
    for i, g in enumerate(genes):
        if g != "flat":
            near = sorted(((-abs(round(want[i, j], 6)), h) for j, h in enumerate(genes) if j != i and h != "flat"))[:3]
            assert [o for _, o in sorted(best[g])] == [h for _, h in near]
    assert "flat" not in best


def test_strongest_over_blocks_without_a_shared_column(spark):
    rng = random.Random(5)
    # the first block is full, so that its rows' least sums beside other blocks matter
    cells_of = {(s + 20 * block, g + 12 * block): float(rng.randrange(1, 9)) for block in range(4) for s in range(20) for g in range(12) if rng.random() < (0.7, 0.15, 0.1, 0.08)[block]}
    m = spark.createDataFrame([(s, g, v) for (s, g), v in cells_of.items()], "sample long, gene long, value double")
    genes, samples = sorted({g for _, g in cells_of}), sorted({s for s, _ in cells_of})
    x = np.zeros((len(genes), len(samples)))
    for (s, g), v in cells_of.items():
        x[genes.index(g), samples.index(s)] = v
    want = np.corrcoef(x)
    best = {}
    for r in correlated.strongest(m, 4, "gene", 0.0, 6).collect():
        best.setdefault(r.id, []).append((r.rank, r.other))
    for i, g in enumerate(genes):
        near = sorted((-np.floor(abs(want[i, j]) * 1e6 + 0.5), h) for j, h in enumerate(genes) if j != i)[:4]
        assert [o for _, o in sorted(best[g])] == [h for _, h in near]


def test_cells_only_go_to_bands_with_their_column(spark):
    # eight bands of ten rows; two neighbours share a column each
    cells = spark.range(80).select(F.col("id").alias("row"), F.explode(F.array(F.floor(F.col("id") / 10), F.floor(F.col("id") / 10) + 1)).alias("col"), F.lit(1.0).alias("v"), F.floor(F.col("id") / 10).cast("int").alias("_b"))
    every, seen = correlated.dealt(cells, Stored(spark))
    assert {tuple(r) for r in seen.collect()} == {(b, o) for b in range(8) for o in (b, b + 1) if o < 8}
    assert every.count() == 2 * 160 - 20  # all cells were in all bands' tiles before: 8 * 160


def test_bands_that_all_share_columns_are_sent_packed(spark):
    """Few of many pairs share a column, of any band: the same partners as of the whole
    matrix, and a band goes out as one row of a few bytes a cell."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random((60, 400)) < 0.02, rng.integers(1, 9, (60, 400)), 0).astype(float)
    x[:, 0] = np.maximum(x[:, 0], rng.integers(0, 2, 60) * 9)  # shared by half of the rows
    m = spark.createDataFrame([(int(s), int(g), float(x[g, s])) for g, s in zip(*np.nonzero(x), strict=True)], "sample long, gene long, value double")
    used = x[:, x.any(axis=0)]
    want, kept = np.corrcoef(used), [g for g in range(60) if used[g].any()]
    best = {}
    for r in correlated.strongest(m, 3, "gene", 0.0, 10).collect():
        best.setdefault(r.id, []).append((r.rank, r.other, r.r))
    assert sorted(best) == kept
    for g in kept:
        near = sorted((-np.floor(abs(want[g, j]) * 1e6 + 0.5), j) for j in kept if j != g)[:3]
        assert [o for _, o, _ in sorted(best[g])] == [j for _, j in near]
        assert all(abs(r - want[g, o]) < 2e-6 for _, o, r in best[g])
    row = rng.integers(0, 500, 20_000)
    t = pa.table({"_b": pa.array(np.full(20_000, 3), pa.int32()), "row": row, "_x": rng.integers(0, 300, 20_000), "v": rng.integers(1, 50, 20_000).astype(float)})
    got = correlated.packed(t, 300.0)
    assert got.num_rows == 1 and got.nbytes < 6 * 20_000
    band = correlated.Band({c: got.column(c)[0] for c in got.column_names})
    assert band.v.sum() == t.column("v").to_numpy().sum() and np.array_equal(np.bincount(band.at, band.v), np.bincount(row, t.column("v").to_numpy()))


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(1)
    rows = [(g, k % 7, rng.choice([0.0, None, float("nan"), rng.gauss(5, 2)])) for g, n in (("a", 30_000), ("b", 300), ("c", 3)) for k in range(n)]
    rows += [("zeros", 1, 0.0)]
    df = spark.createDataFrame(rows, "g string, batch int, v double")
    parts = sketches.digests(df, ["g", "batch"], "v").cache()
    few = sketches.merged(parts.where("batch < 3"), ["g"]).unionByName(sketches.merged(parts.where("batch >= 3"), ["g"]))
    for held in (parts, parts.orderBy(F.desc("batch")), few):
        got = {r.g: r for r in sketches.medians(held, ["g"]).collect()}
        assert got.keys() == {"a", "b", "c"} - ({"c"} - got.keys())
        for g, r in got.items():
            values = np.array([v for h, _, v in rows if h == g and v is not None and v == v and v != 0])
            assert r.n == len(values)
            assert np.mean(values < r.median) - sketches.rank_error() <= 0.5 <= np.mean(values <= r.median) + sketches.rank_error()


def test_values_meet_all_estimates_once(spark):
    df = spark.createDataFrame([(g, float(k)) for g in ("a", None) for k in range(1, 101)] + [("a", 0.0), ("a", None)], "g string, v double")
    found = spark.createDataFrame([("a", 26.0, 50.5), (None, 1.0, 100.0)], "g string, lower double, median double")
    checked = sketches.ranks(df, found, ["g"], "v", ["lower", "median"])
    got = {r.g: (r.below_lower, r.upto_lower, r.below_median, r.upto_median) for r in checked.collect()}
    assert got == {"a": (0.25, 0.26, 0.5, 0.5), None: (0.0, 0.01, 0.99, 1.0)}
