"""Resampling, communities and classifiers on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import graph, inference, vectors


def test_bootstrap_interval_holds_the_difference(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "g", float(rng.normal(5 if k % 2 else 2)), bool(k % 2)) for k in range(600)]
    r = inference.bootstrap(spark.createDataFrame(rows, "k int, g string, v double, f boolean"), "k", "v", "f", "g").first()
    d = np.mean([v for _, _, v, f in rows if f]) - np.mean([v for _, _, v, f in rows if not f])
    assert r.low < d < r.high and 0.2 < r.high - r.low < 0.5 and r.mean == pytest.approx(d, abs=0.05)


def plain_labels(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    now, seen = {n: n for n in near}, []
    while True:
        new = {}
        for n, around in near.items():
            votes = {now[n]: 1e-6}
            for m, w in around:
                votes[now[m]] = votes.get(now[m], 0) + w
            new[n] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        if new in seen:
            return new
        seen.append(new)
        now = new


def test_communities_settle(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10, 0.1), (20, 21, 1.0)]
    got = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(edges, "a int, b int, weight double")).collect()}
    assert got == plain_labels(edges) and len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(10, 14)}) == 1


def test_machines_tell_classes_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, [float(x) for x in rng.normal(0, 0.3, 3) + 3 * np.eye(3)[k % 3]]) for k in range(150)]
    df = inference.split(spark.createDataFrame(rows, "id int, label int, v array<double>"), "id", "label")
    two = inference.linear_svm(df, "v", F.col("label") == 0).collect()
    many = inference.linear_svm(df, "v", F.col("label"), several=True).collect()
    assert sum(r.n for r in two) == 30 and all(r.y == r.prediction for r in two) and all(r.y == r.prediction for r in many) and len(many) == 3


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[11] = x[12]
    u = vectors.units(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "k long, v array<double>").repartition(3), "k", "v")
    got = {(r.id, r["rank"]): (r.other, r.similarity) for r in vectors.neighbours(u, u.where("id % 20 = 0"), 4).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(n @ n[q], 6)
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-s[j], j))[:4]
        assert [got[q, k][0] for k in range(1, 5)] == order and got[q, 1][1] == pytest.approx(s[order[0]])
    assert len(got) == 12


def test_edges_over_a_percentile(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, -0.8), (2, 3, 0.1), (3, 4, 0.2)], "id int, other int, similarity double")
    assert {(r.a, r.b) for r in graph.percentile_layer(near, "x", 0.5).collect()} == {(1, 2), (1, 3)} == {(r.a, r.b) for r in graph.percentile_layer(near, "x", 50).collect()}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError, match="share"):
        graph.cut(type("D", (), {"sparkSession": Session()})())


def test_nearest_prunes_without_loss():
    """Ties over the border of blocks, a row twice, vectors that aren't numbers."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(9_000, 3)), 1)
    x[5_000:] = x[:4_000]
    x[7] = np.nan
    ids = rng.permutation(9_000)
    q = np.arange(0, 9_000, 450)
    got = vectors.nearest(ids[q], x[q], ids, x, 6)
    for i in q:
        s = np.round(x @ x[i], 6)
        want = sorted((-s[j], ids[j]) for j in range(9_000) if j != i and s[j] == s[j])[:6]
        assert [(-v, o) for a, o, v in zip(*got, strict=True) if a == ids[i]] == want


def test_unit_length_is_one_expression(spark):
    """The length isn't added up again for each component."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "k int, v array<double>")
    assert {r.id: r.v for r in vectors.units(df, "k", "v").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [None, None]}
    assert vectors.units(df, "k", "v")._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
