"""Communities against a plain Louvain on planted partitions."""

import random

from archivolt.operators import communities


def planted(groups, size, inside, between, seed):
    rng = random.Random(seed)
    nodes = range(groups * size)
    return [(a, b, round(rng.uniform(0.5, 1.5), 3)) for a in nodes for b in nodes if a < b and rng.random() < (inside if a // size == b // size else between)]


def quality(edges, part, gamma):
    m2 = 2 * sum(w for *_, w in edges)
    inner, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0) + w
        if part[a] == part[b]:
            inner[part[a]] = inner.get(part[a], 0) + 2 * w
    return sum(inner.get(c, 0) / m2 - gamma * (k / m2) ** 2 for c, k in degree.items())


def louvain(edges, gamma):
    """Local moving and coarsening, one node after the other."""
    part = {x: x for a, b, _ in edges for x in (a, b)}
    links = [(a, b, w) for a, b, w in edges]
    while True:
        around, loops = {}, {}
        for a, b, w in links:
            if a == b:
                loops[a] = loops.get(a, 0) + 2 * w
            else:
                around.setdefault(a, {})[b] = around.setdefault(a, {}).get(b, 0) + w
                around.setdefault(b, {})[a] = around.setdefault(b, {}).get(a, 0) + w
        nodes = sorted({x for a, b, _ in links for x in (a, b)})
        k = {x: sum(around.get(x, {}).values()) + loops.get(x, 0) for x in nodes}
        m2, at, total = sum(k.values()), {x: x for x in nodes}, dict(k)
        moved = True
        any_moved = False
        while moved:
            moved = False
            for x in nodes:
                near = {}
                for y, w in around.get(x, {}).items():
                    near[at[y]] = near.get(at[y], 0) + w
                total[at[x]] -= k[x]
                gain = lambda c: near.get(c, 0) - gamma * k[x] * total[c] / m2  # noqa: B023, E731
                best = max(sorted({*near, at[x]}), key=lambda c: (gain(c), c == at[x]))
                if gain(best) > gain(at[x]) + 1e-12:
                    at[x], moved, any_moved = best, True, True
                total[at[x]] += k[x]
        if not any_moved:
            return part
        part = {x: at[c] for x, c in part.items()}
        joined = {}
        for a, b, w in links:
            key = (min(at[a], at[b]), max(at[a], at[b]))
            joined[key] = joined.get(key, 0) + w
        links = [(a, b, w) for (a, b), w in joined.items()]


def test_modularity_of_planted_partitions(spark, seed=1):
    edges = planted(6, 12, 0.6, 0.04, seed)
    apart = [(a + 1000, b + 1000, w) for a, b, w in planted(2, 8, 0.8, 0.1, seed)]
    every = edges + apart
    given = [*every, (5, 5, 9.0), (None, 3, 1.0), (4, None, 1.0), (2, 70, 0.0), (7, 9999, -1.0), (8, 9998, None)]
    df = spark.createDataFrame([*given, (every[0][1], every[0][0], 0.25)], "a long, b long, weight double")
    every[0] = (*every[0][:2], every[0][2] + 0.25)
    resolutions = [0.2, 1.0, 3.0]
    got = communities.found(df, resolutions).collect()
    for gamma in resolutions:
        part = {r.node: r.community for r in got if r.resolution == gamma}
        assert part.keys() == {x for a, b, _ in every for x in (a, b)}
        assert all(part[c] == c and min(x for x in part if part[x] == c) == c for c in part.values())
        assert not {c for x, c in part.items() if x < 1000} & {c for x, c in part.items() if x >= 1000}
        q = quality(every, part, gamma)
        assert {round(r.modularity, 9) for r in got if r.resolution == gamma} == {round(q, 9)}
        assert q >= quality(every, louvain(every, gamma), gamma) - 0.01
    parts = spark.createDataFrame([tuple(r) for r in got], "resolution double, node long, community long, modularity double")
    for r in communities.modularity(df.where("a <> b and weight > 0"), parts).collect():
        assert abs(r.modularity - quality(every, {x.node: x.community for x in got if x.resolution == r.resolution}, r.resolution)) < 1e-9
    one = communities.summary(parts).where("resolution = 1.0").first()
    part = {x.node: x.community for x in got if x.resolution == 1.0}
    sizes = [list(part.values()).count(c) for c in set(part.values())]
    assert (one.n_communities, one.largest, one.singles) == (len(sizes), max(sizes), sizes.count(1))


def test_communities_of_little(spark):
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert communities.found(none, [1.0]).count() == 0
    two = spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0), ("p", "q", 2.0)], "a string, b string, weight double")
    assert sorted((r.node, r.community) for r in communities.found(two).collect()) == [("p", "p"), ("q", "p"), ("x", "x"), ("y", "x")]


def test_no_table_of_nodes_is_broadcast(spark, monkeypatch):
    plans, table = [], communities.Stored.table

    def noted(self, df, label, **more):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return table(self, df, label, **more)

    monkeypatch.setattr(communities.Stored, "table", noted)
    df = spark.createDataFrame(planted(3, 8, 0.8, 0.05, 2), "a int, b int, weight double")
    assert communities.found(df).count() == 24
    assert {"sweep", "merge", "links", "nodes"} <= {label for label, _ in plans}
    assert not [label for label, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan]
