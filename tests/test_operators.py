import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.functions.text import arg_max, classify_stage
from archivolt.operators import matrix, ordered, relational, statistics, vectors
from archivolt.sources import text_formats


@pytest.mark.parametrize(
    "text, value, phrase",
    [
        ("larva, hfp 2.5", 2.5, "hfp"),
        ("a fish of 0.75mm, at 2.5 dfp", 2.5, "dfp"),
        ("fin of 0.75mm cut at 1.5 hour", 1.5, "hour"),
        ("seen with 4 somite pairs", 4, "somite"),
        ("taken 48 hours post-fertlilization", 48, "hours post-fertlilization"),
        ("pools of 3 days post fertilisation", 3, "days post fertilisation"),
        # the longer phrase that is nearer to its number wins over all
        ("embryos at 24 hpf, later fixed at the stage of 15 somites", 15, "somites"),
        ("2 hours post fertilization and 5 dpf", 2, "hours post fertilization"),
        ("no stage at all", None, None),
        ("hpf without a number", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_stage(text, value, phrase):
    assert classify_stage(text) == (value, phrase)


def test_misspelt_somites():
    assert classify_stage("5 somitse stage")[0] == 5


def test_absent_cells_are_zeros(spark):
    rng = random.Random(1)
    dense = {(s, g): float(rng.randrange(1, 9)) if rng.random() < 0.3 else 0.0 for s in range(8) for g in range(30)}
    m = spark.createDataFrame([(s, g, v) for (s, g), v in dense.items() if v], "sample int, gene int, value double")
    x = np.array([[dense[s, g] for g in range(30)] for s in range(8)])[:, [any(dense[s, g] for s in range(8)) for g in range(30)]]
    genes = [g for g in range(30) if any(dense[s, g] for s in range(8))]
    for by, axis in (("gene", 0), ("sample", 1)):
        z = (x - x.mean(axis=axis, keepdims=True)) / x.std(axis=axis, keepdims=True)
        for r in matrix.zscore(m, by).collect():
            assert r.z == pytest.approx(z[r["sample"], genes.index(r.gene)])
    c = np.corrcoef(x)
    ranks = np.corrcoef([[(row < v).sum() + (row == v).sum() / 2 for v in row] for row in x])
    for want, got in ((c, matrix.correlation(m)), (ranks, matrix.correlation(matrix.rank_values(m)))):
        assert all(r.r == pytest.approx(want[r.a, r.b]) for r in got.collect()) and got.count() > 20
    for r in matrix.correlation(m, "gene").collect():
        assert r.r == pytest.approx(np.corrcoef(x.T)[genes.index(r.a), genes.index(r.b)])
    for r in matrix.upper_quartiles(m).collect():
        assert r.q == pytest.approx(np.quantile(x[r["sample"]], 0.75))


def test_null_keys_match_only_where_asked(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "i int, k string"), spark.createDataFrame([(None,), ("x",)], "k string")
    assert {r.i for r in relational.null_safe(a, b, ["k"]).collect()} == {1, 2}
    assert {r.i for r in a.join(b, "k").collect()} == {2}


def test_first_of_equals(spark):
    df = spark.createDataFrame([(3, 3, 1), (0, 0, 0)], "a int, b int, c int")
    assert [r.n for r in df.select(arg_max([("b", F.col("b")), ("a", F.col("a")), ("c", F.col("c"))]).alias("n")).collect()] == ["b", "unknown"]


def test_cpm_adds_up_and_empty_sample(spark):
    m = spark.createDataFrame([(1, 1, 3.0), (1, 2, 7.0), (2, 1, 0.0)], "sample int, gene int, value double")
    got = {r["sample"]: r["s"] for r in matrix.cpm(m).groupBy("sample").agg(F.sum("cpm").alias("s")).collect()}
    assert got[1] == pytest.approx(1e6) and got[2] == 0


def test_factors_have_geometric_mean_one(spark):
    m = spark.createDataFrame([(s, g, float((s * 7 + g * 13) % 31 + 1)) for s in range(5) for g in range(60)], "sample int, gene int, value double")
    logs = matrix.tmm_factors(m).select(F.sum(F.log("factor")).alias("s")).first().s
    assert logs == pytest.approx(0, abs=1e-9)


def test_dominance_is_symmetric(spark):
    df = spark.createDataFrame([("g", float(v), v % 3 == 0) for v in (1, 2, 2, 3, 5, 6, 6, 9)], "g string, v double, f boolean")
    a = statistics.dominance(df, "v", "f", ["g"]).first().a
    b = statistics.dominance(df.withColumn("f", ~F.col("f")), "v", "f", ["g"]).first().a
    assert 0 <= a <= 1 and a + b == pytest.approx(1)


def test_unit_of_nothing(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, e array<float>")
    assert {r.id: r.v for r in vectors.units(df, "id", "e").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_annotation_genes(spark):
    lines = ["#!x", 'c\ts\tgene\t1\t2\t.\t+\t.\tgene_id "G1"; gene_name "abc"; gene_biotype "miRNA";', 'c\ts\texon\t1\t2\t.\t+\t.\tgene_id "G1";', 'c\ts\tgene\t1\t2\t.\t+\t.\tgene_id "G2";']
    got = text_formats.annotation_genes(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([("G1", "abc", "miRNA"), ("G2", None, None)], key=str) or {r.gene_id for r in got} == {"G1", "G2"}


def test_log_numbers(spark):
    df = spark.createDataFrame([("reads: 1,234\n",), ("none",)], "t string").select(*text_formats.log_numbers(F.col("t"), {"n": r"reads: ([\d,]+)"}))
    assert [r.n for r in df.collect()] == [1234, None]


def test_stream_gives_the_batch_rows(spark, tmp_path):
    from archivolt.streaming import events

    spark.createDataFrame([(1, "a", 2.0), (1, "a", 9.0), (2, "b", 3.0)], "id int, k string, v double").selectExpr("*", "timestamp'2024-01-01 00:10:00' as ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.rows(spark, str(tmp_path / "in"), "id int, k string, v double, ts timestamp")
    q = events.first_of_each(stream, "ts", ["id"]).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.sql("SELECT id FROM firsts").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    from archivolt.sources import sinks, tables

    df = spark.createDataFrame([("b", "y"), ("a", "x"), ("a", "w")], "k string, m string")
    sinks.delimited(df, str(tmp_path / "t"), gzip=True)
    assert sorted(map(tuple, tables.delimited(spark, str(tmp_path / "t"), "k string, m string").collect())) == sorted(map(tuple, df.collect()))
    assert sorted(r.value for r in sinks.members(df, "k", "m").collect()) == ['{"key":"a","members":["w","x"]}', '{"key":"b","members":["y"]}']


def test_rates_do_not_fall(spark):
    from archivolt.operators import inference

    df = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.5, 0.04])], "g string, i int, p double")
    got = [r.fdr for r in inference.adjusted(df, "p", ["g"], ["i"]).orderBy("p", "i").collect()]
    assert got == sorted(got) and got[-1] == 0.5 and got[0] == pytest.approx(0.02 * 5 / 3)


def test_all_members_drawn(spark):
    from archivolt.operators import inference

    df = spark.createDataFrame([(2, 2, 2, 4), (0, 2, 2, 4)], "k int, t int, d int, n int")
    assert [r.p for r in df.select(inference.hypergeometric(*(F.col(c) for c in "ktdn")).alias("p")).collect()] == pytest.approx([1 / 6, 1.0])


def test_pieces_find_what_a_full_search_finds():
    import regex

    from archivolt.functions.text import PHRASES, approximate

    texts = ("at 3 days post fertlisation, or days post fertilisation", "hours only, or huors", "x" * 500 + " 48 hours pst fertilizaton " + "y" * 500, "some tes, somitse", "")
    for text in texts:
        for pattern, edits, plain in PHRASES:
            full, got = regex.search(rf"(?b)(?:{pattern}){{e<={edits}}}", text), approximate(pattern, edits, plain, text)
            assert (full is None) == (got is None)
            if full:
                again = regex.fullmatch(rf"(?b)\s*(?:{pattern}){{e<={edits}}}\s*", got)
                assert sum(again.fuzzy_counts) <= sum(full.fuzzy_counts)


def test_edges_of_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 5, 8)] + [(None,)], "v double")
    assert relational.edges(df, "v", "even", 4) == [0, 2, 4, 6, 8] and relational.edges(df, "v", "values", 5) == [0, 1, 2, 5, 8]
    assert relational.edges(df, "v", "quantile", 2) == [0, 1.5, 8] and relational.edges(df.where("v > 9"), "v", "even") == []
    with pytest.raises(ValueError, match="more than 3"):
        relational.edges(df, "v", "values", 3)
    got = [(r.bin, r.n) for r in relational.bins(df, "v", [0, 1, 2, 8]).orderBy("bin").collect()]
    assert got == [(1, 3), (2, 1), (3, 2)]


@pytest.mark.parametrize("most", [1 << 20, 9, 1])
def test_quantiles_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "MOST", most)
    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.randrange(8), rng.random() * 100])) for g in ("a", "b", None) for _ in range(200)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.93}).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g, r in got.items():
        mine = [v for h, v in rows if h == g and v is not None]
        assert (r.low, r.mid, r.high) == pytest.approx(tuple(np.quantile(mine, [0.1, 0.5, 0.93])))
    every = [v for _, v in rows if v is not None]
    assert tuple(ordered.quantiles(df, [], "v", {"low": 0.2, "high": 0.7}).first()) == pytest.approx(tuple(np.quantile(every, [0.2, 0.7])))
    sums = ordered.running(ordered.counted(df.where("g = 'a'"), ["g"], "v"), ["g"], "v", ["n"]).orderBy("v").collect()
    below = 0
    for k, r in enumerate(sums):
        assert r.before_n == below and r.next == (sums[k + 1].v if k + 1 < len(sums) else None)
        below += r.n
    assert all(r.total_n == below for r in sums)


def test_correlation_in_bands(spark, monkeypatch):
    """Many bands, a few products at a time, names as ids; no pair of cells is shuffled."""
    monkeypatch.setattr(matrix, "PRODUCTS", 40)
    rng = random.Random(4)
    cells = [(f"s{s}", f"g{g}", float(rng.randrange(1, 9))) for s in range(25) for g in range(40) if rng.random() < 0.2]
    # a row of which the gene is null counts for its sample, one without a sample for the genes
    m = spark.createDataFrame([*cells, ("s1", None, 3.0), (None, "alone", 2.0)], "sample string, gene string, value double").repartition(5)
    r = matrix.correlation(m)
    assert "Join" not in "".join(x for x in r._jdf.queryExecution().optimizedPlan().toString().split("\n")[:2])
    got = {(x.a, x.b): (x.r, x.n) for x in r.collect()}
    genes, samples = sorted({g for _, g, _ in cells}), sorted({s for s, _, _ in cells})
    x = np.zeros((len(samples), len(genes) + 1))
    for s, g, v in cells:
        x[samples.index(s), genes.index(g)] = v
    total, square, n = x.sum(1), (x * x).sum(1), x.shape[1]
    total[samples.index("s1")] += 3
    square[samples.index("s1")] += 9
    want = {}
    for i, a in enumerate(samples):
        for j, b in enumerate(samples):
            both = int(((x[i] > 0) & (x[j] > 0)).sum())
            if a < b and both:
                want[a, b] = ((x[i] @ x[j] - total[i] * total[j] / n) / np.sqrt((square[i] - total[i] ** 2 / n) * (square[j] - total[j] ** 2 / n)), both)
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(r) and got[k][1] == c for k, (r, c) in want.items())


def test_correlation_sends_bands_and_no_cells(spark, monkeypatch):
    """Bands of few cells, two beside each; flat and zero cells stay; what is dealt to the
    tasks is a row for each pair of bands, though all bands share genes."""
    monkeypatch.setattr(matrix, "CELLS", 60)
    monkeypatch.setattr(matrix, "BESIDE", 2)
    rng = random.Random(14)
    cells = {(s, g): float(rng.randrange(0, 5)) for s in range(40) for g in range(50) if rng.random() < 0.25} | {(40, g): 2.0 for g in range(50)}
    df = spark.createDataFrame([(s, g, v) for (s, g), v in cells.items()], "sample int, gene long, value double").repartition(3)
    r = matrix.correlation(df)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "at#" in plan and "gene#" not in plan  # packed, no cells by gene
    got = {(x.a, x.b): (x.r, x.n) for x in r.collect()}
    x, there = np.zeros((41, 50)), np.zeros((41, 50), int)
    for (s, g), v in cells.items():
        x[s, g], there[s, g] = v, 1
    both = there @ there.T
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x)
    assert set(got) == {(a, b) for a in range(41) for b in range(a + 1, 41) if both[a, b]}
    for (a, b), (v, n) in got.items():
        assert n == both[a, b] and (v is None if 40 in (a, b) else v == pytest.approx(want[a, b], abs=1e-9))


def test_ranks_are_packed_exactly(spark, monkeypatch):
    """Halves, whole and other numbers keep their values; rank correlations over bands of few
    cells are those of the whole matrix."""
    from archivolt.operators import correlated

    for x, size in (([1.0, 200.0], 1), ([70_000.0, 3.0], 4), ([2.5, 8.5], 4), ([0.1, 1e300], 8), ([float("nan"), -1.0], 8)):
        got = correlated.slim(np.array(x))
        assert got.itemsize == size and np.array_equal(got.astype(float), x, equal_nan=True)
    monkeypatch.setattr(matrix, "CELLS", 40)
    rng = random.Random(15)
    x = np.array([[float(rng.randrange(1, 5)) if rng.random() < 0.3 else 0.0 for _ in range(30)] for _ in range(20)])
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in zip(*(c.tolist() for c in np.nonzero(x)), strict=True)], "sample int, gene int, value double")
    used = x[:, x.any(axis=0)]
    want = np.corrcoef([[(row < v).sum() + (row == v).sum() / 2 for v in row] for row in used])
    got = matrix.correlation(matrix.rank_values(m)).collect()
    assert len(got) == sum(bool(((x[a] > 0) & (x[b] > 0)).any()) for a in range(20) for b in range(a + 1, 20))
    assert all(r.r == pytest.approx(want[r.a, r.b]) for r in got)


def test_fences_and_grid_without_whole_groups(spark, monkeypatch):
    """Fences from parts of a group, null groups and groups without a value; one order of
    the rows gives the median of both sides together."""
    from archivolt.operators import effects, learning

    rng = random.Random(9)
    rows = [(g, float(rng.randrange(50)), rng.random() < 0.7) for g in ("a", None) for _ in range(400)] + [("none", None, True)]
    df = spark.createDataFrame(rows, "g string, v double, f boolean").repartition(3)
    monkeypatch.setattr(ordered, "MOST", 16)
    tail, skew = learning.tail_fence(df, "v", ["g"]), learning.skew_fences(df.where("v is not null"), "v", ["g"])
    for made in (tail, skew):
        assert " percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert {r.g: r.upper is None for r in made.collect()} == {"a": False, None: False} | ({"none": True} if made is tail else {})
    q = np.quantile([v for g, v, _ in rows if g == "a"], [0.25, 0.75])
    plain = {r.g: r for r in skew.collect()}["a"]
    assert plain.lower <= q[0] and plain.upper >= q[1]
    calls = []
    real = ordered.running
    monkeypatch.setattr(effects, "running", lambda *x: calls.append(x) or real(*x))
    same = df.where("g = 'a'").withColumn("v", F.when(F.col("f"), F.col("v")).otherwise(5.0))
    got = effects.compared(same, "v", "f", ["g"]).first()
    every = np.array([v if f else 5.0 for g, v, f in rows if g == "a"])
    assert got.scale == pytest.approx(1.4826 * np.median(np.abs(every - np.median(every)))) and len(calls) == 3


def test_robust_scaled_within_quantiles_is_winsorised_first(spark):
    rows = [(g, k, v) for g, values in (("a", [1.0, 2.0, 2.0, 3.0, 50.0, -9.0]), (None, [5.0, 5.0, 5.0, 5.0, 5.0, 9.0]), ("flat", [4.0, 4.0, 4.0]), ("one", [4.0])) for k, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("a", 9, None)], "g string, k int, v double")
    got = {(r.g, r.k): r.v for r in statistics.robust_scaled(df, "v", ["g"], within=(0.05, 0.95)).collect()}
    want = {}
    for g in ("a", None):
        v = np.array([x for h, _, x in rows if h == g])
        v = np.clip(v, np.quantile(v, 0.05), np.quantile(v, 0.95))
        mad = 1.4826 * np.median(np.abs(v - np.median(v)))
        want |= {(g, k): (x - np.median(v)) / (mad if mad > 1e-12 else np.std(v, ddof=1)) for k, x in enumerate(v)}
    assert got.pop(("a", 9)) is None
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stages_come_from_an_arrow_batch_without_a_copy(spark):
    import pyarrow as pa

    from archivolt.functions import text

    got = text._stages(pa.array(["collected at 24 hpf", None, "no number"]))
    assert got.to_pylist() == [{"value": 24.0, "phrase": "hpf"}, {"value": None, "phrase": None}, {"value": None, "phrase": None}]
