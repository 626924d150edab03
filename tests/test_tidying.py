"""Readers of logs and tidying operators on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from archivolt.operators import cleaning, effects
from archivolt.sources import logs


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "a.log").write_text("Number of input reads |\t100\nUniquely mapped reads number |\t60\nNumber of reads mapped to multiple loci |\t15\nAverage input read length |  98\n")
    (tmp_path / "b.log").write_text("total reads: 50\nunique reads: 40\nSpots read : 1,234,567\n")
    (tmp_path / "c.json").write_text('{"n_targets": 7, "n_processed": 90, "n_pseudoaligned": 30,\n "n_unique": 20}')
    (tmp_path / "d.json").write_text('{"readfiles": [{"readlen": 100, "kind": "x"}, {"readlen": 90}, {"readlen": 1}]}')
    (tmp_path / "e.json").write_text("not json")
    return logs.whole_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))


def one(df, name):
    return next(r for r in df.collect() if r.path.endswith(name))


def test_logs(files):
    star = one(logs.spliced_alignment(files), "a.log")
    assert (star.reads_before, star.unique, star.multialign, star.avg_len, star.unaligned, star.too_short) == (100, 60, 15, 98, 25, None)
    assert one(logs.spliced_alignment(files), "b.log").unaligned is None
    dedup = one(logs.deduplication(files), "b.log")
    assert (dedup.reads_before, dedup.reads_after) == (50, 40) and one(logs.download(files), "b.log").starting_reads == 1234567
    pseudo = one(logs.pseudo_alignment(files), "c.json")
    assert (pseudo.targets, pseudo.aligned, pseudo.unaligned) == (7, 30, 60) and one(logs.pseudo_alignment(files), "e.json").aligned is None
    mates = one(logs.read_mates(files, {"readlen": "bigint", "kind": "string"}), "d.json")
    assert (mates.readlen1, mates.readlen2, mates.kind1, mates.kind2, mates.single_end) == (100, 90, "x", None, False)
    assert one(logs.read_mates(files, {"readlen": "bigint"}), "e.json").single_end is None


def test_outcomes_and_symbols(spark, tmp_path):
    lines = spark.createDataFrame([("r1\ta.fastq\tb.FASTQ.gz\tx\ty",), ("r2\ta.fastq\t\tz",), ("r3",)], "value string")
    assert [tuple(r) for r in logs.outcomes(lines).orderBy("run").collect()] == [("r1", "xy"), ("r2", "z"), ("r3", "")]
    (tmp_path / "c.txt").write_text("GENE-1\tabc\t1\nother\tx\nGENE-2\tabc\t2\nGENE-3\t def\n")
    assert sorted(r.symbol for r in logs.symbols(spark, str(tmp_path), "GENE-").collect()) == ["abc", "def"]


def test_vectors_last_line_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,1,2\nm,3,4\n")
    (tmp_path / "b.csv").write_text("k,5,6\n")
    assert {r.key: r.v for r in logs.vectors(spark, str(tmp_path)).collect()} == {"k": [5, 6], "m": [3, 4]}
    (tmp_path / "b.csv").write_text("k,5,x\n")
    with pytest.raises(Exception, match="not a number"):
        logs.vectors(spark, str(tmp_path)).collect()


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,NA\n-,x\n3,\n")
    df = logs.delimited(spark, str(tmp_path / "t.csv"), ["NA", "-", ""], schema="a int", parts=2)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, None), (None, "x"), (3, None)], key=str)
    n = [r.row for r in logs.numbered(df).collect()]
    assert len(set(n)) == 3


def test_columns(spark):
    df = spark.createDataFrame([(1, " ", "Unknown", "x", None)], "a int, b string, c string, d string, e string")
    assert cleaning.present(df, ["c", "z", "a"]).columns == ["c", "a"] and cleaning.without_last(df, 2).columns == ["a", "b", "c"]
    assert df.select(cleaning.coalesced([F.col("e"), F.col("b"), F.col("c"), F.col("d")]).alias("x")).first().x == "x"
    assert df.select(cleaning.coalesced([F.col("e"), F.col("b")]).alias("x")).first().x == "unknown"
    m = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0)], "r int, c int, v double")
    assert {tuple(x) for x in cleaning.oriented(m, "r", "c").select("r", "c", "v").collect()} == {(1, 1, 2.0), (2, 1, 3.0), (3, 1, 4.0)}


def test_progress_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert {r["name"]: r.n for r in cleaning.progress(df, [("x", "a"), ("y", "b")]).collect()} == {"runs_x": 0, "sum_x": 0, "dropouts_after_x": 0, "runs_y": 0, "sum_y": 0}


def test_p_values(spark):
    got = spark.createDataFrame([(0.0,), (1.959964,), (-3.0,), (8.0,)], "z double").select(effects.two_sided_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([1.0, 0.05, 0.0026997961, 1.2441921e-15], rel=2e-6)


def test_delta_falls_back_to_both_sides(spark):
    rows = [("g", 1.0, False), ("g", 1.0, False), ("g", 1.0, False), ("g", 4.0, True), ("g", 6.0, True), ("g", 8.0, True), ("g", 9.0, True), ("h", 2.0, False), ("h", 2.0, True)]
    got = {r.g: r for r in effects.glass(spark.createDataFrame(rows, "g string, v double, f boolean"), "v", "f", ["g"]).collect()}
    # no spread among the others: that of all; none at all: 1
    assert got["g"].median_diff == 6 and got["g"].scale == pytest.approx(1.4826 * 3) and got["h"].scale == 1 and got["h"].delta_star == 0
