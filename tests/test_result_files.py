"""Readers of result files against small files."""

from pyspark.sql import functions as F

from archivolt.sources import result_files


def test_wide_matrix(spark, tmp_path):
    path = str(tmp_path / "m.tsv")
    (tmp_path / "m.tsv").write_text("gene\ta\tb\tc\ng1\t1\t0\tx\ng2\t\t2.5\t3\ng3\t4\n")
    assert result_files.header(spark, path) == ["gene", "a", "b", "c"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(result_files.wide_matrix(spark, path)) == [("g1", "a", 1.0), ("g2", "b", 2.5), ("g2", "c", 3.0), ("g3", "a", 4.0)]
    assert rows(result_files.wide_matrix(spark, path, ["b"], zeros=True)) == [("g1", "b", 0.0), ("g2", "b", 2.5)]
    assert rows(result_files.wide_matrix(spark, path, ["z"])) == []


def test_key_values(spark):
    lines = spark.createDataFrame([("reads : 12",), ("no mark",), ("url: http://x",), (None,)], "value string")
    assert sorted(tuple(r) for r in result_files.key_values(lines).collect()) == [("reads", "12"), ("url", "http://x")]


def test_paths(spark):
    df = spark.createDataFrame([("s3://b/x/run1/seed2/m.json",), ("m.json",)], "path string")
    got = [tuple(r) for r in df.select(*result_files.path_parts(F.col("path"), ["run", "seed"])).collect()]
    assert got == [("run1", "seed2"), (None, None)]
    work = spark.createDataFrame([("/w/ab/123456ff/out.txt",), ("/w/ab/123456ee/.cmd",), ("/w/other/out.txt",)], "path string")
    assert [tuple(r) for r in result_files.folders(work, "path").collect()] == [("ab/123456", "/w/ab/123456ee")]


def test_logs_and_samples(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.log").write_bytes(b"trial 1 f1=0.5\nbad \xff line\ntrial 2 f1=0.75\ntrial 3 f1=0.75\n")
    (tmp_path / "b.log").write_text("nothing\n")
    (row,) = result_files.best_trials(spark, str(tmp_path), r"f1=([0-9.]+)").collect()
    assert row.path.endswith("one/a.log") and row.line == "trial 2 f1=0.75" and row.metric == 0.75
    assert result_files.listed(spark, str(tmp_path), "*.log").count() == 2
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted(tuple(r) for r in result_files.combined({"a": a, "b": b}).select("x", "sample").collect()) == [(1, "a"), (3, "b")]


def test_graphml(spark):
    from xml.etree import ElementTree

    from archivolt.sources import sinks

    nodes, edges = spark.createDataFrame([("b<",), ("a&",)], "id string"), spark.createDataFrame([("a&", "b<", 0.5)], "a string, b string, weight double")
    lines = [r.value for r in sinks.graphml(nodes, edges).collect()]
    tree = ElementTree.fromstring("".join(lines))
    name = lambda t: "{http://graphml.graphdrawing.org/xmlns}" + t
    assert [n.get("id") for n in tree.iter(name("node"))] == ["a&", "b<"]
    assert [(x.get("source"), x.get("target"), x[0].text) for x in tree.iter(name("edge"))] == [("a&", "b<", "0.5")]


def test_cluster_and_metric_files(spark, tmp_path):
    for name, text in (("leiden_clusters_0.5.csv", ",leiden\ng1,3\ng2,\n,4\n"), ("Leiden_Clusters_10.CSV", ",leiden\ng1, 0 \n"), ("other_2.csv", ",x\ng9,1\n")):
        (tmp_path / name).write_text(text)
    got = sorted(tuple(r) for r in result_files.cluster_files(spark, str(tmp_path)).collect())
    assert got == [(0.5, "3", "g1"), (10.0, "0", "g1")]
    assert [tuple(r) for r in result_files.cluster_files(spark, str(tmp_path), [10]).collect()] == [(10.0, "0", "g1")]
    for run, seed, f1 in (("a", "1", 0.5), ("a", "2", 0.75), ("b", "1", 0.25)):
        folder = tmp_path / "scan" / run / seed
        folder.mkdir(parents=True)
        (folder / "metrics.csv").write_text(f"split,f1\ntest,{f1}\n")
    rows = result_files.result_metrics(spark, str(tmp_path / "scan"), ["run", "seed"], "metrics.csv", "split string, f1 double")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "1", "test", 0.5), ("a", "2", "test", 0.75), ("b", "1", "test", 0.25)]
