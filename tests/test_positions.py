"""Exact positions, nested records as levels, examples of tokens that others lack."""

import random

import numpy as np

from pyspark.sql import functions as F

from archivolt.operators import cleaning, ordered, positions
from archivolt.sources import logs, nested


def test_positions(spark, tmp_path):
    rng = random.Random(2)
    keys = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(k, f"x{k}") for k in keys], "k int, x string").repartition(5)
    got = positions.ordered(df, ["k"], "at").collect()
    assert sorted((r.at, r.k) for r in got) == list(enumerate(sorted(keys)))
    down = positions.ordered(df, [F.desc("k")], "at").collect()
    assert sorted((r.at, r.k) for r in down) == list(enumerate(sorted(keys, reverse=True)))
    file = tmp_path / "rows.csv"
    file.write_text("a\n" + "".join(f"v{k}\n" for k in keys))
    read = logs.numbered(logs.delimited(spark, str(file), ["NA"])).collect()
    assert sorted((r.row, r.a) for r in read) == [(i, f"v{k}") for i, k in enumerate(keys)]
    assert positions.as_read(df.limit(0), "at").count() == 0


def test_leaves(spark):
    paths = spark.createDataFrame([("r;a;x", 2), ("r;a;y", 3), ("r;b", 5), ("r;b;z", 1)], "p string, n int")
    got = {r.path: r for r in cleaning.leaves(paths, "p", "n").collect()}
    assert {k: (r.n, r.depth, r.leaves, r.is_leaf) for k, r in got.items()} == {"r": (11, 1, 3, False), "r;a": (5, 2, 2, False), "r;a;x": (2, 3, 1, True), "r;a;y": (3, 3, 1, True), "r;b": (6, 2, 1, False), "r;b;z": (1, 3, 1, True)}
    assert (got["r;b"]["from"], got["r;b"]["to"], got["r;a;y"]["from"]) == (2 / 3, 1.0, 1 / 3)


def test_tokens_of_one_table(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate("a b a a a c c b".split())] + [(0, "a")], "id int, t string")
    got = {r.t: (r.n, r.examples) for r in cleaning.only_here(rows, spark.createDataFrame([("c",)], "t string"), "t", "id").collect()}
    assert got == {"a": (4, [0, 2, 3]), "b": (2, [1, 7])}


RECORDS = """<EXPERIMENT_PACKAGE_SET>
<EXPERIMENT_PACKAGE><EXPERIMENT accession="E1" alias="e1"><TITLE>first</TITLE><DESIGN><LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>RNA-Seq</LIBRARY_STRATEGY></LIBRARY_DESCRIPTOR></DESIGN></EXPERIMENT>
<STUDY accession="S1"><DESCRIPTOR><STUDY_TITLE>one</STUDY_TITLE></DESCRIPTOR></STUDY><SAMPLE accession="M1"><SAMPLE_NAME><TAXON_ID>7955</TAXON_ID></SAMPLE_NAME><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>age</TAG><VALUE>2 dpf</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>sex</TAG></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>
<RUN_SET><RUN accession="R1" total_spots="10"><Pool><Member accession="M9"/></Pool></RUN><RUN accession="R2" total_spots="many"/></RUN_SET></EXPERIMENT_PACKAGE>
<EXPERIMENT_PACKAGE><EXPERIMENT accession="E2"/><STUDY accession="S1"><DESCRIPTOR><STUDY_TITLE>one</STUDY_TITLE></DESCRIPTOR></STUDY><SAMPLE accession="M2"/><RUN_SET><RUN accession="R3" total_spots="7"/></RUN_SET></EXPERIMENT_PACKAGE>
<EXPERIMENT_PACKAGE><EXPERIMENT accession="E3"/><STUDY accession="S2"/><RUN_SET/></EXPERIMENT_PACKAGE>
</EXPERIMENT_PACKAGE_SET>"""


def test_levels_of_nested_records(spark, tmp_path):
    file = tmp_path / "records.xml"
    file.write_text(RECORDS)
    got = {name: {r.accession: r for r in df.collect()} for name, df in nested.levels(spark, str(file)).items()}
    assert {k: set(v) for k, v in got.items()} == {"study": {"S1", "S2"}, "sample": {"M1", "M2"}, "experiment": {"E1", "E2", "E3"}, "run": {"R1", "R2", "R3"}}
    run = got["run"]
    assert [(run[r].experiment, run[r].sample, run[r].study, run[r].total_spots) for r in ("R1", "R2", "R3")] == [("E1", "M9", "S1", 10), ("E1", "M1", "S1", None), ("E2", "M2", "S1", 7)]
    assert got["sample"]["M1"].attributes == "age=2 dpf;sex=" and got["sample"]["M2"].attributes is None and got["sample"]["M1"].taxon_id == "7955"
    assert got["experiment"]["E1"].library_strategy == "RNA-Seq" and got["experiment"]["E3"].sample is None and got["study"]["S1"].title == "one"


def test_medians_and_deviations_come_from_counted_values(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, None if rng.random() < 0.1 else float(rng.randrange(40))) for g in ("a", None, "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    before, wrote = spark.conf.get("spark.sql.shuffle.partitions"), []
    written = ordered.written
    monkeypatch.setattr(ordered, "written", lambda c: wrote.append(written(c)) or wrote[-1])
    got = {r.g: (r._m, r._d) for r in ordered.medians(df, ["g"], "v").collect()}
    for g in ("a", None, "b"):
        v = np.array([x for h, x in rows if h == g and x is not None])
        assert got[g] == (np.median(v), np.median(np.abs(v - np.median(v))))
    # the values once, and their deviations, of which there are no more; not the rows again
    assert [w.count() <= 3 * 40 for w in wrote] == [True, True]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
