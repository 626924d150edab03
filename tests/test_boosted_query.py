"""boosted_trees takes the whole table."""

from archivolt.plans import learning

SF = "/root/testdata/sf0.001"


def test_boosted_trees_takes_all_rows_and_classes(spark, monkeypatch):
    monkeypatch.setattr(learning.learning, "boosted", lambda rows, vector, label, rounds: rows)
    want = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label")
    got = learning.boosted_trees(spark, SF).select("vec_id", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
