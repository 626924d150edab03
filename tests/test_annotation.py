"""Run annotation against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from archivolt.functions import names
from archivolt.operators import annotation


@pytest.mark.parametrize(
    "pattern, edits, text, n",
    [("chromium", 1, "Chromium and chromium", 2), ("chromium", 1, "chromiun", 1), ("chromium", 1, "chrome", 0), ("chromium", 1, "chromium or chromiun", 1), ("fluidigm", 0, "fluidgm", 0)],
)
def test_closest(pattern, edits, text, n):
    assert annotation.closest(pattern, edits, text) == n


def test_labels_and_contradictions(spark):
    rows = [
        (1, "10x Genomics Chromium v3", "bulk RNA-seq of fins", "sc", "poly_a", "single"),
        (2, "scRNA-seq", "nothing", "bulk", "unknown", "paired"),
        (3, "SORT-seq, poly-A, full-length", "nothing", "bulk", "other", "paired"),
        (4, None, "bulk total RNA-seq; ribo-zero", "unknown", "cdna_unspecified", "paired"),
        (5, "", "", "metatranscriptomic", "cage", "paired"),
    ]
    df = spark.createDataFrame(rows, "run long, title string, about string, source_class string, selection_class string, layout string")
    links = df.select("run", F.col("run").alias("study"))
    scores = annotation.weighted(links, {"run": df.select("run", "title"), "study": df.select(F.col("run").alias("study"), "about")})
    both = scores.join(df.drop("title", "about"), "run").withColumn("assay_type", F.lit("rna_seq"))
    labels = annotation.resolved(both)
    got = {r.run: r for r in labels.select("*", annotation.contradictions(labels).alias("flags")).collect()}
    assert [got[k].technology for k in range(1, 6)] == ["10x", "generic-scrnaseq-only", "celseq", "bulk", "unknown"]
    assert [got[k].tech_class for k in range(1, 6)] == ["single_cell_droplet", "single_cell_generic", "single_cell_plate", "bulk", "unknown"]
    assert [got[k].sc_or_bulk for k in range(1, 6)] == ["sc", "sc_generic", "sc", "unknown", "bulk"]
    assert [got[k].selection_class for k in range(1, 6)] == ["poly_a", "unknown", "poly_a", "rrna_depletion", "cage"]
    assert got[3].tech_variant == "sort_seq" and got[3].read_bias == "full_length" and got[4].prep_kit == "ribozero"
    assert got[1].flags == "paired_tech|single_layout" and got[5].flags == "metatranscriptomic_source"
    assert got[3].flags == "sc_tech|bulk_source|tech_3prime|fullength_bias|polya_selection|fullength_bias"
    assert got[2].flags == ""


def test_merged_columns_come_last_at_ties(spark):
    rows = [(1, "10x Genomics and Drop-seq"), (2, "TruSeq or NEBNext")]
    df = spark.createDataFrame(rows, "run long, title string")
    both = annotation.weighted(df.select("run"), {"run": df}).withColumns({c: F.lit("unknown") for c in ("source_class", "selection_class")})
    got = {r.run: r for r in annotation.resolved(both).collect()}
    assert got[1].technology == "dropseq" and got[2].prep_kit == "nebnext"
    assert annotation.names("tech")[-3:] == ["10x", "generic-scrnaseq", "smartseq"] and annotation.names("kit")[-2:] == ["trueseq", "lexogen"]


def test_names(spark):
    df = spark.createDataFrame([("'a b.12'", "x, y;z|w", "Zika virus - infected", "<SPOT_LENGTH>150</SPOT_LENGTH><READ_SPEC></READ_SPEC><READ_SPEC></READ_SPEC>"), (None, None, None, None)], "i string, l string, s string, d string")
    got, none = df.select(names.normal_id(F.col("i"), True).alias("i"), names.list_cell(F.col("l")).alias("l"), names.scrubbed(F.col("s"), ["virus", "infected"]).alias("s"), *names.spot_layout(F.col("d"))).collect()
    assert (got.i, got.l, got.s, got.spot_length, got.reads, got.layout) == ("A B", ["x", "y", "z", "w"], "Zika", 150, 2, "paired")
    assert (none.i, none.l, none.layout) == (None, [], "unknown")
