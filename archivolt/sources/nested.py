"""Nested XML records as one table for each level, with the keys of the levels above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored

#: Elements and attributes of the public archive's XML.
RECORD = "EXPERIMENT_PACKAGE"
TAGS = "array<struct<TAG: string, VALUE: string>>"
SCHEMA = f"""STUDY struct<_accession: string, _alias: string, DESCRIPTOR: struct<STUDY_TITLE: string, STUDY_ABSTRACT: string>>,
SAMPLE struct<_accession: string, _alias: string, TITLE: string, SAMPLE_NAME: struct<TAXON_ID: string, SCIENTIFIC_NAME: string>, SAMPLE_ATTRIBUTES: struct<SAMPLE_ATTRIBUTE: {TAGS}>>,
EXPERIMENT struct<_accession: string, _alias: string, TITLE: string, DESIGN: struct<DESIGN_DESCRIPTION: string, LIBRARY_DESCRIPTOR: struct<LIBRARY_NAME: string, LIBRARY_STRATEGY: string, LIBRARY_SOURCE: string, LIBRARY_SELECTION: string, LIBRARY_CONSTRUCTION_PROTOCOL: string>>>,
RUN_SET struct<RUN: array<struct<_accession: string, _alias: string, _total_spots: string, _published: string, Pool: struct<Member: array<struct<_accession: string>>>, RUN_ATTRIBUTES: struct<RUN_ATTRIBUTE: {TAGS}>>>>"""


def attributes(tags: Column) -> Column:
    """``tag=value`` of each pair, by semicolons; null without any."""
    said = F.array_join(F.transform(tags, lambda t: F.concat(F.coalesce(t["TAG"], F.lit("")), F.lit("="), F.coalesce(t["VALUE"], F.lit("")))), ";")
    return F.when(F.size(tags) > 0, said)


def levels(spark: SparkSession, path: str, record: str = RECORD, schema: str = SCHEMA) -> dict[str, DataFrame]:
    """study, sample, experiment and run, from one pass over the files: the records are
    read and written once. A run has the keys of its experiment, sample (of its pool, else
    of the record) and study, an experiment those of its sample and study. Elements that
    repeat are rows of their own, absent ones null; what several records say of one
    accession is one row, the first in order; records without an accession of a level have
    no row there."""
    read = spark.read.format("xml").option("rowTag", record).schema(schema).load(path)
    held = Stored(spark).table(read, "records", keep=True)  # the results read it
    study, sample, experiment = (F.col(f"{level}._accession") for level in ("STUDY", "SAMPLE", "EXPERIMENT"))
    library = "EXPERIMENT.DESIGN.LIBRARY_DESCRIPTOR"
    runs = held.select(study.alias("study"), sample.alias("sample"), experiment.alias("experiment"), F.explode("RUN_SET.RUN").alias("r"))
    made = {
        "study": held.select(study.alias("accession"), F.col("STUDY._alias").alias("alias"), F.col("STUDY.DESCRIPTOR.STUDY_TITLE").alias("title"), F.col("STUDY.DESCRIPTOR.STUDY_ABSTRACT").alias("abstract")),
        "sample": held.select(sample.alias("accession"), study.alias("study"), F.col("SAMPLE._alias").alias("alias"), F.col("SAMPLE.TITLE").alias("title"), F.col("SAMPLE.SAMPLE_NAME.TAXON_ID").alias("taxon_id"), F.col("SAMPLE.SAMPLE_NAME.SCIENTIFIC_NAME").alias("organism"), attributes(F.col("SAMPLE.SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE")).alias("attributes")),
        "experiment": held.select(
            experiment.alias("accession"), sample.alias("sample"), study.alias("study"), F.col("EXPERIMENT._alias").alias("alias"), F.col("EXPERIMENT.TITLE").alias("title"), F.col("EXPERIMENT.DESIGN.DESIGN_DESCRIPTION").alias("design"),
            *(F.col(f"{library}.{name}").alias(name.lower()) for name in ("LIBRARY_NAME", "LIBRARY_STRATEGY", "LIBRARY_SOURCE", "LIBRARY_SELECTION", "LIBRARY_CONSTRUCTION_PROTOCOL")),
        ),
        "run": runs.select(F.col("r._accession").alias("accession"), "experiment", F.coalesce(F.get(F.col("r.Pool.Member"), F.lit(0))["_accession"], F.col("sample")).alias("sample"), "study", F.col("r._alias").alias("alias"), F.col("r._total_spots").try_cast("long").alias("total_spots"), F.col("r._published").alias("published"), attributes(F.col("r.RUN_ATTRIBUTES.RUN_ATTRIBUTE")).alias("attributes")),
    }
    return {name: df.where("accession is not null").groupBy("accession").agg(F.min(F.struct(*(c for c in df.columns if c != "accession"))).alias("_r")).select("accession", "_r.*") for name, df in made.items()}
