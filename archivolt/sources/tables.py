"""Scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False, null: str = "") -> DataFrame:
    """Text columns under a declared schema; bad rows give nulls, never an error."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=null, mode="PERMISSIVE", enforceSchema=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="PERMISSIVE")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
