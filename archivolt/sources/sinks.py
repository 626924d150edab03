"""Sinks: delimited text, nested JSON, graphs as two tables or GraphML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = False, gzip: bool = False) -> None:
    df.write.csv(path, sep=sep, header=header, compression="gzip" if gzip else "none")


def members(df: DataFrame, key: str, member: str) -> DataFrame:
    """One JSON text a key, ``{"key": ..., "members": [...]}``, members in order."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return lists.select(F.to_json(F.struct(F.col(key).alias("key"), "members")).alias("value"))


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.csv(f"{path}/nodes", header=True)
    edges.write.csv(f"{path}/edges", header=True)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: the lines of a GraphML document, in order, of nodes (id) and edges (a, b,
    weight); written as text, its parts are read one after the other."""
    spark = nodes.sparkSession

    def safe(c: str) -> Column:
        text = F.col(c).cast("string")
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(mark), F.lit(name))
        return text

    frame = spark.createDataFrame(
        [(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'), (3, "</graph></graphml>")],
        "_part int, value string",
    )
    n = nodes.select(F.lit(1).alias("_part"), F.format_string('<node id="%s"/>', safe("id")).alias("value"))
    e = edges.select(F.lit(2).alias("_part"), F.format_string('<edge source="%s" target="%s"><data key="w">%s</data></edge>', safe("a"), safe("b"), F.col("weight").cast("string")).alias("value"))
    return frame.unionByName(n).unionByName(e).orderBy("_part", "value").select("value")
