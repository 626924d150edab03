"""Readers of what runs leave behind: wide matrices, key and value files, trees of
folders, trial logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """The column names of a delimited file; only its first line is read."""
    first = spark.read.text(path).limit(1).collect()
    return first[0]["value"].split(sep) if first else []


def wide_matrix(spark: SparkSession, path: str, wanted: list[str] | None = None, sep: str = "\t", zeros: bool = False) -> DataFrame:
    """gene, sample, value of a matrix with a column a sample and the genes' names first.
    Lines are split once, whatever their width; only wanted columns are made rows, and
    cells that aren't numbers, or are zero, none (zeros with ``zeros``)."""
    names = header(spark, path, sep)
    keep = [(i, n) for i, n in enumerate(names) if i and (wanted is None or n in set(wanted))]
    if not keep:
        return spark.createDataFrame([], "gene string, sample string, value double")
    lines = spark.read.text(path).where(F.col("value") != sep.join(names)).select(F.split("value", sep, -1).alias("p"))
    at = F.array(*(F.struct(F.lit(n).alias("sample"), F.lit(i).alias("i")) for i, n in keep))
    cells = lines.select(F.col("p")[0].alias("gene"), F.inline(F.transform(at, lambda a: F.struct(a["sample"].alias("sample"), F.get("p", a["i"]).try_cast("double").alias("value")))))
    return cells.where(F.col("value").isNotNull() if zeros else "value <> 0")


def key_values(lines: DataFrame, sep: str = ":", text: str = "value") -> DataFrame:
    """key, value of lines of the form key, mark, value; others are left out."""
    parts = F.split(text, sep, 2)
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def path_parts(path: Column, names: list[str]) -> list[Column]:
    """Of a file's path, its last folders under these names, the last name for the folder
    the file is in; null where the path is shorter."""
    parts = F.split(path, "/")
    return [F.when(F.size(parts) > len(names) - k + 1, F.try_element_at(parts, F.lit(k - len(names) - 1))).alias(n) for k, n in enumerate(names)]


def cluster_files(spark: SparkSession, root: str, wanted: list[float] | None = None, name: str = r"leiden_clusters_([0-9]*\.?[0-9]+)\.csv") -> DataFrame:
    """resolution, cluster, gene of all files under a folder whose names (in any case) tell
    the resolution, by the pattern's first group: a gene and its cluster a line, below a
    header. ``wanted`` leaves the other resolutions out. Clusters stay text; lines without
    a gene or a cluster are left out."""
    lines = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").schema("gene string, cluster string").csv(root)
    told = F.regexp_extract(F.col("_metadata.file_name"), f"(?i)^{name}$", 1)
    rows = lines.select(F.when(told != "", told).try_cast("double").alias("resolution"), F.trim("cluster").alias("cluster"), F.trim("gene").alias("gene"))
    found = rows.where("resolution is not null and gene <> '' and cluster <> ''")
    return found.where(F.col("resolution").isin([float(r) for r in wanted])) if wanted is not None else found


def result_metrics(spark: SparkSession, root: str, names: list[str], pattern: str, schema: str) -> DataFrame:
    """The rows of all delimited files of one name in nested folders, with a column for each
    of the last folders' names; ``pattern`` is the file's name, ``schema`` its columns."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).csv(root)
    return rows.select(*path_parts(F.col("_metadata.file_path"), names), "*")


def folders(paths: DataFrame, path: str, digits: int = 6) -> DataFrame:
    """prefix, folder: of work folders named by a short name and a hash, the first of
    each short name and first digits. ``paths`` lists files, one a row."""
    short, rest = F.regexp_extract(path, "/([0-9a-f]{2})/([0-9a-f]{%d,})/[^/]*$" % digits, 1), F.regexp_extract(path, "/([0-9a-f]{2})/([0-9a-f]{%d,})/[^/]*$" % digits, 2)
    found = paths.select(F.concat(short, F.lit("/"), F.substring(rest, 1, digits)).alias("prefix"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"))
    return found.where("prefix <> '/'").groupBy("prefix").agg(F.min("folder").alias("folder"))


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length of the files under a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(root).select("path", "length")


def best_trials(spark: SparkSession, root: str, metric: str, pattern: str = "*.log") -> DataFrame:
    """path, line, metric: of each log the line with the largest ``metric`` (a pattern
    whose first group is the number); of equals the first in order of their text. Bytes
    that aren't UTF-8 are replaced."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    found = lines.withColumn("metric", F.regexp_extract("line", metric, 1).try_cast("double")).where("metric is not null")
    best = found.groupBy("path").agg(F.max("metric").alias("metric"))
    return found.join(best, ["path", "metric"]).groupBy("path", "metric").agg(F.min("line").alias("line"))


def combined(samples: dict[str, DataFrame], name: str = "sample") -> DataFrame:
    """The rows of several samples' tables with the sample's name; columns that a table
    lacks are null."""
    out = None
    for k, df in samples.items():
        one = df.withColumn(name, F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no samples")
    return out
