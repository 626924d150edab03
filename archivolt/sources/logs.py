"""Numbers from the logs and reports that tools leave with each run. The functions take a
table of file contents (path, value: one row a file, as ``whole_files`` reads) and keep
files that say nothing, with nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import positions

# Fixed values from here on: what the tools write before their numbers.
SPLICED = {
    "reads_before": r"Number of input reads \|\s+(\d+)",
    "avg_len": r"Average input read length \|\s+(\d+)",
    "unique": r"Uniquely mapped reads number \|\s+(\d+)",
    "multialign": r"Number of reads mapped to multiple loci \|\s+(\d+)",
    "too_short": r"Number of reads unmapped: too short \|\s+(\d+)",
}
DUPLICATES = {"reads_before": r"total reads:\s*(\d+)", "reads_after": r"unique reads:\s*(\d+)"}
DOWNLOAD = {"starting_reads": r"(?i)spots read\s*:\s*([\d,]+)"}
PSEUDO = {"targets": "n_targets", "reads_before": "n_processed", "aligned": "n_pseudoaligned", "aligned_unique": "n_unique"}
# ... to here.


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each file under a path as one row."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")


def number(text: Column, pattern: str) -> Column:
    """The number that a pattern's first group finds first, commas between thousands left
    out; null if none."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("bigint")


def found(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return files.select("path", *(number(F.col("value"), p).alias(n) for n, p in patterns.items()))


def spliced_alignment(files: DataFrame) -> DataFrame:
    """Counts of a spliced aligner's final log, and unaligned: what isn't mapped uniquely or
    to several places."""
    return found(files, SPLICED).withColumn("unaligned", F.col("reads_before") - F.col("unique") - F.col("multialign"))


def deduplication(files: DataFrame) -> DataFrame:
    return found(files, DUPLICATES)


def download(files: DataFrame) -> DataFrame:
    return found(files, DOWNLOAD)


def pseudo_alignment(files: DataFrame) -> DataFrame:
    """Counts of a pseudo-aligner's JSON, and unaligned; text that isn't JSON gives nulls."""
    schema = ", ".join(f"{k} bigint" for k in PSEUDO.values())
    j = F.from_json("value", schema)
    out = files.select("path", *(j[k].alias(n) for n, k in PSEUDO.items()))
    return out.withColumn("unaligned", F.col("reads_before") - F.col("aligned"))


def read_mates(files: DataFrame, fields: dict[str, str]) -> DataFrame:
    """single_end and, of the first two files of reads that a JSON report lists, the given
    fields (name: type) with 1 or 2 behind their names; absent ones are null."""
    j = F.from_json("value", "readfiles array<struct<" + ", ".join(f"{k}: {t}" for k, t in fields.items()) + ">>")["readfiles"]
    mates = [F.get(j, F.lit(i))[k].alias(f"{k}{i + 1}") for i in (0, 1) for k in fields]
    return files.select("path", F.when(F.size(j) > 0, F.size(j) == 1).alias("single_end"), *mates)


def outcomes(lines: DataFrame, text: str = "value") -> DataFrame:
    """run, outcome of lines whose number of fields varies: with a second file (of reads or
    alignments) in the third field the fourth and fifth together, else the fourth."""
    p = F.split(text, "\t")
    at = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
    paired = F.lower(at(2)).rlike("fastq|bam")
    return lines.select(p[0].alias("run"), F.when(paired, F.concat(at(3), at(4))).otherwise(at(3)).alias("outcome"))


def vectors(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """key, v of lines of a key and numbers; of lines with one key the last of its file
    counts (files in order of their names). A line with anything that isn't a finite
    number is an error when it is read."""
    lines = whole_files(spark, path).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where("trim(line) <> ''")
    p = F.split("line", sep)
    v = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    rows = lines.select("path", "at", p[0].alias("key"), F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), "line"))).otherwise(v).alias("v"))
    return rows.groupBy("key").agg(F.max_by("v", F.struct("path", "at")).alias("v"))


def symbols(spark: SparkSession, path: str, prefix: str, field: int = 1, sep: str = "\t") -> DataFrame:
    """The different values of a field of lines that begin with a prefix."""
    lines = spark.read.text(path).where(F.col("value").startswith(prefix))
    return lines.select(F.trim(F.get(F.split("value", sep), F.lit(field))).alias("symbol")).where("symbol <> ''").distinct()


def delimited(spark: SparkSession, path: str, nulls: list[str], sep: str = ",", schema: str | None = None, parts: int | None = None) -> DataFrame:
    """A table with a header, all of it text unless a schema is given, in which several
    words stand for nothing; ``parts`` deals out what one compressed file holds."""
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    df = df.repartition(parts) if parts else df
    df = df.select(*(F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) for c in df.columns))
    if schema:
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        df = df.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))
    return df


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows with their number, 0 to n - 1, in the order in which they are read."""
    return positions.as_read(df, name)
