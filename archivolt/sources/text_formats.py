"""Line formats: annotation files, logs, alignment flags, FASTA, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annotation_attributes(attributes: Column) -> Column:
    """Map of a GTF attribute column: ``key "value"; ...``; of repeated keys the last."""
    parts = F.filter(F.transform(F.split(attributes, ";"), lambda x: F.trim(x)), lambda x: x.rlike(r'^\S+\s+".*"$'))
    entry = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("k"), F.regexp_extract(x, r'"(.*)"$', 1).alias("v")))
    last = F.transform(F.array_distinct(F.transform(entry, lambda e: e["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entry, lambda e: e["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)


def annotation_genes(lines: DataFrame) -> DataFrame:
    """gene_id, gene_name, gene_biotype of the gene rows of a GTF's ``value`` lines."""
    cells = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where((F.size("c") >= 9) & (F.col("c")[2] == "gene"))
    found = cells.select(annotation_attributes(F.col("c")[8]).alias("a"))
    return found.select(*(F.try_element_at("a", F.lit(k)).alias(k) for k in ("gene_id", "gene_name", "gene_biotype")))


def log_numbers(text: Column, patterns: dict[str, str]) -> list[Column]:
    """A bigint for each pattern's first group in a whole log; thousands commas go,
    absent ones are null."""
    return [F.regexp_replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), ",", "").try_cast("bigint").alias(k) for k, p in patterns.items()]


def alignment_flags(rows: DataFrame, flag: str, n: str, by: list[str]) -> DataFrame:
    """Totals of an aligner's flag counts: supplementary, failed and second mates are
    left out; secondary ones are multi-mapped."""
    f, c = F.col(flag), F.col(n)
    has = lambda bits: f.bitwiseAND(F.lit(bits))
    used = rows.where((has(0x80) == 0) & (has(0x200) == 0) & (has(0x800) == 0))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")
    main = has(0x100) == 0
    out = used.groupBy(*by).agg(
        of(main).alias("total"), of(~main).alias("multi"), of(main & ((has(0x5) == 0x4) | (has(0xD) > 0x4))).alias("unaligned"),
        of(main & (has(0x4) == 0) & (has(0x8) == 0)).alias("aligned"), of(main & has(0xD).isin(5, 9)).alias("mixed"),
    )
    return out.withColumn("unique", F.col("aligned") - F.col("multi"))


def fasta(rows: DataFrame, name: str, sequence: str) -> DataFrame:
    """One ``value`` a record, for a text sink."""
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value"))
