"""Identifiers and names: normalised ids, core numbers, ranks by suffix, scrubbed labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of taxon names and the ranks they stand for.
RANKS = {"idae": "family", "ales": "order", "cetes": "class", "cota": "phylum", "virae": "kingdom", "viria": "realm"}


def normal_id(c: Column, upper: bool = False) -> Column:
    """Without quotes, blanks around and a version after the last point."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(c, "[\"']", "")), r"\.[0-9]+$", "")
    return F.upper(plain) if upper else plain


def core_number(c: Column) -> Column:
    """The number after #, without leading zeros; null if there is none."""
    return F.regexp_extract(c, "#([0-9]+)$", 1).try_cast("bigint")


def list_cell(c: Column) -> Column:
    """Items of a cell parted by commas, blanks, semicolons or bars."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,\s;|]+"), lambda x: x != "")


def rank_of(name: Column, depth: Column | None = None, by_depth: dict[int, str] | None = None) -> Column:
    """The rank that a name's ending tells; else that of its depth, else "unranked"."""
    told = reduce(lambda c, kv: c.when(name.endswith(kv[0]), kv[1]), RANKS.items(), F.when(F.lit(False), ""))
    if depth is None:
        return F.coalesce(told, F.lit("unranked"))
    at = reduce(lambda c, kv: c.when(depth == kv[0], kv[1]), (by_depth or {}).items(), F.when(F.lit(False), ""))
    return F.coalesce(told, at, F.lit("unranked"))


def scrubbed(c: Column, words: list[str]) -> Column:
    """Without the words, which end where letters do, and with the rest's parts joined
    by +."""
    bare = F.regexp_replace(c, "(?i)(?<![A-Za-z])(?:" + "|".join(words) + ")(?![A-Za-z])", " ")
    return F.array_join(F.filter(F.split(bare, r"[\s,;|+]+"), lambda x: x.rlike("[A-Za-z0-9]")), "+")


def spot_layout(descriptor: Column) -> list[Column]:
    """Of a read descriptor in XML: spot_length, reads, technical_reads, layout."""
    reads = F.regexp_count(descriptor, F.lit("<READ_SPEC>")).cast("long")
    technical = F.regexp_count(descriptor, F.lit("(?i)<READ_CLASS>\\s*technical")).cast("long")
    own = reads - technical
    return [
        F.regexp_extract(descriptor, "<SPOT_LENGTH>([0-9]+)<", 1).try_cast("bigint").alias("spot_length"),
        reads.alias("reads"),
        technical.alias("technical_reads"),
        F.when(own > 1, "paired").when(own == 1, "single").otherwise("unknown").alias("layout"),
    ]
