"""Run annotation: pattern scores over metadata levels, structured lookups, one label
of each kind, and flags where they contradict each other.

Scores are columns named after what they speak for: ``tech:``, ``kit:``, ``bias:`` and
``hint:`` before the name. Exact patterns are counted in the JVM; those that allow edits
go through one Arrow function for all of them, over each level's distinct records only.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import vocabularies as V
from archivolt.functions.text import arg_max, flags
from archivolt.operators.relational import lookup

KINDS = {"tech": V.TECHNOLOGIES, "kit": V.KITS, "bias": V.BIASES, "hint": V.HINTS}
GENERIC = "generic-scrnaseq"


def names(kind: str) -> list[str]:
    """The columns of a kind, in the order that decides ties."""
    every = dict.fromkeys(n for n, *_ in KINDS[kind])
    return [*(n for n in every if n not in V.MERGED), *(n for n in V.MERGED if n in every)]


def closest(pattern: str, edits: int, text: str) -> int:
    """How many matches there are with as few edits as any match needs."""
    for e in range(edits + 1):
        found = sum(1 for _ in regex.finditer(rf"(?i)(?:{pattern}){{e<={e}}}" if e else f"(?i){pattern}", text))
        if found:
            return found
    return 0


def _approximate(texts: pd.Series, patterns: list[tuple[str, str, int]]) -> pd.Series:
    return pd.Series([[closest(p, e, t or "") for _, p, e in patterns] for t in texts], index=texts.index)


def scored(df: DataFrame, key: str) -> DataFrame:
    """key and all scores of a level's records: matches over all columns of the record."""
    line = F.concat_ws("\t", *(F.col(f"`{c}`").cast("string") for c in df.columns))
    every = [(f"{k}:{n}", p, e) for k, patterns in KINDS.items() for n, p, e in patterns]
    loose = [x for x in every if x[2]]
    counts = F.pandas_udf(lambda t: _approximate(t, loose), "array<long>")
    at = {id(x): k for k, x in enumerate(loose)}
    lined = df.select(F.col(key), line.alias("_line")).withColumn("_loose", counts("_line"))

    def count(x) -> Column:
        return F.col("_loose")[at[id(x)]] if x[2] else F.regexp_count("_line", F.lit(f"(?i){x[1]}")).cast("long")

    total = lambda n: reduce(lambda a, b: a + b, [count(x) for x in every if x[0] == n])
    return lined.select(key, *(total(n).alias(n) for n in dict.fromkeys(x[0] for x in every)))


def weighted(links: DataFrame, levels: dict[str, DataFrame], run: str = "run") -> DataFrame:
    """Scores of each run: those of its level records by weight; a level that a run lacks
    counts nothing. ``links`` has the run and a key column named after each level; each
    level's table has that key, once a record."""
    columns = [f"{k}:{n}" for k in KINDS for n in names(k)]
    out = links.select(run, *(c for c in levels if c != run)).withColumns({c: F.lit(0).cast("long") for c in columns})
    for level, records in levels.items():
        part = scored(records, level).withColumnsRenamed({c: f"_{c}" for c in columns})
        out = out.join(part, level, "left").withColumns({c: F.col(f"`{c}`") + V.WEIGHTS[level] * F.coalesce(F.col(f"`_{c}`"), F.lit(0)) for c in columns}).drop(*(f"_{c}" for c in columns))
    return out.select(run, *(F.col(f"`{c}`") for c in columns))


def looked_up(df: DataFrame, assay: str, source: str, selection: str, platform: str, model: str) -> DataFrame:
    """assay_type, source_class, selection_class, platform_family, generation and model of
    the structured columns; the platform's family where the model isn't known."""
    parts = [{m: v[i] for m, v in V.INSTRUMENTS.items()} for i in range(3)]
    family, generation, short = (lookup(F.col(model), t, "unknown") for t in parts)
    return df.withColumns({
        "assay_type": lookup(F.col(assay), V.ASSAYS, "unknown"),
        "source_class": lookup(F.col(source), V.SOURCES, "unknown"),
        "selection_class": lookup(F.col(selection), V.SELECTIONS, "unknown"),
        "platform_family": F.when(family == "unknown", lookup(F.col(platform), V.PLATFORMS, "unknown")).otherwise(family),
        "generation": generation,
        "model_name": short,
    })


def resolved(df: DataFrame) -> DataFrame:
    """One label of each kind from scores and the structured classes.

    A named single-cell method that is seen in an experiment or closer outweighs any
    sign of bulk. The general single-cell patterns only decide where no method is named.
    Of equal scores the first in the order of ``names`` wins."""
    score = lambda k, n: F.coalesce(F.col(f"`{k}:{n}`"), F.lit(0))
    added = lambda cs: reduce(lambda a, b: a + b, cs)
    tech = [n for n in names("tech") if n != GENERIC]
    single = added([score("tech", n) for n in tech if n in V.SINGLE_CELL])
    general = score("tech", GENERIC)
    only = F.when((general > 0) & (added([score("tech", n) for n in tech]) == 0), general + 1).otherwise(0)
    ranked = [(n, F.when(single >= 10, 0).otherwise(score("tech", n)) if n == "bulk" else score("tech", n)) for n in tech]
    best = arg_max([(n, c.cast("long")) for n, c in [*ranked, (f"{GENERIC}-only", only)]])
    source, chosen = F.col("source_class"), F.col("selection_class")
    hints = reduce(lambda c, n: c.when(score("hint", n) > 0, n), names("hint"), F.when(F.lit(False), "")).otherwise(chosen)
    first = df.withColumn("_best", best)
    return first.withColumns({
        "technology": F.when(F.col("_best") == "sortseq", "celseq").otherwise(F.col("_best")),
        "tech_variant": F.when(F.col("_best") == "sortseq", "sort_seq"),
        "sc_or_bulk": F.when((source == "sc") | (single > 0), "sc").when(general > 0, "sc_generic").when(source.isin("bulk", "metatranscriptomic"), "bulk").otherwise("unknown"),
        "read_bias": F.when(score("bias", "bias_5prime") > 0, "5prime").when(score("bias", "bias_3prime") > 0, "3prime").when(score("bias", "bias_fullength") > 0, "full_length").otherwise("unknown"),
        "selection_class": F.when(chosen.isin("unknown", "cdna_unspecified", "other"), hints).otherwise(chosen),
        "prep_kit": arg_max([(n, score("kit", n).cast("long")) for n in names("kit")]),
    }).drop("_best").withColumn("tech_class", lookup(F.col("technology"), V.CLASSES, "unknown"))


def contradictions(df: DataFrame) -> Column:
    """Names of all signals that disagree, a bar between; "" if none do. The names are
    fixed values, and so is their order."""
    tech, source, bias, selection = (F.col(c) for c in ("technology", "source_class", "read_bias", "selection_class"))
    single = tech.isin(V.SINGLE_CELL)
    return flags([
        ("sc_tech|bulk_source", single & (source == "bulk")),
        ("sc_source|no_sc_tech", (source == "sc") & ~single & (tech != "unknown")),
        ("bulk_tech|sc_source", tech.isin(V.BULK) & (source == "sc")),
        ("tech_3prime|fullength_bias", tech.isin(V.THREE_PRIME) & (bias == "full_length")),
        ("tech_fullength|3prime_bias", tech.isin(V.FULL_LENGTH) & (bias == "3prime")),
        ("paired_tech|single_layout", tech.isin(V.PAIRED) & (F.col("layout") == "single")),
        ("sc_tech|rrna_depletion", single & (selection == "rrna_depletion")),
        ("polya_selection|fullength_bias", (selection == "poly_a") & (bias == "full_length")),
        ("non_rna_assay|rna_source", ~F.col("assay_type").isin("rna_seq", "unknown") & source.isin("sc", "bulk")),
        ("metatranscriptomic_source", source == "metatranscriptomic"),
    ])
