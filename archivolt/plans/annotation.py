"""Queries of run annotation. Suppliers stand for runs; their texts are made of names of
methods, since the driver's tables hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.functions import vocabularies as V
from archivolt.operators import annotation
from archivolt.plans.registry import query
from archivolt.sources.tables import table

#: Phrases of made-up run descriptions.
PHRASES = ["10x Genomics Chromium v3", "Smart-seq2 full-length cDNA", "bulk total RNA-seq", "scRNA-seq of whole embryos", "Drop-seq", "chromiun controller", "SORT-seq, poly-A", "no method named", "CEL-Seq with ribo-zero", "TruSeq kit stranded"]


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _values(d: dict) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in ((k, *v) if isinstance(v, tuple) else (k, v))) + ")" for k, v in d.items())
    return f"(VALUES {rows})"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MODELS, PLATFORMS, ASSAYS, SELECTIONS, SOURCES = ([*d, "never heard of"] for d in (V.INSTRUMENTS, V.PLATFORMS, V.ASSAYS, V.SELECTIONS, V.SOURCES))


def structured(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    made = s.select("s_suppkey", *(_pick(v, k).alias(n) for n, v in (("assay", ASSAYS), ("source", SOURCES), ("selection", SELECTIONS), ("platform", PLATFORMS), ("model", MODELS))))
    return annotation.looked_up(made, "assay", "source", "selection", "platform", "model")


@query("WITH " + ", ".join(f"{n} AS (SELECT s_suppkey, ({_list(v)})[s_suppkey % {len(v)} + 1] AS k FROM supplier)" for n, v in (("a", ASSAYS), ("s", SOURCES), ("x", SELECTIONS), ("p", PLATFORMS), ("m", MODELS))) + f"""
SELECT s_suppkey, coalesce(av, 'unknown') AS assay_type, coalesce(sv, 'unknown') AS source_class, coalesce(xv, 'unknown') AS selection_class, coalesce(fv, pv, 'unknown') AS platform_family, coalesce(gv, 'unknown') AS generation, coalesce(nv, 'unknown') AS model_name
FROM a JOIN s USING (s_suppkey) JOIN x USING (s_suppkey) JOIN p USING (s_suppkey) JOIN m USING (s_suppkey)
LEFT JOIN {_values(V.ASSAYS)} aty(ak, av) ON a.k = ak LEFT JOIN {_values(V.SOURCES)} st(sk, sv) ON s.k = sk LEFT JOIN {_values(V.SELECTIONS)} xt(xk, xv) ON x.k = xk LEFT JOIN {_values(V.PLATFORMS)} pt(pk, pv) ON p.k = pk LEFT JOIN {_values(V.INSTRUMENTS)} mt(mk, fv, gv, nv) ON m.k = mk""")
def structured_lookups(spark, d):
    return structured(spark, d).select("s_suppkey", "assay_type", "source_class", "selection_class", "platform_family", "generation", "model_name")


@query()
def run_annotation(spark, d):
    """Scores of run, experiment and study records, labels, and contradictions."""
    k = F.col("s_suppkey")
    links = table(spark, d, "supplier").select(k.alias("run"), (k % 50).alias("experiment"), (k % 7).alias("study"))
    text = lambda key, shift: _pick(PHRASES, F.col(key) + shift).alias("title")
    levels = {
        "run": links.select("run", text("run", 0)),
        "experiment": links.select("experiment").distinct().select("experiment", text("experiment", 3)),
        "study": links.select("study").distinct().select("study", text("study", 5)),
    }
    scores = annotation.weighted(links, levels)
    both = scores.join(structured(spark, d).withColumnRenamed("s_suppkey", "run"), "run").withColumn("layout", F.when(F.col("run") % 2 == 0, "single").otherwise("paired"))
    labels = annotation.resolved(both)
    return labels.select("run", "technology", "tech_variant", "tech_class", "sc_or_bulk", "read_bias", "selection_class", "prep_kit", annotation.contradictions(labels).alias("conflict_flags"))


#: Names of file sets as archives report them.
FILE_SETS = ["fastq", "fastq fastq", "bam", "bam bam bam", "cram", "bam fastq", "cram bam", "10X Genomics bam file", "SOLiD_native", "Illumina native", "nanopore", "PacBio_HDF5", "something else that is very long", "", None]


@query(f"""WITH f AS (SELECT s_suppkey, ({_list([x or '' for x in FILE_SETS])})[s_suppkey % {len(FILE_SETS)} + 1] AS s FROM supplier), t AS (SELECT *, string_split(s, ' ') AS w, list_sort(list_distinct(string_split(s, ' '))) AS u FROM f)
SELECT s_suppkey, CASE WHEN s = '' THEN 'unknown/NA' WHEN u IN (['fastq'], ['bam'], ['cram']) THEN u[1] || CASE WHEN len(w) > 1 THEN ' ×' || len(w) ELSE '' END WHEN contains(s, '10X') THEN '10X bam' WHEN u = ['bam', 'cram'] THEN 'bam+cram' WHEN u = ['bam', 'fastq'] THEN 'bam+fastq'
WHEN list_contains(u, 'SOLiD_native') THEN 'SOLiD' WHEN contains(s, 'Illumina') THEN 'Illumina native' WHEN u = ['nanopore'] THEN 'nanopore' WHEN contains(lower(s), 'pacbio') THEN 'pacbio' ELSE s[:25] END AS format FROM t""")
def file_formats(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.file_format(_pick(FILE_SETS, F.col("s_suppkey"))).alias("format"))
