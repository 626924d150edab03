"""Queries of components, classifiers, tail fences and clusters, with SQL where it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import inference, learning, linkage
from archivolt.plans.catalog import MATRIX_SQL, counts
from archivolt.plans.registry import query
from archivolt.sources.tables import table


@query()
def principal_components(spark, d):
    return learning.components(table(spark, d, "embeddings"), "embedding", 10).withColumns({c: F.round(c, 6) for c in ("share", "cumulative")})


@query()
def radial_machine(spark, d):
    rows = inference.split(table(spark, d, "embeddings"), "vec_id", "label")
    return learning.radial(rows, "vec_id", "embedding", F.col("label") == 0, 64, 1.0).withColumn("probability", F.round("probability", 4))


@query()
def boosted_trees(spark, d):
    rows = inference.split(table(spark, d, "embeddings"), "vec_id", "label")
    return learning.boosted(rows, "embedding", "label", 3)


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS u, count(l_extendedprice) AS n FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag, avg(l_extendedprice - u) AS m, var_samp(l_extendedprice - u) AS v, count(*) AS k FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice > u GROUP BY 1),
p AS (SELECT *, (1 - m * m / v) / 2 AS c, m * (m * m / v + 1) / 2 AS s FROM q JOIN o USING (l_returnflag)) SELECT l_returnflag, round(u + s / c * (pow(0.005 * n / k, -c) - 1), 4) AS upper FROM p""")
def fences_tail(spark, d):
    return learning.tail_fence(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("upper", F.round("upper", 4))


@query()
def fences_skew(spark, d):
    r = learning.skew_fences(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return r.withColumns({c: F.round(c, 4) for c in ("mc", "lower", "upper")})


@query("""WITH q AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, list_transform(range(21), lambda i: (i + 0.5) / 21)) AS q FROM customer GROUP BY 1)
SELECT a.g AS a, b.g AS b, round(list_sum(list_transform(list_zip(a.q, b.q), lambda p: abs(p[1] - p[2]))) / 21, 4) AS distance FROM q a JOIN q b ON a.g < b.g""".replace("list_transform(range(21), lambda i: (i + 0.5) / 21)", "[" + ", ".join(f"{(i + 0.5) / 21!r}" for i in range(21)) + "]"))
def group_distances(spark, d):
    return learning.group_distances(table(spark, d, "customer"), "c_nationkey", "c_acctbal").withColumn("distance", F.round("distance", 4))


@query()
def group_clusters(spark, d):
    return linkage.clusters(learning.group_distances(table(spark, d, "customer"), "c_nationkey", "c_acctbal"), 5)


@query(f"""WITH {MATRIX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS t, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS b FROM m)
SELECT sample, gene, value, CASE WHEN t <= 5 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE t <= 5 OR b <= 5""")
def gene_panels(spark, d):
    return learning.nearest_rank(counts(spark, d), ["sample"], "value", 5)
