"""Queries of communities, stored sketches, intervals of effect sizes and tiled correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import communities, correlated, graph, pvalues, resampled, shaping, sketches
from archivolt.operators.stored import Stored
from archivolt.plans.catalog import KNN_SQL, MATRIX_SQL, SIDE_SQL, counts, knn, sides
from archivolt.plans.registry import query
from archivolt.sources.tables import table

#: The resolutions that the analysis scans.
RESOLUTIONS = (0.1, 0.2, 0.4, 0.6, 0.8, 1, 2, 4, 6, 8, 10, 12, 14, 15, 16, 18, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def near_edges(spark, d):
    return graph.layer(knn(spark, d), "x", 0.1)


@query()
def community_scan(spark, d):
    """Communities of the neighbour graph at all resolutions: how many, their sizes, and
    the modularity."""
    return communities.summary(communities.found(near_edges(spark, d), RESOLUTIONS)).withColumn("modularity", F.round("modularity", 6))


@query(f"""WITH {KNN_SQL}, e AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(similarity) AS w FROM k WHERE abs(similarity) > 0.1 GROUP BY 1, 2), p AS (SELECT * FROM e WHERE w > 0),
l AS (SELECT vec_id, label FROM embeddings), s AS (SELECT 2 * sum(w) AS m2 FROM p), i AS (SELECT x.label, 2 * sum(w) AS inside FROM p JOIN l x ON x.vec_id = a JOIN l y ON y.vec_id = b WHERE x.label = y.label GROUP BY 1),
k2 AS (SELECT label, sum(w) AS k FROM (SELECT unnest([a, b]) AS node, w FROM p) JOIN l ON vec_id = node GROUP BY 1), r(resolution) AS (VALUES (0.5::DOUBLE), (1.0), (2.0))
SELECT resolution, round(sum(coalesce(inside, 0) / m2 - resolution * (k / m2) * (k / m2)), 6) AS modularity FROM k2 LEFT JOIN i USING (label), s, r GROUP BY 1""")
def label_modularity(spark, d):
    """How well the given labels part the neighbour graph."""
    labels = table(spark, d, "embeddings").select(F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("resolution"), F.col("vec_id").alias("node"), F.col("label").alias("community"))
    return communities.modularity(near_edges(spark, d), labels).withColumn("modularity", F.round("modularity", 6))


def stored_digests(m, by, batch, value):
    """Sketches of each batch, written and read again."""
    return Stored(m.sparkSession).table(sketches.digests(m, [*by, batch], value), "digests", keep=True)


@query(f"WITH {MATRIX_SQL}, v AS (SELECT gene, value FROM m WHERE value <> 0) SELECT gene, count(*) AS n, quantile_disc(value, 0.5) AS median FROM v GROUP BY 1 HAVING count(*) <= 200")
def digest_medians(spark, d):
    """Medians of genes from sketches of batches of samples, where the sketches are exact."""
    m = counts(spark, d).withColumn("batch", F.col("sample") % 10)
    return sketches.medians(stored_digests(m, ["gene"], "batch", "value"), ["gene"]).where("n <= 200")


@query("SELECT l_returnflag, count(*) AS n, true AS lower_held, true AS median_held, true AS upper_held FROM lineitem WHERE l_extendedprice <> 0 GROUP BY 1")
def digest_bounds(spark, d):
    """Whether the quartiles of sketches merged over batches keep the bound of their rank."""
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 16).alias("batch"), F.col("l_extendedprice").alias("v"))
    found = sketches.merged(stored_digests(rows, ["l_returnflag"], "batch", "v"), ["l_returnflag"])
    names = {"lower": 0.25, "median": 0.5, "upper": 0.75}
    found = found.select("l_returnflag", "n", *(sketches.quantile(F.col("sketch"), q).alias(c) for c, q in names.items()))
    e = sketches.rank_error()
    checked = sketches.ranks(rows, found, ["l_returnflag"], "v", list(names))
    return checked.select("l_returnflag", "n", *(((F.col(f"below_{c}") - e <= q) & (q <= F.col(f"upto_{c}") + e)).alias(f"{c}_held") for c, q in names.items()))


@query()
def effect_intervals(spark, d):
    """All effect sizes of a grid of two columns' values, each with its interval over 400
    draws."""
    e = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("h"), F.col("l_extendedprice").alias("value"), (F.col("l_discount") > 0.05).alias("side"))
    return resampled.intervals(e, "id", "value", "side", ["g", "h"], threshold=30000.0)


@query(f"""WITH {MATRIX_SQL}, n AS (SELECT count(DISTINCT sample) AS n FROM m), s AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM m GROUP BY 1),
x AS (SELECT a.gene AS a, b.gene AS b, sum(a.value * b.value) AS xy FROM m a JOIN m b ON a.sample = b.sample AND a.gene <> b.gene GROUP BY 1, 2),
r AS (SELECT a.gene AS id, b.gene AS other, round((coalesce(xy, 0) - a.s * b.s / n) / sqrt((a.q - a.s * a.s / n) * (b.q - b.s * b.s / n)), 6) AS r FROM s a JOIN s b ON a.gene <> b.gene LEFT JOIN x ON x.a = a.gene AND x.b = b.gene, n WHERE a.q - a.s * a.s / n > 1e-12 * a.q AND b.q - b.s * b.s / n > 1e-12 * b.q)
SELECT id, other, r, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(r) DESC, other) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""")
def gene_partners(spark, d):
    """Each part's five most strongly correlated other parts, over all suppliers."""
    return correlated.strongest(counts(spark, d), 5)


@query()
def two_sample_tests(spark, d):
    """Five tests of both sides of each group, with their probabilities."""
    r = pvalues.two_sample_tests(sides(spark, d), "value", "side", ["g"])
    return r.select("g", "test", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"))


@query(f"""WITH {SIDE_SQL}, v AS (SELECT g, value, count_if(side) AS a, count_if(NOT side) AS b FROM e GROUP BY 1, 2), c AS (SELECT g, sum(a) OVER w / sum(a) OVER q AS fa, sum(b) OVER w / sum(b) OVER q AS fb, sum(a) OVER q AS n, sum(b) OVER q AS m FROM v WINDOW w AS (PARTITION BY g ORDER BY value), q AS (PARTITION BY g)),
s AS (SELECT g, max(abs(fa - fb)) AS ks, any_value(n * m / (n + m)) AS k FROM c GROUP BY 1), x AS (SELECT g, ks, sqrt(k) * ks AS x FROM s)
SELECT g, round(ks, 6) AS statistic, round(CASE WHEN x <= 0.04 THEN 1 WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * list_sum(list_transform(range(1, 31), lambda i: exp(-(2 * i - 1) * (2 * i - 1) * pi() * pi() / (8 * x * x)))) ELSE 2 * list_sum(list_transform(range(1, 31), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * x * x))) END, 6) AS p FROM x""")
def kolmogorov_tests(spark, d):
    r = pvalues.two_sample_tests(sides(spark, d), "value", "side", ["g"]).where("test = 'ks'")
    return r.select("g", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"))


#: The answers that each truth accepts.
ACCEPTED = {"1-URGENT": ["F", "P"], "2-HIGH": ["F"], "5-LOW": ["O", "P"]}


@query("""WITH o AS (SELECT year(o_orderdate) AS y, o_orderpriority AS t, nullif(o_orderstatus, 'P') AS s FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')),
r AS (SELECT y, s, coalesce(CASE t WHEN '1-URGENT' THEN s IN ('F', 'P') WHEN '2-HIGH' THEN s = 'F' ELSE s IN ('O', 'P') END, false) AS good FROM o)
SELECT y, count(*) AS n, count_if(s IS NULL) AS unsaid, count_if(good) AS "right", round(count_if(good) / count(*), 6) AS accuracy FROM r GROUP BY 1""")
def accepted_accuracy(spark, d):
    """Answers against truths that accept several, by year; one status stands for no answer."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("said"))
    return shaping.accepted_accuracy(o, ["y"], "o_orderpriority", "said", ACCEPTED).withColumn("accuracy", F.round("accuracy", 6))
