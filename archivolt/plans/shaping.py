"""Queries of the reshaping operators and name functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivolt.functions import names
from archivolt.operators import relational, shaping, statistics, vectors
from archivolt.operators.stored import Stored
from archivolt.plans.catalog import HALVES_SQL, MATRIX_SQL, SIDE_SQL, STATUS, UNIT_SQL, counts, half_spaces, sides, unit_rows
from archivolt.plans.registry import query
from archivolt.sources.tables import table

#: The levels of p_type.
TYPES = ["ECONOMY", "STANDARD", "PROMO"]


# --- columns and values

@query(f"WITH {MATRIX_SQL} SELECT sample, coalesce(p_brand, CAST(gene AS VARCHAR)) AS gene, sum(value) AS value FROM m LEFT JOIN (SELECT p_partkey AS gene, p_brand FROM part WHERE p_size > 10) USING (gene) GROUP BY 1, 2")
def renamed_columns(spark, d):
    mapping = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene"), "p_brand")
    return shaping.renamed(counts(spark, d), mapping, "gene", "p_brand", ["sample"], "value")


@query("SELECT p_brand, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1")
def collapsed_means(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@query("SELECT r_name AS name, r_regionkey AS region, CAST(NULL AS INTEGER) AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
def schema_union(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    return shaping.aligned([r, n])


@query("WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY event_type)), 6) AS v FROM e")
def missing_to_mean(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return shaping.filled(e, "v", ["event_type"], "mean").select("event_id", F.round("v", 6).alias("v"))


ODD_SQL = "e AS (SELECT event_id, event_type, CASE event_id % 50 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events)"


@query(f"""WITH {ODD_SQL}, s AS (SELECT event_type, max(v) FILTER (isfinite(v)) AS x, median(v) FILTER (isfinite(v)) AS y FROM e GROUP BY 1)
SELECT event_id, round(coalesce(CASE WHEN isinf(v) THEN x WHEN v IS NULL OR isnan(v) THEN y ELSE v END, 0), 6) AS v FROM e JOIN s USING (event_type)""")
def finite_values(spark, d):
    k = F.col("event_id") % 50
    odd = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).otherwise(F.col("value"))
    e = table(spark, d, "events").select("event_id", "event_type", odd.alias("v"))
    return shaping.finite(e, "v", ["event_type"]).select("event_id", F.round("v", 6).alias("v"))


@query(f"""WITH {MATRIX_SQL}, n AS (SELECT count(DISTINCT sample) AS n FROM m)
SELECT gene, round((sum(value * value) - sum(value) * sum(value) / any_value(n)) / any_value(n), 6) AS variance FROM m, n GROUP BY 1 HAVING variance > 0 ORDER BY variance DESC, gene LIMIT 50""")
def variable_genes(spark, d):
    return shaping.variable(counts(spark, d), "gene", "sample", "value", 50)


@query(f"WITH {MATRIX_SQL} SELECT sample, min(value) AS least, count(*) AS genes FROM m WHERE value > 0 AND NOT starts_with(CAST(gene AS VARCHAR), '11') GROUP BY 1 HAVING min(value) >= 1")
def expressed_samples(spark, d):
    m = counts(spark, d).where("value > 0").where(~F.col("gene").cast("string").startswith("11"))
    return m.groupBy("sample").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("genes")).where("least >= 1")


@query(f"""WITH {MATRIX_SQL} SELECT sample, sum(value) AS total, count(*) AS columns, round(100 * coalesce(sum(value) FILTER (gene < 20), 0) / sum(value), 6) AS pct_marked FROM m GROUP BY 1
HAVING sum(value) > 500 AND sum(value) < 50000 AND count(*) > 30 AND 100 * coalesce(sum(value) FILTER (gene < 20), 0) / sum(value) < 40""")
def cell_quality(spark, d):
    return shaping.quality(counts(spark, d), "sample", "value", F.col("gene") < 20, (500, 50000), 30, 40)


@query("SELECT p_partkey, CAST(p_type = 'ECONOMY' AS INTEGER) AS economy, CAST(p_type = 'STANDARD' AS INTEGER) AS standard, CAST(p_type = 'PROMO' AS INTEGER) AS promo FROM part")
def label_attributes(spark, d):
    return shaping.one_hot(table(spark, d, "part"), "p_partkey", "p_type", TYPES)


@query(f"""WITH {MATRIX_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY sample) AS k FROM m), b AS (SELECT gene, value, row_number() OVER (PARTITION BY gene ORDER BY md5(gene || ':' || sample), sample) AS k FROM m)
SELECT a.sample, gene, b.value FROM a JOIN b USING (gene, k)""")
def scrambled_values(spark, d):
    return shaping.scrambled(counts(spark, d), "gene", "sample", "value")


@query(f"WITH {MATRIX_SQL} SELECT sample, gene, CAST(CAST('0x' || substr(md5(gene || ':' || sample), 1, 8) AS BIGINT) % 100 AS BIGINT) AS value FROM m")
def random_integers(spark, d):
    mixed = F.md5(F.concat_ws(":", F.col("gene").cast("string"), F.col("sample").cast("string")).cast("binary"))
    return counts(spark, d).select("sample", "gene", (F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") % 100).alias("value"))


# --- names

@query("""SELECT p_partkey, upper(regexp_replace(trim(p_name), '\\.[0-9]+$', '')) AS name FROM (SELECT p_partkey, p_name || '.' || p_size AS p_name FROM part)""")
def normalised_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", names.normal_id(F.concat(F.lit('"'), "p_name", F.lit("."), "p_size", F.lit('"')), upper=True).alias("name"))


@query("SELECT c_custkey, s_suppkey, c_acctbal > s_acctbal AS richer FROM customer JOIN supplier ON CAST(regexp_extract(c_name, '#([0-9]+)$', 1) AS BIGINT) = CAST(regexp_extract(s_name, '#([0-9]+)$', 1) AS BIGINT)")
def derived_keys(spark, d):
    c = table(spark, d, "customer").withColumn("core", names.core_number(F.col("c_name")))
    s = table(spark, d, "supplier").withColumn("core", names.core_number(F.col("s_name")))
    return c.join(s, "core").select("c_custkey", "s_suppkey", (F.col("c_acctbal") > F.col("s_acctbal")).alias("richer"))


@query("""WITH t AS (SELECT n_nationkey, n_name || (['idae', 'ales', 'cota', 'viria', ''])[n_nationkey % 5 + 1] AS taxon, n_regionkey AS depth FROM nation)
SELECT n_nationkey, CASE WHEN taxon LIKE '%idae' THEN 'family' WHEN taxon LIKE '%ales' THEN 'order' WHEN taxon LIKE '%cetes' THEN 'class' WHEN taxon LIKE '%cota' THEN 'phylum' WHEN taxon LIKE '%virae' THEN 'kingdom' WHEN taxon LIKE '%viria' THEN 'realm' WHEN depth = 1 THEN 'genus' WHEN depth = 2 THEN 'species' ELSE 'unranked' END AS rank FROM t""")
def suffix_ranks(spark, d):
    ends = F.array(*map(F.lit, ("idae", "ales", "cota", "viria", "")))
    taxon = F.concat("n_name", F.element_at(ends, (F.col("n_nationkey") % 5 + 1).cast("int")))
    return table(spark, d, "nation").select("n_nationkey", names.rank_of(taxon, F.col("n_regionkey"), {1: "genus", 2: "species"}).alias("rank"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_name, 'small') THEN 'small' WHEN p_name IN ('large ring', 'red box') THEN 'listed' WHEN p_type = 'PROMO' THEN 'promotion' WHEN p_type = 'ECONOMY' THEN 'economy' ELSE 'Other' END AS category FROM part""")
def category_ladder(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    looked = relational.lookup(kind, {"PROMO": "promotion", "ECONOMY": "economy"}, "Other")
    return table(spark, d, "part").select("p_partkey", F.when(name.startswith("small"), "small").when(name.isin("large ring", "red box"), "listed").otherwise(looked).alias("category"))


# --- joins and sets

@query("""WITH k AS (SELECT n_nationkey, st FROM nation, (SELECT unnest(['F', 'O', 'P']) AS st)), f AS (SELECT c_nationkey AS n_nationkey, o_orderstatus AS st, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1, 2)
SELECT n_nationkey, st, coalesce(n, 0) AS n FROM k LEFT JOIN f USING (n_nationkey, st)""")
def grid_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderstatus").alias("st")).agg(F.count(F.lit(1)).alias("n"))
    return shaping.grid(table(spark, d, "nation").select("n_nationkey"), STATUS, "st", found, "n")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def in_all_sets(spark, d):
    return shaping.in_all(table(spark, d, "orders"), "o_custkey", "o_orderstatus", 3)


@query("""WITH k AS (SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS names, bool_or(p_type = 'PROMO') AS matched FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p_partkey, coalesce(names, '') AS names, coalesce(matched, false) AS matched FROM part LEFT JOIN k USING (p_brand)""")
def cross_reference(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size > 45").select("p_brand", "p_type")
    return shaping.cross_reference(p.select("p_partkey", "p_brand"), known, "p_brand", "p_type", F.col("p_type") == "PROMO").drop("p_brand")


@query("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey > 1")
def right_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey > 1")
    return n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "right").select("s_suppkey", "n_name")


# --- reports

@query("""WITH w AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS t FROM orders GROUP BY 1)
SELECT o_orderpriority, CASE WHEN f = 0 THEN '' ELSE (100 * f // t) || '%' END AS F, CASE WHEN o = 0 THEN '' ELSE (100 * o // t) || '%' END AS O, CASE WHEN p = 0 THEN '' ELSE (100 * p // t) || '%' END AS P, t AS total FROM w""")
def share_text(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return shaping.share_text(n, "o_orderpriority", "o_orderstatus", STATUS, "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS tasks, round(sum(l_quantity * l_extendedprice / 3600000), 4) AS cpu_hours FROM lineitem GROUP BY 1, 2")
def cpu_hours(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice") / 3600000), 4).alias("cpu_hours"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) WHEN count(value) = 1 THEN 0 END, 6) AS sem FROM events GROUP BY 1")
def mean_error(spark, d):
    return shaping.mean_error(table(spark, d, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "sem")})


@query("""SELECT event_type, event_id FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE n >= 100 AND k <= 50""")
def capped_groups(spark, d):
    return shaping.capped(table(spark, d, "events"), "event_type", "event_id", 100, 50).select("event_type", "event_id")


@query("""WITH m AS (SELECT n_regionkey, n_name, avg(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, round(avg(b), 5) AS mean, round(stddev_samp(b), 5) AS std, string_agg(n_name, ';' ORDER BY n_name) AS members FROM m GROUP BY 1""")
def member_summary(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = c.groupBy("n_regionkey", "n_name").agg(F.avg("c_acctbal").alias("b"))
    return shaping.member_summary(means, "n_regionkey", "n_name", "b").withColumns({k: F.round(k, 5) for k in ("mean", "std")})


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share, round(sum(n) OVER (PARTITION BY p_brand ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY p_brand), 6) AS cumulative FROM n""")
def cumulative_share(spark, d):
    return shaping.shares(table(spark, d, "part"), "p_brand", "p_type").withColumns({c: F.round(c, 6) for c in ("share", "cumulative")})


@query("""WITH j AS (SELECT lang, n_chars > 800 AS said, quality = 1 AS t FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, count_if(said AND t) AS tp, count_if(NOT said AND NOT t) AS tn, count_if(said AND NOT t) AS fp, count_if(NOT said AND t) AS fn FROM j GROUP BY 1)
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM s""")
def outcome_accuracy(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return shaping.outcomes(j, ["lang"], F.col("n_chars") > 800, F.col("quality") == 1).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS l, quantile_cont(l_extendedprice, 0.99) AS h FROM lineitem GROUP BY 1)
SELECT l_partkey, count(*) AS n_outside FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice <= l OR l_extendedprice >= h GROUP BY 1""")
def exceeds_fence(spark, d):
    li = table(spark, d, "lineitem")
    return shaping.exceeding(li, statistics.fences(li, "l_extendedprice", ["l_returnflag"], "quantile"), ["l_returnflag"], "l_partkey", "l_extendedprice")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n)
SELECT user_id, coalesce(event_type, 'none') AS label FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (user_id)""")
def hard_label(spark, d):
    e = table(spark, d, "events")
    # absent labels count as none, by one aggregation over all rows
    label = F.when(F.col("value") > 5, F.col("event_type"))
    n = e.groupBy("user_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = relational.keep_first(n, ["user_id"], [F.col("label").isNull(), F.desc("n"), F.asc("label")])
    return best.select("user_id", F.coalesce("label", F.lit("none")).alias("label"))


# --- two samples

@query(f"""WITH {SIDE_SQL}, r AS (SELECT g, side, rank() OVER (PARTITION BY g ORDER BY value) + (count(*) OVER (PARTITION BY g, value) - 1) / 2 AS r, row_number() OVER (PARTITION BY g, side ORDER BY value) AS i FROM e),
s AS (SELECT g, count_if(side) AS n, count_if(NOT side) AS m, sum((r - i) * (r - i)) FILTER (side) AS x, sum((r - i) * (r - i)) FILTER (NOT side) AS y FROM r GROUP BY 1)
SELECT g, round((n * x + m * y) / (n * m * (n + m)) - (4.0 * n * m - 1) / (6 * (n + m)), 5) AS t FROM s""")
def cramer_von_mises(spark, d):
    return statistics.cramer_von_mises(sides(spark, d), "value", "side", ["g"]).select("g", F.round("t", 5).alias("t"))


@query(f"""WITH {SIDE_SQL}, v AS (SELECT g, value, count(*) AS l, count_if(side) AS a FROM e GROUP BY 1, 2),
c AS (SELECT g, l, sum(l) OVER w - l / 2 AS b, sum(a) OVER w - a / 2 AS ca, sum(l) OVER p AS n, sum(a) OVER p AS na FROM v WINDOW w AS (PARTITION BY g ORDER BY value), p AS (PARTITION BY g))
SELECT g, round(any_value((n - 1) / n) * (any_value(1 / na) * sum(l / n * (n * ca - na * b) ** 2 / (b * (n - b) - n * l / 4)) + any_value(1 / (n - na)) * sum(l / n * (n * (b - ca) - (n - na) * b) ** 2 / (b * (n - b) - n * l / 4))), 5) AS a2 FROM c WHERE b * (n - b) - n * l / 4 > 0 GROUP BY 1""")
def anderson_darling(spark, d):
    return statistics.anderson_darling(sides(spark, d), "value", "side", ["g"]).select("g", F.round("a2", 5).alias("a2"))


# --- vectors

@query(f"""WITH {HALVES_SQL} SELECT least(id, other) AS a, greatest(id, other) AS b, coalesce(max(similarity) FILTER (s = 1), 0) AS one, coalesce(max(similarity) FILTER (s = 2), 0) AS two FROM k WHERE rank <= 5 GROUP BY 1, 2""")
def top_union_edges(spark, d):
    ends = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    layers = [n.where("rank <= 5").select(*ends, "similarity", F.lit(name).alias("layer")) for name, n in zip(("one", "two"), half_spaces(spark, d), strict=True)]
    return layers[0].unionByName(layers[1]).groupBy("a", "b").pivot("layer", ["one", "two"]).agg(F.max("similarity")).na.fill(0.0, ["one", "two"])


@query(f"WITH {UNIT_SQL} SELECT u.id, round(sum(list_dot_product(u.v, q.v)), 6) AS similarity FROM u, u q WHERE q.id IN (3, 5, 8) AND u.id NOT IN (3, 5, 8) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def summed_similarity(spark, d):
    u = unit_rows(spark, d)
    queries = F.broadcast(u.where("id IN (3, 5, 8)").select(F.col("v").alias("q")))  # three rows
    s = u.where("id NOT IN (3, 5, 8)").join(queries).groupBy("id").agg(F.round(F.sum(vectors.dot(F.col("v"), F.col("q"))), 6).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "id").limit(20)


@query(f"""WITH {UNIT_SQL}, b AS (SELECT CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 20 AS s, v FROM u), e AS (SELECT s, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS p FROM b), c AS (SELECT s, p, sum(y) AS y FROM e GROUP BY 1, 2), l AS (SELECT s, list(y ORDER BY p) AS c FROM c GROUP BY 1)
SELECT s AS draw, round(list_dot_product(c, v) / sqrt(list_dot_product(c, c)), 6) AS similarity FROM l, (SELECT v FROM u WHERE id = 7)""")
def composite_null(spark, d):
    """Means of random sets of vectors against one vector."""
    u = unit_rows(spark, d)
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 20
    return vectors.drawn(u, draw, u.where("id = 7"))


# --- markers

@query(f"""WITH {MATRIX_SQL}, x AS (SELECT DISTINCT sample FROM m), y AS (SELECT DISTINCT gene FROM m), f AS (SELECT x.sample % 4 AS grp, gene, coalesce(value, 0) AS v FROM x CROSS JOIN y LEFT JOIN m USING (sample, gene)),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS r FROM f),
s AS (SELECT gene, grp, sum(r) AS r, count(*) AS n, avg(v) AS inside, avg(CAST(v > 0 AS INTEGER)) AS p, count_if(v > 0) AS c, sum(v) AS t FROM r GROUP BY 1, 2),
z AS (SELECT *, sum(n) OVER w AS total, sum(t) OVER w AS tt, sum(c) OVER w AS cc FROM s WINDOW w AS (PARTITION BY gene))
SELECT gene, CAST(grp AS BIGINT) AS grp, round(r - n * (n + 1) / 2, 1) AS u, round((r - n * (n + 1) / 2 - n * (total - n) / 2) / sqrt(n * (total - n) * (total + 1) / 12), 5) AS z,
round(log2((t / n + 1) / ((tt - t) / (total - n) + 1)), 5) AS logfc, round(p, 6) AS pct_in, round((cc - c) / (total - n), 6) AS pct_out FROM z""")
def markers(spark, d):
    m = counts(spark, d)
    groups = m.select("sample").distinct().withColumn("grp", F.col("sample") % 4)
    r = statistics.markers(m, groups)
    return r.select("gene", "grp", F.round("u", 1).alias("u"), F.round("z", 5).alias("z"), F.round("logfc", 5).alias("logfc"), F.round("pct_in", 6).alias("pct_in"), F.round("pct_out", 6).alias("pct_out"))


@query("""WITH c AS (SELECT n_regionkey AS r, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, s) AS k, first_value(r) OVER (PARTITION BY s ORDER BY n DESC, r) AS home FROM c)
SELECT r, s, CASE WHEN home = r THEN 'same' WHEN k <= 3 THEN 'novel' ELSE 'other' END AS kind, CAST(home AS BIGINT) AS home FROM k""")
def marker_reference(spark, d):
    """Labels of a group known for it, its strongest that aren't, and those of others."""
    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r"), F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("n"), "s"))
    home = F.first("r").over(Window.partitionBy("s").orderBy(F.desc("n"), "r"))
    both = n.select("r", "s", k.alias("k"), home.cast("bigint").alias("home"))
    return both.select("r", "s", F.when(F.col("home") == F.col("r"), "same").when(F.col("k") <= 3, "novel").otherwise("other").alias("kind"), "home")


# --- robust scales and distances of points

@query(f"""WITH {MATRIX_SQL}, q AS (SELECT sample, quantile_cont(value, 0.05) AS l, quantile_cont(value, 0.95) AS h FROM m GROUP BY 1), w AS (SELECT sample, gene, greatest(least(value, h), l) AS v FROM m JOIN q USING (sample)),
c AS (SELECT sample, median(v) AS c, stddev_samp(v) AS s FROM w GROUP BY 1), d AS (SELECT sample, 1.4826 * median(abs(v - c)) AS d FROM w JOIN c USING (sample) GROUP BY 1), e AS (SELECT sample, c, CASE WHEN d > 1e-12 THEN d WHEN s > 1e-12 THEN s END AS e FROM c JOIN d USING (sample))
SELECT sample, gene, round((v - c) / e, 5) AS value FROM w JOIN e USING (sample) WHERE e IS NOT NULL""")
def robust_scale(spark, d):
    m = Stored(spark).table(counts(spark, d), "matrix", keep=True, spread=True)  # read twice
    return statistics.robust_scaled(m, "value", ["sample"], within=(0.05, 0.95)).select("sample", "gene", F.round("value", 5).alias("value"))


@query("""WITH p AS (SELECT l_returnflag AS g, l_linestatus = 'F' AS side, unnest(range(8)) AS k, l_quantity AS x, l_discount * 100 AS y FROM lineitem), e AS (SELECT g, side, k, cos(k * pi() / 8) * x + sin(k * pi() / 8) * y AS value FROM p),
v AS (SELECT g, k, value, count_if(side) AS a, count_if(NOT side) AS b FROM e GROUP BY 1, 2, 3), c AS (SELECT g, k, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS x, coalesce(lead(value) OVER w - value, 0) AS w FROM v WINDOW w AS (PARTITION BY g, k ORDER BY value), p AS (PARTITION BY g, k))
SELECT g, round(avg(s), 4) AS sliced FROM (SELECT g, k, sum(x * w) AS s FROM c GROUP BY 1, 2) GROUP BY 1""")
def sliced_distance(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_linestatus") == "F").alias("side"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return statistics.sliced_distance(p, "x", "y", "side", ["g"]).withColumn("sliced", F.round("sliced", 4))
