"""All queries over the driver's tables, with the SQL that must give the same rows.

The analyses' tables are mapped to the driver's: sample = supplier, gene = part,
value = ordered quantity; embeddings stand for gene vectors, documents for run
descriptions, regions and nations for a taxonomy.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.operators import graph, inference, matrix, ordered, relational, statistics, vectors
from archivolt.plans.registry import query
from archivolt.sources import text_formats
from archivolt.sources.tables import table

#: The levels of o_orderstatus.
STATUS = ["F", "O", "P"]


# --- funnel and deduplication

@query("""WITH o AS (SELECT o_orderpriority AS grp, o_orderstatus AS st, o_totalprice AS v FROM orders),
p AS (SELECT grp, count(*) FILTER (st = 'F') AS F, count(*) FILTER (st = 'O') AS O, count(*) FILTER (st = 'P') AS P FROM o GROUP BY grp)
SELECT grp, F, O, P, F + O + P AS total FROM p""")
def funnel_pivot(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("st")).agg(F.count(F.lit(1)).alias("n"))
    return relational.pivot_total(n, "grp", "st", STATUS, "n")


@query("""SELECT stage, l_returnflag, count(amount) AS n, round(sum(amount), 2) AS total FROM (
SELECT 'a' AS stage, l_returnflag, CASE WHEN l_quantity > 10 THEN l_quantity END AS amount FROM lineitem UNION ALL
SELECT 'b', l_returnflag, CASE WHEN l_quantity > 40 THEN l_quantity END FROM lineitem) GROUP BY stage, l_returnflag""")
def stage_funnel(spark, d):
    li = table(spark, d, "lineitem")
    cols = li.select("l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("a"), F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("b"))
    return relational.stage_funnel(cols, ["a", "b"], "l_returnflag").withColumn("total", F.round("total", 2))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1""")
def dedup_best_status(spark, d):
    return relational.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.desc_nulls_last("value"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


# --- aggregation

@query("""WITH c AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1), m AS (SELECT avg(n) AS x FROM c)
SELECT CASE WHEN n < 80 THEN 'other' ELSE b END AS p_brand, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(n) / (SELECT count(*) FROM part), 4) AS pct FROM c GROUP BY 1""")
def totals_relabel_small(spark, d):
    return relational.relabel_small(table(spark, d, "part").select("p_brand"), "p_brand", 80)


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab_margins(spark, d):
    return relational.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, count_if(c_acctbal < 0) AS negative, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS med, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high FROM customer GROUP BY 1""")
def group_summary(spark, d):
    v = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.count_if(F.col(v) < 0).alias("negative"), F.round(F.percentile(v, 0.25), 4).alias("q1"), F.round(F.median(v), 4).alias("med"), F.round(F.percentile(v, 0.75), 4).alias("q3"), F.round(F.min(v), 2).alias("low"), F.round(F.max(v), 2).alias("high"))


@query("""SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def mode_per_group(spark, d):
    return relational.mode(table(spark, d, "part"), ["p_brand"], "p_type")


@query("""WITH e AS (SELECT CASE WHEN l_discount <= 0.02 THEN 1 WHEN l_discount <= 0.05 THEN 2 WHEN l_discount <= 0.08 THEN 3 WHEN l_discount <= 0.1 THEN 4 END AS bin FROM lineitem WHERE l_discount >= 0),
n AS (SELECT bin, count(*) AS n FROM e WHERE bin IS NOT NULL GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative FROM n""")
def jaccard_bins(spark, d):
    return relational.bins(table(spark, d, "lineitem"), "l_discount", [0.0, 0.02, 0.05, 0.08, 0.1])


@query("""SELECT l_suppkey % 7 AS run, CAST(round_even(sum(l_extendedprice), 0) AS BIGINT) AS total FROM lineitem GROUP BY 1""")
def column_collapse(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("run")).agg(F.bround(F.sum("l_extendedprice"), 0).cast("long").alias("total"))


@query("""WITH f AS (SELECT l_suppkey % 5 AS run, CAST(l_orderkey % 4096 AS INTEGER) AS flag, l_linenumber AS n FROM lineitem),
u AS (SELECT * FROM f WHERE flag & 128 = 0 AND flag & 512 = 0 AND flag & 2048 = 0),
s AS (SELECT run, CAST(coalesce(sum(n) FILTER (flag & 256 = 0), 0) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (flag & 256 <> 0), 0) AS BIGINT) AS multi,
CAST(coalesce(sum(n) FILTER (flag & 256 = 0 AND (flag & 5 = 4 OR flag & 13 > 4)), 0) AS BIGINT) AS unaligned,
CAST(coalesce(sum(n) FILTER (flag & 256 = 0 AND flag & 4 = 0 AND flag & 8 = 0), 0) AS BIGINT) AS aligned,
CAST(coalesce(sum(n) FILTER (flag & 256 = 0 AND flag & 13 IN (5, 9)), 0) AS BIGINT) AS mixed FROM u GROUP BY run)
SELECT *, aligned - multi AS "unique" FROM s""")
def alignment_flags(spark, d):
    f = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("run"), (F.col("l_orderkey") % 4096).cast("int").alias("flag"), F.col("l_linenumber").alias("n"))
    return text_formats.alignment_flags(f, "flag", "n", ["run"])


# --- joins

@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def left_chain(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("""WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT DISTINCT nullif(s_nationkey, 3) AS k FROM supplier)
SELECT a.c_custkey, a.k FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    b = table(spark, d, "supplier").select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k")).distinct()
    return relational.null_safe(a, b, ["k"]).select("c_custkey", "k")


@query("""SELECT c_custkey, CASE WHEN s_nationkey IS NOT NULL THEN 'listed' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) ON c_custkey = s_suppkey""")
def override_join(spark, d):
    changes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("listed").alias("c_mktsegment"))
    return relational.override(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)""")
def anti_new(spark, d):
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    o = o.where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").join(s, F.col("c_custkey") == s.s_suppkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_listed(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1), n AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey > 4)
SELECT coalesce(c.k, s.k, n.k) AS k, customers, suppliers, n_name FROM c FULL JOIN s ON c.k = s.k FULL JOIN n ON n.k = coalesce(c.k, s.k)""")
def outer_reduce(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return relational.outer_all([c, s, table(spark, d, "nation").where("n_nationkey > 4").select(F.col("n_nationkey").alias("k"), "n_name")], "k")


@query("""SELECT s_suppkey, CASE s_nationkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' ELSE 'unknown' END AS side FROM supplier""")
def lookup_default(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", relational.lookup(F.col("s_nationkey").cast("string"), {"0": "south", "1": "west", "2": "east"}, "unknown").alias("side"))


@query("""(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'no supplier' FROM nation EXCEPT SELECT s_nationkey, 'no supplier' FROM supplier)""")
def set_operations(spark, d):
    c, s, n = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(n.subtract(s).withColumn("side", F.lit("no supplier")))


# --- windows and shaping

@query("""SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3""")
def topk_per_group(spark, d):
    return relational.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part""")
def average_rank(spark, d):
    return relational.average_rank(table(spark, d, "part"), "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("""SELECT y, p, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share, CAST(sum(n) OVER (PARTITION BY y ORDER BY p) AS BIGINT) AS upto FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)""")
def year_panel(spark, d):
    n = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("y")
    return n.select("y", "p", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.sum("n").over(w.orderBy("p")).alias("upto"))


@query("""WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT coalesce(CAST(t.c_nationkey AS VARCHAR), 'Other') AS nation, count(*) AS n FROM customer c LEFT JOIN t USING (c_nationkey) GROUP BY 1""")
def topn_else_other(spark, d):
    c = table(spark, d, "customer").select("c_nationkey").groupBy("c_nationkey").count()
    top = c.orderBy(F.desc("count"), "c_nationkey").limit(5).select(F.col("c_nationkey").alias("t"))
    return c.join(F.broadcast(top), F.col("c_nationkey") == F.col("t"), "left").groupBy(F.coalesce(F.col("t").cast("string"), F.lit("Other")).alias("nation")).agg(F.sum("count").alias("n"))


@query("""SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_size > 40 THEN 'big' ELSE 'Other' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def contains_ladder(spark, d):
    p = table(spark, d, "part")
    kind = relational.contains_ladder(F.col("p_type"), [("STEEL", "steel"), ("BRASS", "brass")])
    return p.groupBy(F.when((kind == "Other") & (F.col("p_size") > 40), "big").otherwise(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k, v, n FROM (SELECT 'segment' AS k, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2)""")
def distinct_dump(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return c.unpivot([], ["segment", "nation"], "k", "v").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a ')) AS anchors, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_attributes(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("anchors"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# --- text

@query("""WITH s AS (SELECT doc_id, 10 * len(regexp_extract_all(lower(text), 'the')) AS a, 100 * len(regexp_extract_all(lower(text), 'tion')) AS b, 1000 * len(regexp_extract_all(lower(text), 'license')) AS c FROM documents)
SELECT doc_id, a AS article, b AS noun, c AS license, CASE WHEN greatest(a, b, c) <= 0 THEN 'unknown' WHEN a >= b AND a >= c THEN 'article' WHEN b >= c THEN 'noun' ELSE 'license' END AS label FROM s""")
def weighted_text_score(spark, d):
    t = F.col("text")
    scores = [("article", 10 * T.matches(t, "the")), ("noun", 100 * T.matches(t, "tion")), ("license", 1000 * T.matches(t, "license"))]
    s = table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in scores))
    return s.withColumn("label", T.arg_max([(n, F.col(n)) for n, _ in scores]))


@query("""SELECT doc_id, concat_ws('|', CASE WHEN quality = 1 AND n_chars < 300 THEN 'good_short' END, CASE WHEN quality = 0 AND toxic = 1 THEN 'bad_toxic' END, CASE WHEN lang <> 'en' AND toxic = 1 THEN 'foreign_toxic' END) AS flags FROM documents JOIN labels USING (doc_id)""")
def conflict_flags(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    q, x = F.col("quality"), F.col("toxic")
    return j.select("doc_id", T.flags([("good_short", (q == 1) & (F.col("n_chars") < 300)), ("bad_toxic", (q == 0) & (x == 1)), ("foreign_toxic", (F.col("lang") != "en") & (x == 1))]).alias("flags"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'License') THEN 'license' WHEN regexp_matches(text, '[0-9]+@') THEN 'mail' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noise' ELSE 'none' END AS rule FROM documents""")
def rule_categories(spark, d):
    return table(spark, d, "documents").select("doc_id", relational.contains_ladder(F.col("text"), [("License", "license"), ("[0-9]+@", "mail"), ("[#$%&*]{3}", "noise")], "none").alias("rule"))


@query()
def fuzzy_stage(spark, d):
    said = table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" collected at "), F.col("doc_id") % 72, F.lit(" hours post-fertlization")).alias("t"))
    return said.select("doc_id", T.stage(F.col("t")).alias("s")).select("doc_id", "s.value", "s.phrase")


@query("""WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents), n AS (SELECT lang, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT lang, w AS token, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) + 1 AS INTEGER) AS id FROM n WHERE n >= 20
UNION ALL SELECT lang, t, CAST(0 AS BIGINT), i FROM (SELECT DISTINCT lang FROM n WHERE n >= 20), (VALUES ('<pad>', 0), ('<mask>', 1)) v(t, i)""")
def vocabulary(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("token")).where("token <> ''")
    n = w.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    numbered = n.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token")) + 1)
    special = n.select("lang").distinct().select("lang", F.inline(F.array(F.struct(F.lit("<pad>").alias("token"), F.lit(0).alias("id")), F.struct(F.lit("<mask>").alias("token"), F.lit(1).alias("id")))))
    return numbered.unionByName(special.withColumn("n", F.lit(0).cast("long")))


@query("""WITH a AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM benchmark), b AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents) SELECT token FROM a WHERE token NOT IN (SELECT token FROM b)""")
def token_difference(spark, d):
    a, b = (table(spark, d, t).select(F.explode(F.split("text", " ")).alias("token")).distinct() for t in ("benchmark", "documents"))
    return a.join(b, "token", "left_anti")


# --- count matrices

MATRIX_SQL = "m AS (SELECT l_suppkey AS sample, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def counts(spark, d):
    """The whole of lineitem as a sparse matrix."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {MATRIX_SQL} SELECT sample, gene, round(log2(value / sum(value) OVER (PARTITION BY sample) * 1e6 + 1), 6) AS log_cpm FROM m")
def cpm_log(spark, d):
    return matrix.cpm(counts(spark, d)).select("sample", "gene", F.round(F.log2(F.col("cpm") + 1), 6).alias("log_cpm"))


@query(f"""WITH {MATRIX_SQL}, a AS (SELECT * FROM m WHERE value <> 0), b AS (SELECT * FROM a WHERE sample IN (SELECT sample FROM a GROUP BY 1 HAVING max(value) >= 60)),
c AS (SELECT * FROM b WHERE gene IN (SELECT gene FROM b GROUP BY 1 HAVING max(value) >= 60)), s AS (SELECT count(DISTINCT sample) AS s, count(DISTINCT gene) AS g FROM c)
SELECT * FROM c WHERE sample IN (SELECT sample FROM c GROUP BY 1 HAVING (SELECT g FROM s) - count(*) <= 0.98 * (SELECT g FROM s)) AND gene IN (SELECT gene FROM c GROUP BY 1 HAVING (SELECT s FROM s) - count(*) <= 0.98 * (SELECT s FROM s))""")
def filter_explicit(spark, d):
    return matrix.filtered(counts(spark, d), 60, 0.98).select("sample", "gene", "value")


def z_sql(by: str, other: str) -> str:
    return f"""WITH {MATRIX_SQL}, n AS (SELECT count(DISTINCT {other}) AS n FROM m), s AS (SELECT {by}, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) AS q FROM m, n GROUP BY 1),
d AS (SELECT {by}, mean, CASE WHEN q - mean * mean > 1e-12 * q THEN sqrt(q - mean * mean) END AS sd FROM s)
SELECT sample, gene, round(coalesce((value - mean) / sd, 0), 5) AS z, round(coalesce(-mean / sd, 0), 5) AS z_absent FROM m JOIN d USING ({by})"""


@query(z_sql("gene", "sample"))
def zscore_gene(spark, d):
    return matrix.zscore(counts(spark, d)).select("sample", "gene", F.round("z", 5).alias("z"), F.round("z_absent", 5).alias("z_absent"))


@query(z_sql("sample", "gene"))
def zscore_sample(spark, d):
    return matrix.zscore(counts(spark, d), "sample").select("sample", "gene", F.round("z", 5).alias("z"), F.round("z_absent", 5).alias("z_absent"))


TMM_SQL = f"""{MATRIX_SQL}, g AS (SELECT count(DISTINCT gene) AS g FROM m), zr AS (SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value, gene) - 1 AS r, count(*) OVER (PARTITION BY sample) AS c FROM m),
z AS (SELECT sample, sum(value) AS lib, sum(sqrt(value)) AS roots, (coalesce(max(value) FILTER (r = floor((g - 1) * 0.75) - (g - c)), 0) * (1 - ((any_value(g) - 1) * 0.75 - floor((any_value(g) - 1) * 0.75))) + coalesce(max(value) FILTER (r = ceil((g - 1) * 0.75) - (g - c)), 0) * ((any_value(g) - 1) * 0.75 - floor((any_value(g) - 1) * 0.75))) / sum(value) AS f FROM zr, g GROUP BY 1),
r AS (SELECT sample AS ref, lib AS rl FROM z ORDER BY CASE WHEN (SELECT max(f) FROM z) > 0 THEN round(abs(f - (SELECT avg(f) FROM z)), 12) ELSE -round(roots, 6) END, sample LIMIT 1),
b AS (SELECT m.sample, m.gene, m.value AS v, q.value AS rv, lib, rl FROM m JOIN z USING (sample) JOIN m q ON q.gene = m.gene JOIN r ON q.sample = r.ref WHERE m.value > 0 AND q.value > 0),
x AS (SELECT sample, gene, log2((v / lib) / (rv / rl)) AS mm, (log2(v / lib) + log2(rv / rl)) / 2 AS a, (lib - v) / lib / v + (rl - rv) / rl / rv AS w FROM b),
y AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY round(mm, 9), gene) AS rm, row_number() OVER (PARTITION BY sample ORDER BY round(a, 9), gene) AS ra FROM x),
k AS (SELECT sample, sum(mm / w) / sum(1 / w) AS lf FROM y WHERE rm > floor(n * 0.3) AND rm <= n - floor(n * 0.3) AND ra > floor(n * 0.05) AND ra <= n - floor(n * 0.05) GROUP BY 1),
e AS (SELECT sample, lib, coalesce(lf, 0) AS lf FROM z LEFT JOIN k USING (sample)), t AS (SELECT sample, lib, pow(2, lf - avg(lf) OVER ()) AS factor FROM e)"""


@query(f"WITH {TMM_SQL} SELECT sample, round(factor, 5) AS factor FROM t")
def tmm_factors(spark, d):
    return matrix.tmm_factors(counts(spark, d)).select("sample", F.round("factor", 5).alias("factor"))


@query(f"WITH {TMM_SQL} SELECT sample, gene, round(log2(value / (lib * factor) * 1e6 + 0.25), 5) AS value FROM m JOIN t USING (sample)")
def tmm_cpm(spark, d):
    return matrix.scaled(counts(spark, d), "logtmm").withColumn("value", F.round("value", 5))


def r_sql(cells: str, of: str, by: str) -> str:
    return f"""WITH {MATRIX_SQL}, {cells}, n AS (SELECT count(DISTINCT {by}) AS n FROM m), s AS (SELECT {of} AS k, sum(value) AS s, sum(value * value) AS q FROM c GROUP BY 1),
p AS (SELECT x.{of} AS a, y.{of} AS b, sum(x.value * y.value) AS xy, count(*) AS n FROM c x JOIN c y ON x.{by} = y.{by} AND x.{of} < y.{of} GROUP BY 1, 2)
SELECT a, b, round((xy - u.s * v.s / n.n) / sqrt(nullif((u.q - u.s * u.s / n.n) * (v.q - v.s * v.s / n.n), 0)), 5) AS r, p.n AS n FROM p JOIN s u ON u.k = a JOIN s v ON v.k = b, n"""


@query(r_sql("c AS (SELECT * FROM m)", "sample", "gene"))
def correlation_pearson(spark, d):
    return matrix.correlation(counts(spark, d)).withColumn("r", F.round("r", 5))


@query(f"""WITH {MATRIX_SQL}, g AS (SELECT gene, median(value) AS md FROM m WHERE value > 0 GROUP BY 1), s AS (SELECT sample, gene, round(value / md, 9) AS s FROM m JOIN g USING (gene) WHERE value > 0),
p AS (SELECT sample, gene, CAST(row_number() OVER (PARTITION BY sample ORDER BY s DESC, gene) AS INTEGER) AS pos FROM s) SELECT sample, pos, gene FROM p WHERE pos <= 64""")
def rank_tokens(spark, d):
    return matrix.rank_tokens(counts(spark, d), 64)


# --- group statistics

SIDE_SQL = "e AS (SELECT event_type AS g, value, user_id % 3 = 0 AS side FROM events WHERE value IS NOT NULL)"


def sides(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 3 == 0).alias("side"))


@query(f"""WITH {SIDE_SQL}, m AS (SELECT g, side, median(value) AS m FROM e GROUP BY 1, 2), v AS (SELECT g, side, any_value(m) AS m, 1.4826 * median(abs(value - m)) AS mad FROM e JOIN m USING (g, side) GROUP BY 1, 2)
SELECT g, round(max(m) FILTER (side), 5) AS med_in, round(max(m) FILTER (NOT side), 5) AS med_out, round(max(m) FILTER (side) - max(m) FILTER (NOT side), 5) AS diff, round(max(mad) FILTER (NOT side), 5) AS mad_out FROM v GROUP BY 1""")
def median_shift(spark, d):
    r = statistics.two_medians(sides(spark, d), "value", "side", ["g"])
    return r.select("g", *(F.round(c, 5).alias(c) for c in ("med_in", "med_out", "diff", "mad_out")))


@query(f"""WITH {SIDE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY value) AS r, count(*) OVER (PARTITION BY g, side) AS n FROM e) SELECT g, side, round(avg(value), 5) AS trimmed FROM r WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2""")
def trimmed_means(spark, d):
    return statistics.trimmed_mean(sides(spark, d), "value", ["g", "side"], 0.2).withColumn("trimmed", F.round("trimmed", 5))


@query(f"""WITH {SIDE_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY value) + (count(*) OVER (PARTITION BY g, value) - 1) / 2 AS r FROM e), s AS (SELECT g, sum(r) FILTER (side) AS r, count_if(side) AS n, count_if(NOT side) AS m FROM r GROUP BY 1), u AS (SELECT *, r - n * (n + 1) / 2 AS u FROM s)
SELECT g, round(u, 1) AS u, round(u / (n * m), 6) AS a, round(2 * u / (n * m) - 1, 6) AS delta, round((u - n * m / 2) / sqrt(n * m * (n + m + 1) / 12), 5) AS z FROM u""")
def ranksum_dominance(spark, d):
    r = statistics.dominance(sides(spark, d), "value", "side", ["g"])
    return r.select("g", F.round("u", 1).alias("u"), F.round("a", 6).alias("a"), F.round("delta", 6).alias("delta"), F.round("z", 5).alias("z"))


@query(f"""WITH {SIDE_SQL}, v AS (SELECT g, value, count_if(side) AS a, count_if(NOT side) AS b FROM e GROUP BY 1, 2), c AS (SELECT g, value, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS x, coalesce(lead(value) OVER w - value, 0) AS w FROM v WINDOW w AS (PARTITION BY g ORDER BY value), p AS (PARTITION BY g))
SELECT g, round(sum(x * w), 5) AS wasserstein, round(max(x), 6) AS ks FROM c GROUP BY 1""")
def distribution_distance(spark, d):
    return statistics.distances(sides(spark, d), "value", "side", ["g"]).select("g", F.round("wasserstein", 5).alias("wasserstein"), F.round("ks", 6).alias("ks"))


@query(f"""WITH {SIDE_SQL}, q AS (SELECT g, unnest([1, 3, 5, 7, 9]) AS decile, quantile_cont(value, [0.1, 0.3, 0.5, 0.7, 0.9]) FILTER (side) AS a, quantile_cont(value, [0.1, 0.3, 0.5, 0.7, 0.9]) FILTER (NOT side) AS b FROM e GROUP BY g) SELECT g, decile, round(a[(decile + 1) // 2] - b[(decile + 1) // 2], 5) AS shift FROM q""")
def shift_function(spark, d):
    q = ordered.quantiles(sides(spark, d), ["g", "side"], "value", {f"q{k}": k / 10 for k in (1, 3, 5, 7, 9)})
    moved = lambda c: F.max(F.when(F.col("side"), F.col(c))) - F.max(F.when(~F.col("side"), F.col(c)))
    wide = q.groupBy("g").agg(F.array(*(F.struct(F.lit(k).alias("decile"), F.round(moved(f"q{k}"), 5).alias("shift")) for k in (1, 3, 5, 7, 9))).alias("s"))
    return wide.select("g", F.inline("s"))


@query(f"WITH {SIDE_SQL} SELECT g, round(avg(CAST(value > 50 AS INTEGER)) FILTER (side) - avg(CAST(value > 50 AS INTEGER)) FILTER (NOT side), 6) AS rate_diff FROM e GROUP BY 1")
def detection_rate(spark, d):
    hit = (F.col("value") > 50).cast("int")
    return sides(spark, d).groupBy("g").agg(F.round(F.avg(F.when(F.col("side"), hit)) - F.avg(F.when(~F.col("side"), hit)), 6).alias("rate_diff"))


@query(f"""WITH {SIDE_SQL}, s AS (SELECT g, avg(value) FILTER (side) - avg(value) FILTER (NOT side) AS x, var_samp(value) FILTER (side) / count_if(side) AS a, var_samp(value) FILTER (NOT side) / count_if(NOT side) AS b, count_if(side) AS n, count_if(NOT side) AS m FROM e GROUP BY 1) SELECT g, round(x / sqrt(a + b), 5) AS t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)), 3) AS df FROM s""")
def welch_t(spark, d):
    return statistics.welch(sides(spark, d), "value", "side", ["g"]).select("g", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


def _fence_query(kind: str, sql: str) -> None:
    def f(spark, d):
        r = statistics.fences(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], kind)
        return r.select("l_returnflag", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))

    f.__name__ = f"fences_{kind}"
    query(sql)(f)


_fence_query("tukey", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS l, quantile_cont(l_extendedprice, 0.75) AS h FROM lineitem GROUP BY 1) SELECT l_returnflag, round(l - 1.5 * (h - l), 8) AS lower, round(h + 1.5 * (h - l), 8) AS upper FROM q")
_fence_query("quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 8) AS lower, round(quantile_cont(l_extendedprice, 0.99), 8) AS upper FROM lineitem GROUP BY 1")
_fence_query("mad", "WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1), v AS (SELECT l_returnflag, any_value(m) AS m, 3 * 1.4826 * median(abs(l_extendedprice - m)) AS x FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, round(m - x, 8) AS lower, round(m + x, 8) AS upper FROM v")


@query("""WITH s AS (SELECT n_chars, count_if(quality = 1) AS t, count_if(quality <> 1) AS f FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT t, f, sum(t) OVER w AS ct, sum(f) OVER w AS cf, sum(t) OVER () AS p, sum(f) OVER () AS n FROM s WINDOW w AS (ORDER BY n_chars DESC))
SELECT round(sum(t / p * ct / (ct + cf)), 6) AS ap, round((sum(t / p * ct / (ct + cf)) - max(p / (p + n))) / (1 - max(p / (p + n))), 6) AS normalised_ap, round(sum(f / n * (ct - t / 2) / p), 6) AS auc FROM c""")
def ranking_curves(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return statistics.curve(j, "n_chars", F.col("quality") == 1).select(*(F.round(c, 6).alias(c) for c in ("ap", "normalised_ap", "auc")))


@query("""WITH s AS (SELECT n_chars, count_if(quality = 1) AS t, count_if(quality <> 1) AS f FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT n_chars, sum(t) OVER w AS ct, sum(f) OVER w AS cf, sum(t) OVER () AS p, sum(f) OVER () AS n FROM s WINDOW w AS (ORDER BY n_chars DESC))
SELECT n_chars, round(ct / (ct + cf), 6) AS precision, round(ct / p, 6) AS recall, round(cf / n, 6) AS fpr FROM c""")
def curve_points(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return statistics.curve_points(j, "n_chars", F.col("quality") == 1).select("n_chars", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")))


@query("""SELECT quality, toxic, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY quality), 4) AS pct FROM labels GROUP BY 1, 2""")
def confusion_normalised(spark, d):
    n = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("quality")), 4))


# --- vectors, graphs, taxonomy

UNIT_SQL = "x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings), u AS (SELECT id, list_transform(r, lambda y: y / sqrt(list_sum(list_transform(r, lambda z: z * z)))) AS v FROM x)"


def unit_rows(spark, d):
    return vectors.units(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"WITH {UNIT_SQL} SELECT u.id, round(list_dot_product(u.v, q.v), 6) AS similarity FROM u, u q WHERE q.id = 7")
def cosine_rank(spark, d):
    u = unit_rows(spark, d)
    return vectors.ranked(u, vectors.query_vector(u, [7]))


@query(f"""WITH {UNIT_SQL}, e AS (SELECT unnest(v) AS y, unnest(range(1, len(v) + 1)) AS p FROM u WHERE id IN (3, 5, 8)), s AS (SELECT list(y ORDER BY p) AS q FROM (SELECT p, sum(y) AS y FROM e GROUP BY p)) SELECT id, round(list_cosine_similarity(v, q), 6) AS similarity FROM u, s""")
def composite_query(spark, d):
    u = unit_rows(spark, d)
    return vectors.ranked(u, vectors.query_vector(u, [3, 5, 8]))


KNN_SQL = f"{UNIT_SQL}, n AS (SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM n QUALIFY rank <= 10)"


def knn(spark, d):
    u = unit_rows(spark, d)
    return vectors.neighbours(u, u.where("id % 20 = 0"), 10)


@query(f"WITH {KNN_SQL} SELECT id, other, similarity, CAST(rank AS INTEGER) AS rank FROM k")
def knn_rows(spark, d):
    return knn(spark, d)


@query(f"WITH {KNN_SQL} SELECT least(id, other) AS a, greatest(id, other) AS b, max(similarity) AS weight, greatest(round(1 - max(similarity), 6), 0) AS distance FROM k WHERE similarity >= 0.1 GROUP BY 1, 2")
def knn_symmetric_graph(spark, d):
    return vectors.symmetric(knn(spark, d), 0.1)


@query("""WITH c AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT 'life' AS path, CAST(sum(n) AS BIGINT) AS n, CAST(1 AS INTEGER) AS depth FROM c UNION ALL SELECT 'life;' || r_name, CAST(sum(n) AS BIGINT), 2 FROM c GROUP BY r_name UNION ALL SELECT 'life;' || r_name || ';' || n_name, n, 3 FROM c""")
def taxon_rollup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    leaf = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).groupBy(F.array(F.lit("life"), "r_name", "n_name").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    up = leaf.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.slice("p", 1, k))).alias("p"), "n")
    return up.groupBy(F.concat_ws(";", "p").alias("path"), F.size("p").alias("depth")).agg(F.sum("n").alias("n"))


# --- more graphs

HALVES_SQL = """x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings), h AS (SELECT id, 1 AS s, r[1:len(r) // 2] AS r FROM x UNION ALL SELECT id, 2, r[len(r) // 2 + 1:] FROM x),
u AS (SELECT id, s, list_transform(r, lambda y: y / sqrt(list_sum(list_transform(r, lambda z: z * z)))) AS v FROM h),
n AS (SELECT a.s, a.id, b.id AS other, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id AND a.s = b.s WHERE a.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY s, id ORDER BY similarity DESC, other) AS rank FROM n QUALIFY rank <= 10)"""


def half_spaces(spark, d):
    """Nearest neighbours in the first and in the second half of the dimensions."""
    e, half = table(spark, d, "embeddings"), F.floor(F.size("embedding") / 2).cast("int")
    out = []
    for part in (F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, F.size("embedding") - half)):
        u = vectors.units(e.select("vec_id", part.alias("part")), "vec_id", "part")
        out.append(vectors.neighbours(u, u.where("id % 20 = 0"), 10))
    return out


@query(f"""WITH {HALVES_SQL}, l AS (SELECT id, list(other) FILTER (s = 1) AS p, list(other) FILTER (s = 2) AS q FROM k GROUP BY 1)
SELECT id, len(list_intersect(p, q)) AS shared, len(list_distinct(list_concat(p, q))) AS joined, round(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) AS jaccard, round(len(list_intersect(p, q)) / least(len(p), len(q)), 6) AS coefficient, array_to_string(list_sort(list_intersect(p, q)), ';') AS both FROM l""")
def neighbour_overlap(spark, d):
    return vectors.overlap(*half_spaces(spark, d))


@query(f"WITH {HALVES_SQL} SELECT least(id, other) AS a, greatest(id, other) AS b, CASE s WHEN 1 THEN 'one' ELSE 'two' END AS type, max(similarity) AS weight FROM k WHERE abs(similarity) > 0.3 GROUP BY 1, 2, 3")
def multiplex_edges(spark, d):
    one, two = half_spaces(spark, d)
    return graph.layer(one, "one", 0.3).unionByName(graph.layer(two, "two", 0.3))


@query(f"""WITH {KNN_SQL}, e AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(similarity) AS w FROM k WHERE abs(similarity) > 0.4 GROUP BY 1, 2),
f AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, similarity AS w FROM k WHERE rank = 1), j AS (SELECT a, b, w FROM e UNION ALL SELECT f.a, f.b, f.w FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = f.a AND e.b = f.b)),
z AS (SELECT unnest([a, b]) AS node, w FROM j) SELECT node, count(*) AS degree, round(sum(w), 6) AS strength FROM z GROUP BY 1""")
def forced_edges_strength(spark, d):
    near = knn(spark, d)
    return graph.strength(graph.forced(near, graph.layer(near, "x", 0.4))).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {KNN_SQL}, e AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(similarity) AS weight FROM k GROUP BY 1, 2), t AS (SELECT quantile_cont(abs(weight), 0.75) AS t FROM e) SELECT a, b, 'near' AS type, weight FROM e, t WHERE abs(weight) >= t""")
def percentile_edges(spark, d):
    return graph.percentile_layer(knn(spark, d), "near", 75)


@query()
def label_propagation(spark, d):
    return graph.label_propagation(graph.layer(knn(spark, d), "x", 0.1))


@query(f"WITH {UNIT_SQL}, c AS (SELECT max(id) + 1 AS n FROM u) SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a, c JOIN u b ON b.id = (a.id * 7919 + 13) % c.n WHERE a.id <> b.id")
def null_pairs(spark, d):
    u = unit_rows(spark, d)
    a = u.crossJoin(F.broadcast(u.agg((F.max("id") + 1).alias("n")))).select(F.col("id").alias("a"), F.col("v").alias("x"), ((F.col("id") * 7919 + 13) % F.col("n")).alias("b"))
    return a.join(u, F.col("b") == F.col("id")).where("a <> b").select("a", "b", F.round(vectors.dot(F.col("x"), F.col("v")), 6).alias("similarity"))


# --- enrichment, resampling, thresholds, classifiers

@query("""WITH c AS (SELECT p_brand AS g, p_type AS term, count(*) AS k FROM part GROUP BY 1, 2), t AS (SELECT term, sum(k) AS t FROM c GROUP BY 1), b AS (SELECT g, sum(k) AS d FROM c GROUP BY 1), n AS (SELECT sum(k) AS n FROM c),
p AS (SELECT g, term, k, list_sum(list_transform(range(k, CAST(least(t, d) AS BIGINT) + 1), lambda i: exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + lgamma(n - t + 1) - lgamma(d - i + 1) - lgamma(n - t - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)))) AS p FROM c JOIN t USING (term) JOIN b USING (g), n)
SELECT g, term, k, round(least(p, 1), 6) AS p FROM p""")
def hypergeometric_enrichment(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("k"))
    t, b, n = c.groupBy("term").agg(F.sum("k").alias("t")), c.groupBy("g").agg(F.sum("k").alias("d")), F.broadcast(c.agg(F.sum("k").alias("n")))
    return c.join(t, "term").join(b, "g").crossJoin(n).select("g", "term", "k", F.round(inference.hypergeometric(F.col("k"), F.col("t"), F.col("d"), F.col("n")), 6).alias("p"))


@query("""WITH s AS (SELECT l_returnflag AS g, l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS k, avg(l_discount) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, k) AS r, count(*) OVER (PARTITION BY g) AS n FROM s)
SELECT g, k, round(least(min(p * n / r) OVER (PARTITION BY g ORDER BY r DESC), 1), 6) AS fdr FROM r""")
def adjusted_rates(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.concat("l_linestatus", F.lit("-"), "l_linenumber").alias("k")).agg(F.avg("l_discount").alias("p"))
    return inference.adjusted(s, "p", ["g"], ["k"]).select("g", "k", F.round("fdr", 6).alias("fdr"))


@query("""WITH n AS (SELECT l_returnflag AS g, CAST(floor(l_extendedprice / 2000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT g, bin, sum(n) OVER w AS w, sum(n * bin) OVER w AS m, sum(n) OVER p AS nn, sum(n * bin) OVER p AS mm FROM n WINDOW w AS (PARTITION BY g ORDER BY bin), p AS (PARTITION BY g)),
s AS (SELECT g, bin, CAST(mm * w - nn * m AS DOUBLE) * CAST(mm * w - nn * m AS DOUBLE) / (CAST(w AS DOUBLE) * (nn - w)) AS s FROM c WHERE w < nn) SELECT g, bin AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY s DESC, bin) = 1""")
def otsu_threshold(spark, d):
    return inference.otsu(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.floor(F.col("l_extendedprice") / 2000).alias("bin")), "g", "bin")


@query()
def bootstrap_interval(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_id", F.col("event_type").alias("g"), "value", (F.col("user_id") % 3 == 0).alias("side"))
    return inference.bootstrap(e, "event_id", "value", "side", "g")


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, k <= floor(n * 0.8) AS train FROM r""")
def stratified_split(spark, d):
    return inference.split(table(spark, d, "embeddings"), "vec_id", "label").select("vec_id", "train")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) WHERE k <= 5""")
def grouped_sample(spark, d):
    order = [F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.col("o_orderkey")]
    return relational.top_k(table(spark, d, "orders"), ["o_orderpriority"], order, 5).select("o_orderpriority", "o_orderkey")


@query(f"WITH {MATRIX_SQL} SELECT gene, round(median(value / total * 10000), 6) AS median FROM (SELECT *, sum(value) OVER (PARTITION BY sample) AS total FROM m) WHERE value > 0 GROUP BY 1")
def nonzero_median(spark, d):
    share = matrix.cpm(counts(spark, d)).where("value > 0")
    return ordered.quantiles(share.withColumn("cpm", F.col("cpm") / 100), ["gene"], "cpm", {"median": 0.5}).withColumn("median", F.round("median", 6))


@query(r_sql("g AS (SELECT count(DISTINCT gene) AS g FROM m), c AS (SELECT sample, gene, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 + CASE WHEN g > count(*) OVER (PARTITION BY sample) THEN (g - count(*) OVER (PARTITION BY sample) - 1) / 2 ELSE 0 END AS value FROM m, g)", "sample", "gene"))
def correlation_spearman(spark, d):
    return matrix.correlation(matrix.rank_values(counts(spark, d))).withColumn("r", F.round("r", 5))


@query()
def linear_svm(spark, d):
    rows = inference.split(table(spark, d, "embeddings"), "vec_id", "label")
    return inference.linear_svm(rows, "embedding", F.col("label") == 0)
