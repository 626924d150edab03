"""Queries of effect sizes, tests of markers and enrichment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from archivolt.operators import effects
from archivolt.operators.effects import ERFC
from archivolt.plans.catalog import SIDE_SQL, sides
from archivolt.plans.registry import ORACLE, query
from archivolt.plans.shaping import markers
from archivolt.sources.tables import table


@query(f"""WITH {SIDE_SQL}, m AS (SELECT g, median(value) FILTER (side) AS f, median(value) FILTER (NOT side) AS c, median(value) AS a FROM e GROUP BY 1),
d AS (SELECT g, any_value(f - c) AS diff, 1.4826 * median(abs(value - c)) FILTER (NOT side) AS mad, 1.4826 * median(abs(value - a)) AS pooled FROM e JOIN m USING (g) GROUP BY 1)
SELECT g, round(diff, 5) AS median_diff, round(CASE WHEN mad > 1e-12 THEN mad WHEN pooled > 1e-12 THEN pooled ELSE 1 END, 5) AS scale, round(diff / CASE WHEN mad > 1e-12 THEN mad WHEN pooled > 1e-12 THEN pooled ELSE 1 END, 5) AS delta_star FROM d""")
def glass_delta(spark, d):
    return effects.glass(sides(spark, d), "value", "side", ["g"]).select("g", *(F.round(c, 5).alias(c) for c in ("median_diff", "scale", "delta_star")))


GRID_SQL = "e AS (SELECT l_returnflag AS g, l_linestatus AS h, l_extendedprice AS value, l_discount > 0.05 AS side FROM lineitem)"
DECILES = ", ".join(f"round(quantile_cont(value, {k / 10}) FILTER (side) - quantile_cont(value, {k / 10}) FILTER (NOT side), 4) AS s{k}" for k in range(1, 10))


@query(f"""WITH {GRID_SQL}, q AS (SELECT g, h, count(*) FILTER (side) AS n_in, count(*) FILTER (NOT side) AS n_out, {DECILES}, round(count_if(side AND value > 30000) / count_if(side), 6) AS rate_in, round(count_if(NOT side AND value > 30000) / count_if(NOT side), 6) AS rate_out, round(median(value) FILTER (side AND value > 30000), 4) AS positive_in, round(median(value) FILTER (NOT side AND value > 30000), 4) AS positive_out FROM e GROUP BY 1, 2),
m AS (SELECT g, h, median(value) FILTER (side) AS f, median(value) FILTER (NOT side) AS c FROM e GROUP BY 1, 2), d AS (SELECT g, h, any_value(f - c) AS diff, 1.4826 * median(abs(value - c)) FILTER (NOT side) AS mad FROM e JOIN m USING (g, h) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY g, h, side ORDER BY value) AS r, count(*) OVER (PARTITION BY g, h, side) AS n FROM e), u AS (SELECT g, h, avg(value) FILTER (side) - avg(value) FILTER (NOT side) AS trimmed FROM t WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY g, h ORDER BY value) + (count(*) OVER (PARTITION BY g, h, value) - 1) / 2 AS r FROM e), a AS (SELECT g, h, (sum(r) FILTER (side) - count_if(side) * (count_if(side) + 1) / 2) / (count_if(side) * count_if(NOT side)) AS a FROM k GROUP BY 1, 2),
v AS (SELECT g, h, value, count_if(side) AS x, count_if(NOT side) AS y FROM e GROUP BY 1, 2, 3), c AS (SELECT g, h, abs(sum(x) OVER w / sum(x) OVER p - sum(y) OVER w / sum(y) OVER p) AS gap, coalesce(lead(value) OVER w - value, 0) AS wide FROM v WINDOW w AS (PARTITION BY g, h ORDER BY value), p AS (PARTITION BY g, h)), w AS (SELECT g, h, sum(gap * wide) AS w FROM c GROUP BY 1, 2)
SELECT q.*, round(diff, 4) AS median_diff, round(diff / mad, 5) AS delta_star, round(trimmed, 4) AS trimmed_diff, round(a, 6) AS a, round(w, 3) AS wasserstein FROM q JOIN d USING (g, h) JOIN u USING (g, h) JOIN a USING (g, h) JOIN w USING (g, h)""")
def compare_grid(spark, d):
    """All effect sizes of a grid of two columns' values at once."""
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("h"), F.col("l_extendedprice").alias("value"), (F.col("l_discount") > 0.05).alias("side"))
    r = effects.compared(e, "value", "side", ["g", "h"], threshold=30000.0)
    return r.select(
        "g", "h", "n_in", "n_out", *(F.round(F.col("shift")[k - 1], 4).alias(f"s{k}") for k in range(1, 10)), F.round("rate_in", 6).alias("rate_in"), F.round("rate_out", 6).alias("rate_out"), F.round("positive_median_in", 4).alias("positive_in"), F.round("positive_median_out", 4).alias("positive_out"),
        F.round("median_diff", 4).alias("median_diff"), F.round("delta_star", 5).alias("delta_star"), F.round("trimmed_diff", 4).alias("trimmed_diff"), F.round("a", 6).alias("a"), F.round("wasserstein", 3).alias("wasserstein"),
    )


def times_sql(u: str) -> str:
    """The Poisson number of a share u, as ``poisson_times`` has it."""
    out, p, total = "CASE", math.exp(-1), 0.0
    for k in range(8):
        total += p
        out += f" WHEN {u} < {total!r} THEN {k}"
        p /= k + 1
    return out + " ELSE 8 END"


KEYED_SQL = "e AS (SELECT event_id AS id, event_type AS g, value, user_id % 3 = 0 AS side FROM events WHERE value IS NOT NULL)"
SHARE_SQL = "CAST('0x' || substr(md5(id || ':' || draw), 1, 8) AS BIGINT) / 4294967296.0"


def keyed(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("event_id").alias("id"), F.col("event_type").alias("g"), "value", (F.col("user_id") % 3 == 0).alias("side"))


QUANTILES_SQL = " UNION ALL ".join(f"SELECT g, draw, side, {k / 10} AS q, min(value) FILTER (c >= {k / 10} * t) AS x FROM c GROUP BY 1, 2, 3" for k in range(1, 10))


@query(f"""WITH {KEYED_SQL}, r AS (SELECT *, unnest(range(1, 21)) AS draw FROM e), n AS (SELECT g, draw, side, value, sum({times_sql(SHARE_SQL)}) AS w FROM r GROUP BY 1, 2, 3, 4 HAVING w > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY g, draw, side ORDER BY value) AS c, sum(w) OVER (PARTITION BY g, draw, side) AS t FROM n), x AS ({QUANTILES_SQL}), s AS (SELECT g, draw, q, max(x) FILTER (side) - max(x) FILTER (NOT side) AS d FROM x GROUP BY 1, 2, 3)
SELECT g, CAST(q AS DOUBLE) AS q, round(quantile_cont(d, 0.025), 5) AS low, round(quantile_cont(d, 0.975), 5) AS high FROM s GROUP BY 1, 2""")
def decile_intervals(spark, d):
    r = effects.decile_intervals(keyed(spark, d), "id", "value", "side", ["g"], rounds=20)
    return r.select("g", "q", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"""WITH {KEYED_SQL}, m AS (SELECT g, least(count_if(side), count_if(NOT side)) AS m FROM e GROUP BY 1), r AS (SELECT *, unnest(range(1, 6)) AS draw FROM e JOIN m USING (g)),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY g, draw, side ORDER BY md5(id || ':' || draw), id) <= m),
a AS (SELECT g, draw, median(value) FILTER (side) - median(value) FILTER (NOT side) AS x FROM d GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY g, draw ORDER BY value) + (count(*) OVER (PARTITION BY g, draw, value) - 1) / 2 AS r FROM d), b AS (SELECT g, draw, (sum(r) FILTER (side) - count_if(side) * (count_if(side) + 1) / 2) / (count_if(side) * count_if(NOT side)) AS a FROM k GROUP BY 1, 2),
v AS (SELECT g, draw, value, count_if(side) AS x, count_if(NOT side) AS y FROM d GROUP BY 1, 2, 3), c AS (SELECT g, draw, abs(sum(x) OVER w / sum(x) OVER p - sum(y) OVER w / sum(y) OVER p) AS gap, coalesce(lead(value) OVER w - value, 0) AS wide FROM v WINDOW w AS (PARTITION BY g, draw ORDER BY value), p AS (PARTITION BY g, draw)), w AS (SELECT g, draw, sum(gap * wide) AS w FROM c GROUP BY 1, 2)
SELECT g, round(avg(x), 5) AS median_diff_mean, round(stddev_samp(x), 5) AS median_diff_std, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_std, round(avg(w), 5) AS wasserstein_mean, round(stddev_samp(w), 5) AS wasserstein_std FROM a JOIN b USING (g, draw) JOIN w USING (g, draw) GROUP BY 1""")
def balanced_draws(spark, d):
    r = effects.balanced(keyed(spark, d), "id", "value", "side", ["g"], rounds=5)
    return r.select("g", *(F.round(c, 6 if c.startswith("a_") else 5).alias(c) for c in r.columns if c != "g"))


@query("""WITH q AS (SELECT l_returnflag, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05) AS r FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(m - 1.5 * r, 4) AS lower, round(m + 1.5 * r, 4) AS upper FROM q""")
def fences_ipr(spark, d):
    f = effects.inner_range_fences(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return f.select("l_returnflag", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


def erfc_sql(t: str) -> str:
    out = "0.0"
    for c in reversed(ERFC):
        out = f"(({out}) * {t} + {c})"
    return out


@query(f"""WITH m AS ({ORACLE['markers']}), t AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + abs(z) / sqrt(2) / 2) AS t FROM m), p AS (SELECT *, least(t * exp({erfc_sql('t')} - x * x), 1) AS p FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene) AS r, count(*) OVER (PARTITION BY grp) AS n FROM p)
SELECT gene, grp, z, logfc, round(p, 7) AS p, round(least(min(p * n / r) OVER (PARTITION BY grp ORDER BY r DESC), 1), 6) AS fdr, pct_in >= 0.1 AND pct_out <= 0.5 AND logfc >= log2(1.5) AS kept FROM r""")
def marker_tests(spark, d):
    r = effects.tested(markers(spark, d))
    return r.select("gene", "grp", "z", "logfc", F.round("p", 7).alias("p"), F.round("fdr", 6).alias("fdr"), "kept")


ENRICHED_SQL = """m AS (SELECT p_type AS s, p_brand AS c, p_partkey AS gene FROM part), t AS (SELECT DISTINCT l_partkey AS gene, l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS term FROM lineitem),
i AS (SELECT DISTINCT s, c, gene FROM m WHERE gene IN (SELECT gene FROM t)), l AS (SELECT s, c FROM m GROUP BY 1, 2 HAVING count(DISTINCT gene) >= 10), q AS (SELECT i.* FROM i SEMI JOIN l ON i.s = l.s AND i.c = l.c),
d AS (SELECT s, c, count(*) AS d FROM q GROUP BY 1, 2), z AS (SELECT term, count(*) AS t FROM t GROUP BY 1), n AS (SELECT count(DISTINCT gene) AS n FROM t), k AS (SELECT s, c, term, count(*) AS k FROM q JOIN t USING (gene) GROUP BY 1, 2, 3),
p AS (SELECT s, c, term, t, d, k, round(least(1, list_sum(list_transform(list_filter(range(k, CAST(least(t, d) AS BIGINT) + 1), lambda i: d - i <= n - t), lambda i: exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + lgamma(n - t + 1) - lgamma(d - i + 1) - lgamma(n - t - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))))), 9) AS p FROM k JOIN z USING (term) JOIN d USING (s, c), n),
r AS (SELECT *, row_number() OVER (PARTITION BY s, c ORDER BY p, term) AS r, count(*) OVER (PARTITION BY s, c) AS n FROM p), f AS (SELECT *, least(min(p * n / r) OVER (PARTITION BY s, c ORDER BY r DESC), 1) AS fdr FROM r), found AS (SELECT * FROM f WHERE fdr <= 0.9)"""


def enriched(spark, d):
    """Settings are types of parts, clusters their brands, terms what parts were sold as."""
    m = table(spark, d, "part").select(F.col("p_type").alias("s"), F.col("p_brand").alias("c"), F.col("p_partkey").alias("gene"))
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("term"))
    return m, effects.enriched(m, t, ["s", "c"], "gene", "term", alpha=0.9)


@query(f"WITH {ENRICHED_SQL} SELECT s, c, term, t AS term_size, d AS query_size, k AS shared, round(p, 6) AS p, round(fdr, 6) AS fdr FROM found")
def term_enrichment(spark, d):
    return enriched(spark, d)[1].select("s", "c", "term", "term_size", "query_size", "shared", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@query(f"""WITH {ENRICHED_SQL} SELECT s, count(DISTINCT c) AS n_clusters, coalesce(any_value(x.total), 0) AS total, coalesce(any_value(x."unique"), 0) AS "unique" FROM m LEFT JOIN (SELECT s, count(*) AS total, count(DISTINCT term) AS "unique" FROM found GROUP BY 1) x USING (s) GROUP BY 1""")
def enrichment_summary(spark, d):
    m, found = enriched(spark, d)
    return effects.enrichment_summary(found, m, ["c"], "s", "term")
