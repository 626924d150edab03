"""Queries of tidied tables, checks, run progress, and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import cleaning, matrix, relational, vectors
from archivolt.plans.annotation import _list, _pick
from archivolt.plans.catalog import MATRIX_SQL, UNIT_SQL, counts, unit_rows
from archivolt.plans.registry import query
from archivolt.sources.tables import table

# --- columns, axes, values


@query("SELECT p_partkey, p_brand FROM part")
def chosen_columns(spark, d):
    p = cleaning.without_last(table(spark, d, "part"), 1)
    return cleaning.present(p, ["p_partkey", "p_colour", "p_brand"])


@query(f"WITH {MATRIX_SQL} SELECT sample, p_brand AS gene, value FROM m JOIN part ON gene = p_partkey WHERE p_size > 10")
def mapped_columns(spark, d):
    names = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene"), "p_brand")
    return cleaning.mapped(counts(spark, d), names, "gene", "p_brand").select("sample", "gene", "value")


@query("SELECT p_brand AS a, l_returnflag AS b, round(avg(l_quantity), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def collapsed_cells(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return cleaning.collapsed(li, "a", "b", "l_quantity", F.col("p_brand"), F.col("l_returnflag")).select("a", "b", F.round("l_quantity", 6).alias("value"))


@query("""SELECT doc_id, CASE WHEN n_chars > 2000 AND trim(lang) <> '' THEN trim(lang) WHEN n_chars > 500 AND trim(source) <> '' THEN trim(source) ELSE 'unknown' END AS label FROM documents""")
def coalesced_labels(spark, d):
    said = [F.when(F.col("n_chars") > 2000, F.col("lang")), F.lit("  "), F.when(F.col("n_chars") > 500, F.col("source")), F.lit("Unknown")]
    return table(spark, d, "documents").select("doc_id", cleaning.coalesced(said).alias("label"))


@query(r"""WITH l AS (SELECT s_suppkey, s_suppkey || ',' || s_nationkey || ',a,b,c' || CASE WHEN s_acctbal > 0 THEN ',,,' ELSE ',d,,' END AS line FROM supplier)
SELECT s_suppkey, regexp_replace(line, '^((?:[^,]*,){2})((?:[^,]*,){2}[^,]*),{3}$', '\1,,,\2') AS line FROM l""")
def shifted_lines(spark, d):
    line = F.concat(F.concat_ws(",", "s_suppkey", "s_nationkey", F.lit("a,b,c")), F.when(F.col("s_acctbal") > 0, ",,,").otherwise(",d,,"))
    return table(spark, d, "supplier").select("s_suppkey", cleaning.shifted(line, 2, 2, 3).alias("line"))


@query(f"WITH {MATRIX_SQL}, n AS (SELECT count(DISTINCT sample) < count(DISTINCT gene) AS turn FROM m) SELECT CASE WHEN turn THEN gene ELSE sample END AS sample, CASE WHEN turn THEN sample ELSE gene END AS gene, value FROM m, n")
def oriented_matrix(spark, d):
    return cleaning.oriented(counts(spark, d), "sample", "gene").select("sample", "gene", "value")


@query("""WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 AND p_type <> 'PROMO' THEN CAST(p_size AS VARCHAR) ELSE 'n/a' END AS v FROM part)
SELECT p_partkey, p_brand, coalesce(TRY_CAST(v AS DOUBLE), 0) AS v FROM m WHERE p_brand IN (SELECT p_brand FROM m WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL)""")
def numeric_columns(spark, d):
    v = F.when((F.col("p_size") > 25) & (F.col("p_type") != "PROMO"), F.col("p_size").cast("string")).otherwise("n/a")
    return cleaning.numeric(table(spark, d, "part").select("p_partkey", "p_brand", v.alias("v")), "p_brand", "v").select("p_partkey", "p_brand", "v")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / nullif(l_quantity, 0) BETWEEN 1000 AND 1500 AND l_discount / nullif(l_tax, 0) BETWEEN 0.5 AND 2")
def ratio_masks(spark, d):
    rules = [("l_extendedprice", "l_quantity", 1000.0, 1500.0), ("l_discount", "l_tax", 0.5, 2.0)]
    return cleaning.ratios(table(spark, d, "lineitem"), rules).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN lang = 'en' OR source = 'en' THEN 'yes' ELSE 'no' END AS en, CASE WHEN lang = 'de' OR source = 'de' THEN 'yes' ELSE 'no' END AS de FROM documents")
def membership_words(spark, d):
    return cleaning.membership(table(spark, d, "documents"), "doc_id", F.array("lang", "source"), ["en", "de"], words=True)


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' #div/0!' WHEN c_acctbal < 500 THEN '  ' ELSE ' ' || lower(c_mktsegment) || ' ' END AS x FROM customer)
SELECT c_custkey, CASE WHEN upper(trim(x)) NOT IN ('', '#DIV/0!') THEN upper(trim(x)) END AS label FROM n""")
def clean_labels(spark, d):
    x = F.when(F.col("c_acctbal") < 0, " #div/0!").when(F.col("c_acctbal") < 500, "  ").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", cleaning.clean_label(x, ["#DIV/0!"]).alias("label"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END AS n, l_discount AS r1, l_tax AS r2, l_quantity AS s1, l_extendedprice / 1000 AS s2, nullif(l_returnflag, 'R') AS g1, l_linestatus AS g2 FROM lineitem)
SELECT id, round(CASE n WHEN 2 THEN r1 / nullif(r2, 0) ELSE r1 END, 6) AS ratio, round(CASE n WHEN 2 THEN least(s1, s2) ELSE s1 END, 6) AS least, CASE n WHEN 2 THEN coalesce(g1, 'U') || '-' || coalesce(g2, 'U') ELSE coalesce(g1, 'U') || '-SE' END AS category FROM r""")
def mate_branches(spark, d):
    r = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") > 3, 2).otherwise(1).alias("n_mates"), F.col("l_discount").alias("rate1"), F.col("l_tax").alias("rate2"),
        F.col("l_quantity").alias("sparsity1"), (F.col("l_extendedprice") / 1000).alias("sparsity2"), F.nullif("l_returnflag", F.lit("R")).alias("grade1"), F.col("l_linestatus").alias("grade2"),
    )
    return cleaning.mates(r).select("id", F.round("ratio", 6).alias("ratio"), F.round("least", 6).alias("least"), "category")


# --- joins, groups, lists


@query("SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def aligned_edges(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return cleaning.aligned_edges(edges, table(spark, d, "supplier").where("s_acctbal > 0"), "a", "b", "s_suppkey").select("a", "b")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (l_quantity > 45) AS large, count(DISTINCT l_partkey) FILTER (l_discount = 0) AS plain FROM lineitem GROUP BY 1")
def distinct_filtered(spark, d):
    return cleaning.distinct_where(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey", {"large": F.col("l_quantity") > 45, "plain": F.col("l_discount") == 0})


@query("SELECT o_orderpriority, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_summarised(spark, d):
    return cleaning.first_of_group(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@query("SELECT c_custkey, n FROM customer JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) USING (c_nationkey)")
def distinct_beside(spark, d):
    return cleaning.with_distinct(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "n").select("c_custkey", "n")


@query("""WITH s AS (SELECT CAST(l_quantity AS BIGINT) AS a, CASE WHEN l_discount > 0.02 THEN CAST(floor(l_quantity * 0.9) AS BIGINT) END AS b, CASE WHEN l_tax > 0.03 THEN CAST(floor(l_quantity * 0.5) AS BIGINT) END AS c FROM lineitem)
SELECT unnest(['runs_download', 'sum_download', 'dropouts_after_download', 'runs_trimmed', 'sum_trimmed', 'dropouts_after_trimmed', 'runs_aligned', 'sum_aligned']) AS name,
unnest([count(a), CAST(sum(a) AS BIGINT), count(*) FILTER (a IS NOT NULL AND b IS NULL), count(b), CAST(sum(b) AS BIGINT), count(*) FILTER (b IS NOT NULL AND c IS NULL), count(c), CAST(sum(c) AS BIGINT)]) AS n FROM s""")
def run_progress(spark, d):
    q = F.col("l_quantity")
    s = table(spark, d, "lineitem").select(q.cast("long").alias("a"), F.when(F.col("l_discount") > 0.02, F.floor(q * 0.9)).alias("b"), F.when(F.col("l_tax") > 0.03, F.floor(q * 0.5)).alias("c"))
    return cleaning.progress(s, [("download", "a"), ("trimmed", "b"), ("aligned", "c")])


@query("""WITH t AS (SELECT user_id, event_type, bool_or(value > 5) AS ok, max(CASE WHEN value > 5 THEN CAST(event_id AS VARCHAR) END) AS f FROM (SELECT user_id, event_type, event_id, coalesce(value, 0) AS value FROM events) GROUP BY 1, 2)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (ok), '') AS completed, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT ok), '') AS failed, coalesce(string_agg(event_type || '=' || f, ';' ORDER BY event_type) FILTER (ok), '') AS folders FROM t GROUP BY 1""")
def process_lists(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.when(F.coalesce("value", F.lit(0.0)) > 5, "COMPLETED").otherwise("FAILED").alias("state"), F.col("event_id").cast("string").alias("folder"))
    p = cleaning.processes(e, "user_id", "event_type", "state", "folder")
    return p.select("user_id", F.concat_ws(",", "completed").alias("completed"), F.concat_ws(",", "failed").alias("failed"), F.concat_ws(";", F.transform(F.map_entries("folders"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))).alias("folders"))


@query("""WITH p AS (SELECT l_orderkey AS run, l_linestatus AS t, CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS s FROM lineitem), h AS (SELECT DISTINCT o_orderkey AS run, o_orderstatus AS l FROM orders WHERE o_totalprice > 100000),
n AS (SELECT t, s, count(*) AS n, count(h.run) AS p FROM p LEFT JOIN h ON h.run = p.run AND h.l = p.s GROUP BY 1, 2)
SELECT t, s, n, round(100 * n / sum(n) OVER (PARTITION BY t), 5) AS pct, CASE WHEN t <> s THEN round(100 * p / sum(n) OVER (PARTITION BY t), 5) END AS present_pct FROM n""")
def co_presence(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linestatus").alias("t"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("s"))
    there = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("l"), (F.col("o_totalprice") - 100000).alias("amount"))
    return cleaning.co_present(pairs, there, "run", "t", "s", "l", "amount").withColumns({c: F.round(c, 5) for c in ("pct", "present_pct")})


LEVELS = {"supplier": ["s_suppkey", "s_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["n_regionkey", "r_name"]}


@query("""WITH c AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'supplier' AS level, count(*) AS n FROM (SELECT DISTINCT s_suppkey, s_name FROM c) UNION ALL SELECT 'nation', count(*) FROM (SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM c) UNION ALL SELECT 'region', count(*) FROM (SELECT DISTINCT n_regionkey, r_name FROM c)""")
def level_tables(spark, d):
    c = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n") for name, df in cleaning.levels(c, LEVELS).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RULES = [("digits", "[0-9]{4}", "numbers", 0.9), ("mail", "@[a-z]+", "contact", 0.8), ("pipe", "[|]", "table", 0.6), ("year", "(19|20)[0-9]{2}", "numbers", 0.5)]
HITS_SQL = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{n}' AS r, '{c}' AS c, {w} AS w FROM documents WHERE regexp_matches(text, '{p}')" for k, (n, p, c, w) in enumerate(RULES))


@query(f"""WITH h AS ({HITS_SQL}), c AS (SELECT doc_id, c, min(k) AS k FROM h GROUP BY 1, 2), a AS (SELECT doc_id, string_agg(r || ':' || w, ',' ORDER BY k) AS hits, arg_min(c, k) AS p FROM h GROUP BY 1), b AS (SELECT doc_id, string_agg(c, ',' ORDER BY k) AS categories FROM c GROUP BY 1)
SELECT doc_id, coalesce(hits, '') AS hits, coalesce(categories, '') AS categories, coalesce(p, 'unclassified') AS "primary" FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def rule_hits(spark, d):
    h = cleaning.rule_hits(table(spark, d, "documents"), "doc_id", F.col("text"), RULES)
    return h.select("doc_id", F.concat_ws(",", F.transform("hits", lambda x: F.concat(x["rule"], F.lit(":"), x["confidence"].cast("string")))).alias("hits"), F.concat_ws(",", "categories").alias("categories"), "primary")


#: Made-up records.
PROTOCOLS = ["cells on a 10x chip", "bulk prep", "poly-a beads", "ribo-zero kit", "", "smart-seq2 plates", "random hexamers"]
SOURCES, SELECTIONS, LABELS, BULKS = ["TRANSCRIPTOMIC", "METATRANSCRIPTOMIC", "TRANSCRIPTOMIC SINGLE CELL"], ["unspecified", "PolyA", "cDNA", "other", "Oligo-dT"], ["poly_a", "unknown", "random_priming", "cdna_unspecified"], ["bulk", "sc"]
SINGLE, SAID, EXPECTED = ["10x", "smart-seq2"], {"poly-a": "poly_a", "ribo-zero": "rrna_depletion", "random": "random_priming"}, {"polya": "poly_a", "oligo-dt": "poly_a", "cdna": "cdna_unspecified"}


@query(f"""WITH r AS (SELECT s_suppkey AS k, ({_list(PROTOCOLS)})[s_suppkey % 7 + 1] AS t, ({_list(SOURCES)})[s_suppkey % 3 + 1] AS src, lower(({_list(SELECTIONS)})[s_suppkey % 5 + 1]) AS sel, ({_list(LABELS)})[s_suppkey % 4 + 1] AS lab, ({_list(BULKS)})[s_suppkey % 2 + 1] AS b FROM supplier),
s AS (SELECT *, list_filter([CASE WHEN contains(t, 'poly-a') THEN 'poly_a' END, CASE WHEN contains(t, 'ribo-zero') THEN 'rrna_depletion' END, CASE WHEN contains(t, 'random') THEN 'random_priming' END], lambda x: x IS NOT NULL) AS said, regexp_replace(sel, '[-()]', '', 'g') AS bare FROM r)
SELECT k AS s_suppkey, concat_ws('|', CASE WHEN (contains(t, '10x') OR contains(t, 'smart-seq2')) AND src = 'TRANSCRIPTOMIC' AND b = 'bulk' THEN 'sc_text|bulk_label' END, CASE WHEN src = 'METATRANSCRIPTOMIC' THEN 'metatranscriptomic|rna_seq' END,
CASE WHEN len(said) > 0 AND sel IN ('unspecified', 'unknown', 'other', '') AND NOT list_contains(said, lab) AND lab <> 'unknown' THEN 'selection_text|selection_label' END,
CASE WHEN lab <> 'unknown' AND ((contains(bare, 'polya') AND lab <> 'poly_a') OR (contains(bare, 'oligodt') AND lab <> 'poly_a') OR (contains(bare, 'cdna') AND lab <> 'cdna_unspecified')) THEN 'selection_field|selection_label' END) AS flags FROM s""")
def discrepancy_checks(spark, d):
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select("s_suppkey", _pick(PROTOCOLS, k).alias("protocol"), F.lit("").alias("about"), _pick(SOURCES, k).alias("source"), _pick(SELECTIONS, k).alias("selection"), _pick(LABELS, k).alias("selection_class"), _pick(LABELS, k).alias("selection_src"), _pick(BULKS, k).alias("sc_or_bulk"), F.lit("rna_seq").alias("assay"), F.lit(None).cast("string").alias("conflicts"))
    return r.select("s_suppkey", cleaning.discrepancies(r, SINGLE, SAID, EXPECTED).alias("flags"))


#: Made-up technologies.
CURATED = ["10X v3", "Chromium", "SMART-Seq2", "smart_seq3", "DeTCT", "CORALL", "ribodepletion", "TruSeq", ""]


@query(f"""WITH t AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN lower(({_list(CURATED)})[s_suppkey % 9 + 1]) END AS v FROM supplier)
SELECT s_suppkey, CASE WHEN v IS NULL THEN NULL WHEN contains(v, '10x') OR contains(v, 'chromium') THEN '10x' WHEN contains(v, 'smart-seq') OR contains(v, 'smart_seq') THEN 'smartseq' WHEN contains(v, 'detct') OR contains(v, 'corall') OR contains(v, 'rrna') OR contains(v, 'ribodepletion') THEN 'bulk_depleted' ELSE 'bulk_or_other' END AS label FROM t""")
def canonical_technologies(spark, d):
    v = F.when(F.col("s_acctbal") >= 0, _pick(CURATED, F.col("s_suppkey")))
    return table(spark, d, "supplier").select("s_suppkey", cleaning.canonical_technology(v).alias("label"))


# --- summaries


@query("SELECT p_brand, count(*) AS n, round(100 * count_if(p_size > 25) / count(*), 6) AS large, round(100 * count_if(p_type = 'PROMO') / count(*), 6) AS promo FROM part GROUP BY 1")
def validation_summary(spark, d):
    return cleaning.shares_of(table(spark, d, "part"), ["p_brand"], {"large": F.col("p_size") > 25, "promo": F.col("p_type") == "PROMO"}).withColumns({c: F.round(c, 6) for c in ("large", "promo")})


@query("WITH l AS (SELECT CASE label WHEN 0 THEN -1 WHEN 9 THEN 8 ELSE label END AS label FROM embeddings) SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l WHERE label <> -1 GROUP BY 1")
def label_balance(spark, d):
    return cleaning.balance(table(spark, d, "embeddings"), "label", {0: -1, 9: 8}).withColumn("share", F.round("share", 6))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS length FROM documents")
def sequence_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ", -1)).cast("long").alias("length"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS l FROM benchmark) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM w""")
def ordered_distinct(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("words"))


@query("""WITH b AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS token FROM benchmark), k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents),
r AS (SELECT token, item_id, row_number() OVER (PARTITION BY token ORDER BY item_id) AS k, count(*) OVER (PARTITION BY token) AS n FROM b WHERE token NOT IN (SELECT token FROM k)) SELECT token, any_value(n) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY 1""")
def rogue_tokens(spark, d):
    """Tokens that the corpus doesn't have, with up to three rows each."""
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ", -1)).alias("token"))
    known = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("token"))
    rogue = cleaning.only_here(b, known, "token", "item_id")
    return rogue.select("token", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def named_members(spark, d):
    n = table(spark, d, "nation")
    lists = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")).alias("ids"))
    return cleaning.named_members(lists, ["n_regionkey"], F.col("ids"), n.select(F.col("n_nationkey").cast("string").alias("id"), "n_name"), "id", "n_name")


@query("""WITH c AS (SELECT 'life;' || r_name || ';' || n_name AS p, 'life;' || r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS a FROM c)
SELECT p AS path, n, CAST(3 AS INTEGER) AS depth, CAST(1 AS BIGINT) AS leaves, round(k / a, 6) AS start, round((k + 1) / a, 6) AS stop FROM l UNION ALL
SELECT r, CAST(sum(n) AS BIGINT), 2, count(*), round(min(k) / any_value(a), 6), round((max(k) + 1) / any_value(a), 6) FROM l GROUP BY r UNION ALL SELECT 'life', CAST(sum(n) AS BIGINT), 1, count(*), 0, 1 FROM l""")
def tree_leaves(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    paths = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).groupBy(F.concat_ws(";", F.lit("life"), "r_name", "n_name").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return cleaning.leaves(paths, "path", "n").select("path", "n", "depth", "leaves", F.round("from", 6).alias("start"), F.round("to", 6).alias("stop"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) AS r, round(avg(abs(l_quantity - l_discount * 100)), 5) AS gap FROM lineitem GROUP BY 1")
def group_features(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 5).alias("r"), F.round(F.avg(F.abs(F.col("l_quantity") - F.col("l_discount") * 100)), 5).alias("gap"))


# --- orders, merges, bins, draws


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark, d):
    return relational.keep_first(table(spark, d, "events"), ["user_id"], [F.desc("event_id")]).select("event_id", "user_id")


@query("""WITH a AS (SELECT c_nationkey AS k, 'c' || c_custkey AS who, 0 AS place, c_custkey AS i FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 's' || s_suppkey, 1, s_suppkey FROM supplier)
SELECT k, who FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place, i) AS n FROM a) WHERE n = 1""")
def stable_merge(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("who"), F.col("c_custkey").alias("i"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("who"), F.col("s_suppkey").alias("i"))
    return relational.merged([c, s], ["k"], [F.col("i")]).select("k", "who")


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS place FROM orders")
def category_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", relational.ordered_rank(["P", "O"], F.col("o_orderstatus")).alias("place"))


@query("SELECT s_suppkey, s.name AS name, n.n_name AS name_nation, r_name AS name_region FROM (SELECT s_suppkey, s_nationkey AS nation, s_name AS name FROM supplier) s LEFT JOIN nation n ON nation = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n.n_regionkey = r_regionkey")
def suffixed_chain(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return relational.left_chain(s, [("nation", n, "nation"), ("region", r, "region")]).select("s_suppkey", "name", "name_nation", "name_region")


@query(f"WITH {MATRIX_SQL} SELECT sample, gene, round(value / total * 10000, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY sample) AS total FROM m) JOIN part ON gene = p_partkey WHERE value > 0 AND p_type IN ('PROMO', 'ECONOMY')")
def scaled_counts(spark, d):
    """Values over their sample's total, of the genes of some types."""
    kinds = table(spark, d, "part").where(F.col("p_type").isin("PROMO", "ECONOMY")).select(F.col("p_partkey").alias("gene"))
    return matrix.cpm(counts(spark, d)).where("value > 0").join(kinds, "gene", "left_semi").select("sample", "gene", F.round(F.col("cpm") / 100, 6).alias("value"))


def binned_sql(edges: str) -> str:
    return f"""WITH v AS (SELECT o_totalprice AS x FROM orders), o AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v), e AS ({edges}),
p AS (SELECT unnest(range(1, len(e))) AS bin, e FROM e), c AS (SELECT bin, count(x) AS n FROM p LEFT JOIN v ON (x > e[bin] OR bin = 1) AND x <= e[bin + 1] GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cumulative FROM c"""


def binned(spark, d, rule, n=10):
    o = table(spark, d, "orders")
    return relational.bins(o, "o_totalprice", relational.edges(o, "o_totalprice", rule, n))


@query(binned_sql("SELECT list_append(list_transform(range(0, 12), lambda k: lo + k * (hi - lo) / 12), hi) AS e FROM o"))
def bins_even(spark, d):
    return binned(spark, d, "even", 12)


@query(binned_sql("SELECT list_append(list_transform(range(0, k), lambda i: lo + i * (hi - lo) / k), hi) AS e FROM (SELECT lo, hi, CAST(ceil((hi - lo) / (2 * (b - a) / pow(n, 1.0 / 3))) AS BIGINT) AS k FROM o)"))
def bins_freedman(spark, d):
    return binned(spark, d, "freedman")


@query(binned_sql("SELECT quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]) AS e FROM v"))
def bins_quantile(spark, d):
    return binned(spark, d, "quantile", 4)


@query(f"""WITH {UNIT_SQL}, d AS (SELECT draw, id, v, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || ':' || id), id) AS k FROM u, (SELECT unnest(range(1, 11)) AS draw)), e AS (SELECT draw, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS p FROM d WHERE k <= 5),
s AS (SELECT draw, list(y ORDER BY p) AS q FROM (SELECT draw, p, sum(y) AS y FROM e GROUP BY 1, 2) GROUP BY 1) SELECT CAST(draw AS INTEGER) AS draw, round(list_cosine_similarity(q, v), 6) AS similarity FROM s, u WHERE id = 7""")
def random_sets(spark, d):
    u = unit_rows(spark, d)
    return vectors.random_sets(u, u.where("id = 7"), 10, 5)
