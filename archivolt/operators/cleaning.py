"""Tidying of annotation tables: columns chosen and coalesced, labels cleaned, lines
repaired, rows split and checked; counts of how far runs got."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import flags
from archivolt.operators import positions


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def without_last(df: DataFrame, n: int) -> DataFrame:
    """All columns but the last n."""
    return df.select(*(df.columns[:-n] if n > 0 else df.columns))


def mapped(m: DataFrame, names: DataFrame, column: str, new: str) -> DataFrame:
    """Columns of a long matrix under new names; unmapped ones are left out."""
    return m.join(names.select(F.col(column).alias("_old"), F.col(new).alias("_new")), F.col(column) == F.col("_old")).withColumn(column, F.col("_new")).drop("_old", "_new")


def collapsed(edges: DataFrame, a: str, b: str, value: str, a_id: Column, b_id: Column) -> DataFrame:
    """A matrix whose rows and columns go under ids: cells of equal ids become their mean."""
    return edges.select(a_id.alias(a), b_id.alias(b), value).groupBy(a, b).agg(F.avg(value).alias(value))


def coalesced(columns: list[Column], none: str = "unknown") -> Column:
    """The first column that says anything: not null, blank or ``none``."""
    said = lambda c: F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != none), F.trim(c))
    return F.coalesce(*map(said, columns), F.lit(none))


def shifted(line: Column, before: int, rest: int, gap: int) -> Column:
    """A line of comma-separated fields whose ``gap`` empty fields stand at its end and
    belong behind the first ``before``; others are left as they are."""
    pattern = r"^((?:[^,]*,){%d})((?:[^,]*,){%d}[^,]*),{%d}$" % (before, rest, gap)
    return F.regexp_replace(line, pattern, "$1" + "," * gap + "$2")


def oriented(m: DataFrame, row: str, column: str, how: str = "auto") -> DataFrame:
    """Long form with the axes swapped for ``transpose``, as they are for ``keep``, and for
    ``auto`` swapped if there are fewer rows than columns (one row of two counts is read)."""
    if how == "auto":
        n = m.agg(F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c")).first()
        how = "transpose" if n["r"] < n["c"] else "keep"
    if how != "transpose":
        return m
    new = {row: column, column: row}
    return m.select(*(F.col(c).alias(new.get(c, c)) for c in m.columns))


def numeric(m: DataFrame, column: str, value: str) -> DataFrame:
    """Values as numbers; columns without any are dropped, other gaps become 0."""
    v = m.withColumn(value, F.col(value).try_cast("double"))
    some = v.groupBy(column).agg(F.count(value).alias("_n")).where("_n > 0").select(column)
    return v.join(some, column, "left_semi").na.fill(0.0, [value])


def ratios(df: DataFrame, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """Rows for which each ratio (two columns) lies between its bounds, both included; a
    ratio over zero doesn't."""
    inside = (F.try_divide(F.col(a), F.col(b)).between(low, high) for a, b, low, high in rules)
    return df.where(reduce(lambda x, y: x & y, inside, F.lit(True)))


def membership(df: DataFrame, key: str, labels: Column, levels: list[str], words: bool = False) -> DataFrame:
    """A column for each level: 1 or 0, or yes or no with ``words``, by whether the key's
    list of labels (from a JSON map, say) has it."""
    has = lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))
    return df.select(key, *((F.when(has(x), "yes").otherwise("no") if words else has(x).cast("int")).alias(x) for x in levels))


def clean_label(c: Column, errors: list[str]) -> Column:
    """Trimmed and in upper case; null for blanks and spreadsheets' marks of errors."""
    bare = F.upper(F.trim(c))
    return F.when((bare != "") & ~bare.isin([e.upper() for e in errors]), bare)


def mates(df: DataFrame, unknown: str = "U") -> DataFrame:
    """ratio, least and category of runs with two mates (n_mates 2) and with one: the ratio
    of both mates' rates and the smaller sparsity, or the only ones there are. Other runs
    are left out."""
    grade = lambda c: F.coalesce(F.col(c), F.lit(unknown))
    two = df.where("n_mates = 2").select("id", F.try_divide(F.col("rate1"), F.col("rate2")).alias("ratio"), F.least("sparsity1", "sparsity2").alias("least"), F.concat(grade("grade1"), F.lit("-"), grade("grade2")).alias("category"))
    one = df.where("n_mates = 1").select("id", F.col("rate1").alias("ratio"), F.col("sparsity1").alias("least"), F.concat(grade("grade1"), F.lit("-SE")).alias("category"))
    return two.unionByName(one)


def aligned_edges(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """Edges whose ends are both among the nodes: those of the matrix aligned to the nodes'
    list, where absent ones make no edge."""
    for end in (a, b):
        edges = edges.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_semi")
    return edges


def distinct_where(df: DataFrame, by: list[str], key: str, rules: dict[str, Column]) -> DataFrame:
    """Different keys of each group, of all rows and of those for which each rule holds."""
    return df.groupBy(*by).agg(F.count_distinct(key).alias("n"), *(F.count_distinct(F.when(c, F.col(key))).alias(n) for n, c in rules.items()))


def first_of_group(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row a group: the columns' values in its first row; ``order`` should be total."""
    row = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), *(F.col(c) for c in columns))
    return df.groupBy(*by).agg(F.min(row).alias("f")).select(*by, *(F.col(f"f.{c}") for c in columns))


def with_distinct(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Beside each row the number of different keys of its group, nulls not counted."""
    n = df.groupBy(*by).agg(F.count_distinct(key).alias(name))
    same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(n[c]) for c in by])
    return df.join(n, same).select(df["*"], n[name])


def progress(df: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """name, n: how many runs have each stage's column, the sum of its amount, and how many
    have it but not the next stage's. ``stages`` are a name and a column, in order; one
    aggregation over all rows."""
    made = []
    for k, (name, column) in enumerate(stages):
        c = F.col(column)
        made += [(f"runs_{name}", F.count(c)), (f"sum_{name}", F.coalesce(F.sum(c), F.lit(0)).cast("long"))]
        if k + 1 < len(stages):
            made.append((f"dropouts_after_{name}", F.count_if(c.isNotNull() & F.col(stages[k + 1][1]).isNull())))
    one = df.agg(*(c.cast("long").alias(n) for n, c in made))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n, _ in made))))


def processes(tasks: DataFrame, run: str, process: str, state: str, folder: str, good: str = "COMPLETED") -> DataFrame:
    """Of each run the processes that went well and those that didn't (none of their tries
    went well), sorted, and the folder of each process's last good try."""
    each = tasks.groupBy(run, process).agg(F.bool_or(F.col(state) == good).alias("_ok"), F.max(F.when(F.col(state) == good, F.col(folder))).alias("_at"))
    lists = [F.array_sort(F.collect_set(F.when(c, F.col(process)))).alias(n) for n, c in (("completed", F.col("_ok")), ("failed", ~F.col("_ok")))]
    where = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct(process, "_at"))))).alias("folders")
    return each.groupBy(run).agg(*lists, where)


def co_present(pairs: DataFrame, present: DataFrame, run: str, true: str, said: str, label: str, amount: str) -> DataFrame:
    """true, said, n, pct of all with that true label, and of cells off the diagonal the
    percentage (of all with that true label) in which what was said is there, too.
    ``present`` has the amount of each label of a run, once."""
    there = present.where(F.col(amount) > 0).select(F.col(run).alias("_run"), F.col(label).alias("_label")).distinct()
    both = pairs.join(there, (pairs[run] == F.col("_run")) & (pairs[said] == F.col("_label")), "left")
    n = both.groupBy(true, said).agg(F.count(F.lit(1)).alias("n"), F.count("_run").alias("_p"))
    whole = F.sum("n").over(Window.partitionBy(true))
    return n.select(true, said, "n", (100 * F.col("n") / whole).alias("pct"), F.when(F.col(true) != F.col(said), 100 * F.col("_p") / whole).alias("present_pct"))


def levels(df: DataFrame, tables: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A combined table as one table a level: its key first, then the columns it has, each
    different record once; records without a key are left out."""
    return {name: present(df, columns).where(F.col(columns[0]).isNotNull()).distinct() for name, columns in tables.items()}


def rule_hits(df: DataFrame, key: str, text: Column, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """key, hits (rule, category, confidence of each rule whose pattern the text has, in
    order), categories (each once, in order of its first hit), primary (of the first)."""
    hit = lambda r: F.when(text.rlike(r[1]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[2]).alias("category"), F.lit(r[3]).alias("confidence")))
    found = df.select(key, F.array_compact(F.array(*map(hit, rules))).alias("hits"))
    return found.withColumns({"categories": F.array_distinct(F.transform("hits", lambda h: h["category"])), "primary": F.coalesce(F.try_element_at("hits", F.lit(1))["category"], F.lit("unclassified"))})


def discrepancies(df: DataFrame, single_cell: list[str], selections: dict[str, str], expected: dict[str, str]) -> Column:
    """Names of what a record's words and its labels disagree in, a bar between. The
    columns: source, selection, protocol, about, assay, sc_or_bulk, selection_src,
    selection_class, conflicts."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text, asked = F.concat_ws(" ", low("protocol"), low("about")), low("selection")
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    source = F.upper(F.coalesce(F.col("source"), F.lit("")))
    said = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(label)) for w, label in selections.items())))
    bare = F.regexp_replace(asked, "[-()]", "")
    wrong = reduce(lambda a, b: a | b, (F.contains(bare, F.lit(k.replace("-", ""))) & (low("selection_src") != v) for k, v in expected.items()))
    return flags([
        ("sc_text|bulk_label", any_of(single_cell) & (source == "TRANSCRIPTOMIC") & (low("sc_or_bulk") == "bulk") & ~F.contains(low("conflicts"), F.lit("sc_tech"))),
        ("metatranscriptomic|rna_seq", (source == "METATRANSCRIPTOMIC") & (low("assay") == "rna_seq")),
        ("selection_text|selection_label", (F.size(said) > 0) & asked.isin("unspecified", "unknown", "other", "") & ~F.array_contains(said, low("selection_class")) & (low("selection_class") != "unknown")),
        ("selection_field|selection_label", wrong & (low("selection_src") != "unknown")),
    ])


def canonical_technology(c: Column) -> Column:
    """A short label of a curated technology; null stays null."""
    v = F.lower(c)
    any_of = lambda *words: reduce(lambda a, b: a | b, (F.contains(v, F.lit(w)) for w in words))
    return F.when(c.isNull(), None).when(any_of("10x", "chromium"), "10x").when(any_of("smart-seq", "smart_seq"), "smartseq").when(any_of("detct", "corall", "rrna", "ribodepletion"), "bulk_depleted").otherwise("bulk_or_other")


def shares_of(df: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """n of each group and the percentage of it for which each rule holds."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), *((100 * F.count_if(c) / n).alias(k) for k, c in rules.items()))


def balance(df: DataFrame, label: str, names: dict[int, int], ignored: int = -1) -> DataFrame:
    """label, n, share after labels were renamed; those named ``ignored`` are left out."""
    to = F.coalesce(reduce(lambda c, kv: c.when(F.col(label) == kv[0], kv[1]), names.items(), F.when(F.lit(False), 0)), F.col(label))
    n = df.select(to.alias(label)).where(F.col(label) != ignored).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # a row a label
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def named_members(df: DataFrame, by: list[str], members: Column, names: DataFrame, key: str, name: str) -> DataFrame:
    """Of each row's list of ids the names, in the list's order; ids without one stay."""
    each = df.select(*by, F.posexplode(members).alias("_at", "_id"))
    told = each.join(names.select(F.col(key).alias("_id"), F.col(name).alias("_name")), "_id", "left")
    whole = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_id").alias("_n")))).alias("_l"))
    return whole.select(*by, F.array_join(F.transform("_l", lambda x: x["_n"]), ",").alias("names"))


def only_here(rows: DataFrame, known: DataFrame, token: str, key: str, k: int = 3) -> DataFrame:
    """token, n, examples of the tokens that ``known`` doesn't have: how many rows have
    each, and the k smallest keys of these, which are kept before anything is gathered."""
    rogue = rows.select(key, token).distinct().join(known.select(token).distinct(), token, "left_anti")
    n = rogue.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    first = rogue.withColumn("_k", F.row_number().over(Window.partitionBy(token).orderBy(key))).where(F.col("_k") <= k)
    return n.join(first.groupBy(token).agg(F.array_sort(F.collect_list(key)).alias("examples")), token)


def leaves(paths: DataFrame, path: str, n: str) -> DataFrame:
    """path, n (its own and all below), depth, leaves and is_leaf of every node above or at
    the paths (parts between semicolons), and from, to: its arc as shares of all leaves, the
    leaves laid out in order of their paths."""
    parts = F.split(path, ";")
    up = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ";"))).alias("node"), F.col(path).alias("_of"), F.col(n).alias("_n"))
    node = up.groupBy("node").agg(F.sum("_n").alias("n"))
    inner = up.where("node <> _of").select("node").distinct()
    leaf = node.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"))
    placed = positions.ordered(leaf, ["leaf"], "_k")
    total = F.broadcast(placed.agg(F.count(F.lit(1)).alias("_all")))  # one row
    of = F.split("leaf", ";")
    spread = placed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(of)), lambda k: F.array_join(F.slice(of, 1, k), ";"))).alias("node"), "_k")
    arcs = spread.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"), F.min("_k").alias("_a"), F.max("_k").alias("_z"))
    both = node.join(arcs, "node").crossJoin(total).join(inner.withColumn("_inner", F.lit(True)), "node", "left")
    return both.select(F.col("node").alias("path"), "n", F.size(F.split("node", ";")).alias("depth"), "leaves", F.col("_inner").isNull().alias("is_leaf"), (F.col("_a") / F.col("_all")).alias("from"), ((F.col("_z") + 1) / F.col("_all")).alias("to"))
