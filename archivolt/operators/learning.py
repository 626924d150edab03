"""Principal components, kernel and boosted classifiers, tail and skew fences, and
clusters of groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.operators import ordered
from archivolt.operators.ordered import beside, counted, of_counts, quantiles, running, written
from archivolt.operators.stored import Stored


def components(df: DataFrame, vector: str, k: int, scale: bool = False) -> DataFrame:
    """component (from 1), the share of the variance that it explains, and that up to
    it. The covariance is added up where the rows are."""
    rows = df.select(array_to_vector(vector).alias("x"))
    if scale:
        rows = StandardScaler(inputCol="x", outputCol="s", withMean=True).fit(rows).transform(rows).select(F.col("s").alias("x"))
    ratios = PCA(k=k, inputCol="x", outputCol="p").fit(rows).explainedVariance.toArray()
    made = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, np.cumsum(ratios), strict=True))]
    return df.sparkSession.createDataFrame(made, "component int, share double, cumulative double")


#: Vectors whose features a task makes at a time.
ROWS = 512


def cosines(vs: pa.Array, w: np.ndarray, b: np.ndarray) -> pa.Array:
    """The features of each vector, in one flat array: no list of rows, and no copy but of
    ``ROWS`` rows."""
    if vs.null_count:
        raise ValueError("null vectors have no features")
    (dims, features), out = w.shape, np.empty((len(vs), w.shape[1]))
    x = vs.flatten().to_numpy(zero_copy_only=False).reshape(len(vs), dims)
    for low in range(0, len(vs), ROWS):
        part = out[low : low + ROWS]
        np.matmul(x[low : low + ROWS], w, out=part)
        part += b
        np.cos(part, out=part)
        part *= np.sqrt(2 / features)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, features, dtype=np.int32)), pa.array(out.ravel()))


def fourier(vector: Column, dims: int, gamma: float, features: int = 256, seed: int = 42) -> Column:
    """Random cosines whose products are near those of the radial-basis kernel."""
    draw = np.random.default_rng(seed)
    w, b = draw.normal(0, math.sqrt(2 * gamma), (dims, features)), draw.uniform(0, 2 * math.pi, features)

    def run(vs: pa.Array) -> pa.Array:
        return cosines(vs, w, b)

    return F.arrow_udf(run, "array<double>")(vector)


def radial(df: DataFrame, key: str, vector: str, label: Column, dims: int, gamma: float, rounds: int = 50) -> DataFrame:
    """key, y, probability of the rows that aren't in ``train``; classes weigh the same."""
    rows = df.select(key, fourier(F.col(vector).cast("array<double>"), dims, gamma).alias("f"), label.cast("double").alias("y"), "train").withColumn("x", array_to_vector("f"))
    n = rows.where("train").groupBy("y").count()
    train = rows.where("train").join(F.broadcast(n.select("y", (1.0 / F.col("count")).alias("weight"))), "y")  # a row a class
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=rounds).fit(train)
    return model.transform(rows.where("not train")).select(key, "y", vector_to_array("probability")[1].alias("probability"))


def boosted(df: DataFrame, vector: str, label: str, rounds: int = 5, depth: int = 3) -> DataFrame:
    """label, precision, recall, f1 of the rows that aren't in ``train``, by boosted trees
    for each class against the others."""
    rows = df.select(array_to_vector(vector).alias("x"), F.col(label).cast("double").alias("y"), "train")
    one = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, maxBins=256, seed=42)
    held = OneVsRest(classifier=one, featuresCol="x", labelCol="y").fit(rows.where("train")).transform(rows.where("not train"))
    ends = held.select(F.explode(F.array(F.struct(F.col("y").alias("label"), (F.col("y") == F.col("prediction")).alias("hit"), F.lit(1).alias("true"), F.lit(0).alias("said")), F.struct(F.col("prediction").alias("label"), F.lit(False).alias("hit"), F.lit(0).alias("true"), F.lit(1).alias("said")))).alias("e")).select("e.*")
    s = ends.groupBy("label").agg(F.count_if("hit").alias("tp"), F.sum("true").alias("true"), F.sum("said").alias("said"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select(F.col("label").cast("int").alias("label"), zero(F.col("tp"), F.col("said")).alias("precision"), zero(F.col("tp"), F.col("true")).alias("recall"), zero(2 * F.col("tp"), F.col("said") + F.col("true")).alias("f1"))


def _beside_quantiles(groups: DataFrame, df: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """The groups with quantiles from the ordered counts, which no task holds whole; null
    where a group has no value."""
    found = quantiles(df, by, value, wanted).select(F.struct(*by).alias("_found"), *wanted)
    return groups.withColumn("_row", F.struct(*by)).join(found, F.col("_row") == F.col("_found"), "left").drop("_row", "_found")


def tail_fence(df: DataFrame, value: str, by: list[str], base: float = 0.95, alpha: float = 0.005) -> DataFrame:
    """upper: the value that a share ``alpha`` of each group exceeds, after a generalised
    Pareto tail over the ``base`` quantile. Its shape and scale are those of the
    exceedances' mean and variance, which add up in any order, rather than of their
    likelihood. Where the exceedances don't vary, upper is that quantile."""
    q = _beside_quantiles(df.groupBy(*by).agg(F.count(value).alias("_n")), df, value, by, {"_u": base})
    over = df.join(q, by).where(F.col(value) > F.col("_u")).groupBy(*by).agg(F.avg(F.col(value) - F.col("_u")).alias("_m"), F.var_samp(F.col(value) - F.col("_u")).alias("_v"), F.count(F.lit(1)).alias("_k"))
    ratio = F.col("_m") * F.col("_m") / F.col("_v")
    shape, scale = (1 - ratio) / 2, F.col("_m") * (ratio + 1) / 2
    left = alpha * F.col("_n") / F.col("_k")
    reach = F.when(F.abs(shape) < 1e-9, -scale * F.ln(left)).otherwise(scale / shape * (F.pow(left, -shape) - 1))
    return q.join(over, by, "left").select(*by, (F.col("_u") + F.when(F.col("_v") > 0, reach).otherwise(0.0)).alias("upper"))


#: The width of what is left of a medcouple's range when its search ends; sections of
#: the range that a round counts.
CLOSE, SECTIONS = 1e-12, 32


class _Kernel:
    """Counts of the medcouple's kernel h = (up - down) / (up + down) over all pairs of a
    value at or over the median and one at or under it. Pairs of one at the median are -1 or
    1, pairs of two by their places -1, 0 or 1, so that these cancel out; of others h <= t
    where up <= down (1 + t) / (1 - t)."""

    def __init__(self, low: int, high: int, at: int):
        self.at, self.neg, self.pos = at, at * low + at * (at - 1) // 2, at * high + at * (at - 1) // 2
        self.pairs = (low + at) * (high + at)

    def targets(self) -> list[int]:
        return sorted({(self.pairs - 1) // 2, self.pairs // 2})

    def known(self, k: int) -> float | None:
        return -1.0 if k < self.neg else 1.0 if k >= self.pairs - self.pos else None

    def upto(self, inner: int, t: float) -> int:
        return self.neg + inner + self.at * (t >= 0)


def _ratio(t: float) -> float:
    return (1 + t) / (1 - t)


def _under(down: np.ndarray, n: np.ndarray, up: np.ndarray, before: np.ndarray, t: float) -> int:
    """Pairs with h <= t; ``before`` are the running counts of ``up``, from 0."""
    return int((n * before[np.searchsorted(up, down * _ratio(t), side="right")]).sum())


def _counted_medcouple(x: np.ndarray, n: np.ndarray) -> float:
    """The medcouple of different values with their counts."""
    order = np.argsort(x)
    x, n = x[order], n[order].astype(np.int64)
    ends = np.cumsum(n)
    m = x[np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")]
    off = x - (m[0] + (m[1] - m[0]) * 0.5)
    down, up = -off[off < 0][::-1], off[off > 0]
    nd, before = n[off < 0][::-1], np.r_[0, np.cumsum(n[off > 0])]
    kernel, found = _Kernel(int(nd.sum()), int(before[-1]), int(n[off == 0].sum())), []
    for k in kernel.targets():
        low, high = -1.0, 1.0
        while kernel.known(k) is None and high - low > CLOSE:
            t = (low + high) / 2
            low, high = (low, t) if kernel.upto(_under(down, nd, up, before, t), t) > k else (t, high)
        found.append(high if kernel.known(k) is None else kernel.known(k))
    return float(np.mean(found))


def _medcouple(points: list[float]) -> float:
    return _counted_medcouple(*np.unique(np.asarray(points, float), return_counts=True))


def _block(t: pa.Table) -> pa.Table:
    """Values of one side of a large group and their counts, as one row."""
    x, n = t.column("x").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(x)
    one = {c: t.column(c).slice(0, 1) for c in ("id", "side", "block")}
    return pa.table(one | {"x": pa.array([x[order].tobytes()]), "n": pa.array([n[order].astype(np.int64).tobytes()])})


def _large_medcouples(held: DataFrame, of: DataFrame, by: list[str], value: str) -> list[float]:
    """The medcouples of the groups (a struct ``_of``, ``id``), each of too many values for
    one task, in order of ``id``: their values lie in blocks, and the driver, which has a row
    a block, searches the range of h. Pairs of blocks that lie on one side of what is left of
    the range are known by their counts; the others are written once, and each round counts
    their pairs where they are."""
    spark = held.sparkSession
    store = Stored(spark)
    rows = held.withColumn("_g", F.struct(*by)).join(F.broadcast(of), F.col("_g") == F.col("_of")).select("id", F.col(value).cast("double").alias("v"), "n")
    rows = store.table(rows, "large")
    mid = of_counts(rows, ["id"], "v", {"m": 0.5})
    placed = beside(running(rows, ["id"], "v", ["n"], rows), store.table(mid, "mid"), ["id"])
    off = F.col("v") - F.col("m")
    blocks = placed.select("id", (off > 0).alias("side"), F.floor(F.col("before_n") / max(1, ordered.MOST // 4)).alias("block"), F.abs(off).alias("x"), "n")
    packed = store.table(blocks.where("x > 0").groupBy("id", "side", "block").applyInArrow(_block, "id int, side boolean, block long, x binary, n binary"), "blocks")
    seen = blocks.groupBy("id", (F.col("x") == 0).alias("mid"), "side", "block").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.sum("n").alias("n")).orderBy("id", "block").collect()
    of_id, kernels, ranges = {}, {}, {}
    for g in sorted({r.id for r in seen}):
        side = [[r for r in seen if r.id == g and not r.mid and r.side == s] for s in (False, True)]
        d, u = ({c: np.array([r[c] for r in s]) for c in ("block", "least", "most", "n")} for s in side)
        kernels[g] = _Kernel(int(d["n"].sum()), int(u["n"].sum()), sum(r.n for r in seen if r.id == g and r.mid))
        of_id[g] = d, u
        for k in kernels[g].targets():
            end = kernels[g].known(k)
            ranges[g, k] = (-1.0, 1.0) if end is None else (end, end)

    def around(g: int, t: float) -> tuple[int, np.ndarray]:
        """Pairs known to have h <= t, and the pairs of blocks that aren't known."""
        d, u = of_id[g]
        whole = u["most"] <= d["least"][:, None] * _ratio(t) * (1 - 1e-12)
        none = u["least"] > d["most"][:, None] * _ratio(t) * (1 + 1e-12)
        return int((d["n"][:, None] * u["n"] * whole).sum()), ~whole & ~none

    # as far as blocks tell
    for (g, k), (low, high) in ranges.items():
        while high - low > CLOSE:
            t = (low + high) / 2
            known, open_ = around(g, t)
            d, u = of_id[g]
            if kernels[g].upto(known, t) > k:
                high = t
            elif kernels[g].upto(known + int((d["n"][:, None] * u["n"] * open_).sum()), t) <= k:
                low = t
            else:
                break
        ranges[g, k] = low, high
    tiles, sure = [], {}
    for g, (d, u) in of_id.items():
        ends = [e for (h, _), e in ranges.items() if h == g and e[1] - e[0] > CLOSE]
        if ends:
            low, high = min(e[0] for e in ends), max(e[1] for e in ends)
            ratios = [0.0 if low <= -1 else _ratio(low) * (1 - 1e-12), np.inf if high >= 1 else _ratio(high) * (1 + 1e-12)]
            whole, none = u["most"] <= d["least"][:, None] * ratios[0], u["least"] > d["most"][:, None] * ratios[1]
            sure[g] = int((d["n"][:, None] * u["n"] * whole).sum())
            tiles += [(g, int(d["block"][i]), int(u["block"][j])) for i, j in zip(*np.nonzero(~whole & ~none), strict=True)]
    if tiles:
        pairs = F.broadcast(spark.createDataFrame(tiles, "id int, a long, b long"))  # as many as two blocks' ends
        down = packed.where("not side").select("id", F.col("block").alias("a"), F.col("x").alias("down"), F.col("n").alias("nd")).join(pairs, ["id", "a"])
        up = packed.where("side").select("id", F.col("block").alias("b"), F.col("x").alias("up"), F.col("n").alias("nu"))
        met = store.table(down.join(up, ["id", "b"]).repartition(len(tiles), "a", "b").select("id", "down", "nd", "up", "nu"), "tiles")
    while any(high - low > CLOSE for low, high in ranges.values()):
        at = {g: sorted({float(t) for (h, _), (low, high) in ranges.items() if h == g and high - low > CLOSE for t in np.linspace(low, high, SECTIONS + 1)[1:-1]}) for g in of_id}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    down, up = np.frombuffer(x["down"]), np.frombuffer(x["up"])
                    nd, before = np.frombuffer(x["nd"], np.int64), np.r_[0, np.cumsum(np.frombuffer(x["nu"], np.int64))]
                    ts = at[x["id"]]  # noqa: B023
                    yield pa.RecordBatch.from_pydict({"id": pa.array([x["id"]] * len(ts), pa.int32()), "t": pa.array(ts, pa.float64()), "n": pa.array([_under(down, nd, up, before, t) for t in ts], pa.int64())})

        found = {(r.id, r.t): r.n for r in met.mapInArrow(count, "id int, t double, n long").groupBy("id", "t").agg(F.sum("n").alias("n")).collect()}
        for (g, k), (low, high) in ranges.items():
            if high - low > CLOSE:
                mine = [t for t in at[g] if low < t < high]
                over = [t for t in mine if kernels[g].upto(sure[g] + found[g, t], t) > k]
                high = min(over, default=high)
                ranges[g, k] = max((t for t in mine if t < high), default=low), high
    store.clear()
    return [float(np.mean([e[1] for (h, _), e in ranges.items() if h == g])) for g in sorted(of_id)]


def medcouples(held: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and mc of each group of a written table of counts ``n``, over all pairs of its
    values. A group of up to ``ordered.MOST`` different values is one task's."""
    spark = held.sparkSession
    size = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = [tuple(r)[:-1] for r in size.where(F.col("_n") > ordered.MOST).collect()]  # a row for so many values
    kinds = ", ".join(f"`{c}` {dict(held.dtypes)[c]}" for c in by)

    def run(t: pa.Table) -> pa.Table:
        return t.select(by).slice(0, 1).append_column("mc", pa.array([_counted_medcouple(t.column(value).cast(pa.float64()).to_numpy(), t.column("n").to_numpy())]))

    if not large:
        return held.groupBy(*by).applyInArrow(run, f"{kinds}, mc double")
    of = spark.createDataFrame([(*r, k) for k, r in enumerate(large)], f"{kinds}, id int").select(F.struct(*by).alias("_of"), "id")
    few = held.withColumn("_g", F.struct(*by)).join(F.broadcast(of), F.col("_g") == F.col("_of"), "left_anti").drop("_g")
    made = spark.createDataFrame([(*r, mc) for r, mc in zip(large, _large_medcouples(held, of, by, value), strict=True)], f"{kinds}, mc double")
    return few.groupBy(*by).applyInArrow(run, f"{kinds}, mc double").unionByName(made)


def skew_fences(df: DataFrame, value: str, by: list[str], factor: float = 1.5) -> DataFrame:
    """lower, upper: quartile fences that follow each group's skewness, the medcouple over
    all pairs of its values. Groups without a value have no row."""
    held = written(counted(df, by, value))
    q = beside(of_counts(held, by, value, {"l": 0.25, "h": 0.75}), medcouples(held, by, value), by)
    span, mc = F.col("h") - F.col("l"), F.col("mc")
    down = F.when(mc >= 0, F.exp(-4 * mc)).otherwise(F.exp(-3 * mc))
    up = F.when(mc >= 0, F.exp(3 * mc)).otherwise(F.exp(4 * mc))
    return q.select(*by, "mc", (F.col("l") - factor * down * span).alias("lower"), (F.col("h") + factor * up * span).alias("upper"))


def group_distances(df: DataFrame, group: str, value: str, points: int = 21) -> DataFrame:
    """a < b, distance of all pairs of groups: the mean gap of their quantiles."""
    at = F.array(*(F.lit((i + 0.5) / points) for i in range(points)))
    q = df.groupBy(group).agg(F.percentile(value, at).alias("q"))
    a, b = q.select(F.col(group).alias("a"), F.col("q").alias("x")), q.select(F.col(group).alias("b"), F.col("q").alias("y"))
    gap = F.aggregate(F.zip_with("x", "y", lambda s, t: F.abs(s - t)), F.lit(0.0), lambda s, t: s + t) / points
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", gap.alias("distance"))


def nearest_rank(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n largest and the n smallest of each group (``side`` top or bottom)."""
    w = Window.partitionBy(*by)
    key = [c for c in df.columns if c not in (*by, value)]
    r = df.withColumns({"_t": F.row_number().over(w.orderBy(F.desc(value), *key)), "_b": F.row_number().over(w.orderBy(F.asc(value), *key))})
    side = F.when(F.col("_t") <= n, "top").otherwise("bottom")
    return r.where((F.col("_t") <= n) | (F.col("_b") <= n)).withColumn("side", side).drop("_t", "_b")
