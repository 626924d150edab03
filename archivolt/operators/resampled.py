"""Bootstrap intervals of all effect sizes of two sides, for many groups at once.

A row counts in each draw as often as a Poisson number of mean 1, from a hash of its key
and the draw, says; slot 0 counts each row once and gives the point values. Rows are not
multiplied by the draws: equal ones meet once and become one row with their summed weights,
a batch at a time; what is left is dealt out by ranges of (group, value), so a large group
isn't one task's. A part (a group's values in one range) makes the weights of its rows as a
matrix, value by slot. A first pass adds the parts up; each part then knows the weights
before and after it in all slots, and gives its share of the sums, and those order
statistics that lie in it. What is left of a part is a few numbers a slot, which a last
grouping adds up.

In a draw a quantile is that of the values as often as they count, interpolated linearly as
for the point. The deviations of the median absolute deviation are taken from the observed
median in all draws. A side that a draw leaves without a row makes its statistics of that
draw missing; intervals are over the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators.stored import Stored

#: Equal values of a batch are added up from so many on.
MERGE = 8
#: Rows whose weights are made at a time.
SLICE = 4096
#: Different values whose weights are held at a time.
VALUES = 1024
#: Odd factors of the mixing.
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def poisson_table() -> np.ndarray:
    """The Poisson number of mean 1 that each share of 65,536 stands for."""
    p, total, out = math.exp(-1), 0.0, np.zeros(1 << 16, np.uint8)
    for k in range(9):
        total += p
        out[math.ceil(total * (1 << 16)) :] = k + 1
        p /= k + 1
    return out


TABLE = poisson_table()


def weights(h: np.ndarray, draws: int) -> np.ndarray:
    """rows x (draws + 1): how often each row counts; once in slot 0."""
    blocks = -(-draws // 4)
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, blocks + 1, dtype=np.uint64)[None, :] * M3
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        x ^= x >> np.uint64(31)
    out = np.empty((len(h), draws + 1), np.uint8)
    out[:, 0] = 1
    out[:, 1:] = TABLE[x.astype("<u8", copy=False).view("<u2").reshape(len(h), -1)[:, :draws]]
    return out


def counted(df: DataFrame, by: list[str], value: str, flag: str, key: str, draws: int, store: Stored) -> DataFrame:
    """_g, _v, _f and either the hash _h of one row or the summed weights _w of equal ones
    (over ``MERGE`` of them); stored. Equal rows meet here once, for all that follows."""
    rows = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_v"), F.col(flag).cast("boolean").alias("_f"), F.xxhash64(key).alias("_h"))
    kind = dict(rows.dtypes)["_g"]
    name = F.to_json("_g", {"ignoreNullFields": "false"}).alias("_n")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, f, h = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            names = b.column(4).dictionary_encode().indices.to_numpy()
            order = np.lexsort((f, v, names))
            v, f, h, n = v[order], f[order], h[order], names[order]
            starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (f[1:] != f[:-1]) | (n[1:] != n[:-1])][: len(v)])
            size = np.diff(np.r_[starts, len(v)])
            large = size >= MERGE
            single = np.flatnonzero(np.repeat(~large, size))
            summed = [x.tobytes() for x in added(h[np.repeat(large, size)], size[large], draws)]
            at = np.r_[single, starts[large]]
            pick = pa.array(order[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), pa.array(v[at]), pa.array(f[at]), pa.array(np.r_[h[single], np.zeros(len(summed), np.int64)]), pa.array([None] * len(single) + summed, pa.binary())], ["_g", "_v", "_f", "_h", "_w"])

    met = rows.repartition("_g", "_v", "_f").sortWithinPartitions("_g", "_v", "_f")
    return store.table(met.select("*", name).mapInArrow(merged, f"_g {kind}, _v double, _f boolean, _h long, _w binary"), "merged")


def added(h: np.ndarray, size: np.ndarray, draws: int) -> Iterator[np.ndarray]:
    """The summed weights of runs of rows, about ``SLICE`` rows at a time."""
    ends = np.cumsum(size)
    k = 0
    while k < len(size):
        low = int(ends[k] - size[k])
        last = max(int(np.searchsorted(ends, low + SLICE, side="right")), k + 1)
        yield from np.add.reduceat(weights(h[low : ends[last - 1]], draws), ends[k:last] - size[k:last] - low, axis=0, dtype=np.int32)
        k = last


def dealt(rows: DataFrame, store: Stored) -> DataFrame:
    """The rows by ranges of (_g, _v), with the number of their part; stored."""
    parts = 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return store.table(rows.repartitionByRange(parts, "_g", "_v").withColumn("_part", F.spark_partition_id()), "dealt")


def summed_rows(t: pa.Table, draws: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of rows with summed weights, and these, a slice at a time."""
    w = t.column("_w")
    places = np.flatnonzero(~w.is_null().to_numpy())
    for s in range(0, len(places), SLICE):
        k = places[s : s + SLICE]
        yield k, np.frombuffer(b"".join(w.take(pa.array(k)).to_pylist()), np.int32).reshape(len(k), draws + 1)


def matrix(t: pa.Table, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's different values in order, and the weights of both sides at each."""
    v, f, h = (t.column(c).to_numpy() for c in ("_v", "_f", "_h"))
    values, at = np.unique(v, return_inverse=True)
    sides = np.zeros((2, len(values), draws + 1), np.int64)
    w = t.column("_w")
    plain = np.flatnonzero(w.is_null().to_numpy())
    for s in range(0, len(plain), SLICE):
        k = plain[s : s + SLICE]
        for side in (0, 1):
            mine = k[f[k] == bool(side)]
            order = mine[np.argsort(at[mine], kind="stable")]
            if len(order):
                spots, begins = np.unique(at[order], return_index=True)
                each = weights(h[order], draws)
                sides[side, spots] += each if len(spots) == len(order) else np.add.reduceat(each, begins, axis=0, dtype=np.int64)
    for places, each in summed_rows(t, draws):
        for k, x in zip(places.tolist(), each, strict=True):
            sides[int(f[k]), at[k]] += x
    return values, sides[1], sides[0]


def spots(total: np.ndarray, skip: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The two places, from 0, whose values a quantile lies between; -1 without a row."""
    place = (total - 1) * q
    low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    none = total < 1
    return np.where(none, -1, low + skip), np.where(none, -1, high + skip)


def at_places(values: np.ndarray, before: np.ndarray, reach: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values at places (place by slot), 0 where one isn't in this part."""
    out = np.zeros(places.shape)
    here = (places >= before) & (places < reach[-1])
    turned = np.ascontiguousarray(reach.T)
    for slot in np.flatnonzero(here.any(0)).tolist():
        k = np.flatnonzero(here[:, slot])
        out[k, slot] = values[np.searchsorted(turned[slot], places[k, slot], side="right")]
    return out


class Layout:
    """Which rows of a part's numbers are what."""

    def __init__(self, draws: int, qs: list[float], trim: float, threshold: float | None, sums: bool):
        self.draws, self.qs, self.trim, self.threshold, self.sums = draws, qs, trim, threshold, sums

    def totals(self, t: pa.Table) -> np.ndarray:
        """Of a part: both sides' weights, and those of values up to the threshold."""
        v, f, h = (t.column(c).to_numpy() for c in ("_v", "_f", "_h"))
        low = v <= (-np.inf if self.threshold is None else self.threshold)
        out = np.zeros((4, self.draws + 1), np.int64)
        single = t.column("_w").is_null().to_numpy()
        masks = [f, ~f, f & low, ~f & low]
        plain = np.flatnonzero(single)
        for s in range(0, len(plain), SLICE):
            k = plain[s : s + SLICE]
            each = weights(h[k], self.draws)
            for row, mask in enumerate(masks):
                if mask[k].any():
                    out[row] += each[mask[k]].sum(0, dtype=np.int64)
        for k, each in summed_rows(t, self.draws):
            for row, mask in enumerate(masks):
                if mask[k].any():
                    out[row] += each[mask[k]].sum(0, dtype=np.int64)
        return out

    def numbers(self, t: pa.Table, before: np.ndarray, total: np.ndarray, following: float | None) -> np.ndarray:
        """Of a part, ``VALUES`` different values at a time, so that its memory doesn't grow
        with it: each block's numbers, added up."""
        t = t.take(pa.array(np.argsort(t.column("_v").to_numpy(), kind="stable")))
        v = t.column("_v").to_numpy()
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])[::VALUES].tolist()
        out, before = 0.0, before.copy()
        for low, high in zip(starts, [*starts[1:], len(v)], strict=True):
            values, a, b = matrix(t.slice(low, high - low), self.draws)
            out = out + self.block(values, a, b, before, total, float(v[high]) if high < len(v) else following)
            before[:2] += a.sum(0), b.sum(0)
        return out

    def block(self, values: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray, total: np.ndarray, following: float | None) -> np.ndarray:
        out = []
        ca, cb = (np.cumsum(w, 0) + before[side] for side, w in ((0, a), (1, b)))
        if self.sums:
            out.append((a * (2 * (ca + cb) - (a + b) + 1)).sum(0) / 2)
            wide = np.diff(np.r_[values, values[-1] if following is None else following])
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append((np.abs(ca / total[0] - cb / total[1]) * wide[:, None]).sum(0))
            for w, c, n in ((a, ca, total[0]), (b, cb, total[1])):
                cut = np.floor(n * self.trim).astype(np.int64)
                kept = np.maximum(np.minimum(c, n - cut) - np.maximum(c - w, cut), 0)
                out += [(kept * values[:, None]).sum(0), kept.sum(0)]
        wanted = [(q, False) for q in self.qs] + ([(0.5, True)] if self.threshold is not None else [])
        for side, c in ((0, ca), (1, cb)):
            places = []
            for q, over in wanted:
                skip = total[2 + side] if over else np.zeros(self.draws + 1, np.int64)
                places += spots(total[side] - skip, skip, q)
            out += [*at_places(values, before[side], c, np.stack(places))]
        return np.stack(out)

    def quantile(self, numbers: np.ndarray, total: np.ndarray, side: int, k: int, over: bool = False) -> np.ndarray:
        """The k-th wanted quantile of a side in all slots."""
        per = len(self.qs) + (self.threshold is not None)
        at = (6 if self.sums else 0) + 2 * (side * per + k)
        n = total[side] - (total[2 + side] if over else 0)
        q = 0.5 if over else self.qs[k]
        place = (n - 1) * q
        low, high = numbers[at], numbers[at + 1]
        return np.where(n > 0, low + (high - low) * (place - np.floor(place)), np.nan)


def gathered(rows: DataFrame, layout: Layout, store: Stored) -> DataFrame:
    """_g, total and numbers of each group, over all its parts."""
    kind = dict(rows.dtypes)["_g"]
    slots = layout.draws + 1

    def first(key: tuple, t: pa.Table) -> pa.Table:
        least = t.column("_v").to_numpy().min()
        return pa.table({"_g": t.column("_g").slice(0, 1), "_part": t.column("_part").slice(0, 1), "least": [least], "total": pa.array([layout.totals(t).tobytes()], pa.binary())})

    each = rows.groupBy("_g", "_part").applyInArrow(first, f"_g {kind}, _part int, least double, total binary")

    def placed(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("_part").to_numpy())
        t = t.take(pa.array(order))
        sums = np.stack([np.frombuffer(x, np.int64).reshape(4, slots) for x in t.column("total").to_pylist()])
        before = np.cumsum(sums, 0) - sums
        return pa.table({"_g": t.column("_g"), "_part": t.column("_part"), "before": pa.array([x.tobytes() for x in before], pa.binary()), "total": pa.array([sums.sum(0).tobytes()] * len(sums), pa.binary()), "following": pa.array([*t.column("least").to_pylist()[1:], None], pa.float64())})

    places = store.table(each.groupBy("_g").applyInArrow(placed, f"_g {kind}, _part int, before binary, total binary, following double"), "places")

    def second(t: pa.Table, p: pa.Table) -> pa.Table:
        p = p.to_pylist()[0]
        total = np.frombuffer(p["total"], np.int64).reshape(4, slots)
        numbers = layout.numbers(t, np.frombuffer(p["before"], np.int64).reshape(4, slots), total, p["following"])
        return pa.table({"_g": t.column("_g").slice(0, 1), "total": pa.array([p["total"]], pa.binary()), "numbers": pa.array([numbers.tobytes()], pa.binary())})

    shares = rows.groupBy("_g", "_part").cogroup(places.groupBy("_g", "_part")).applyInArrow(second, f"_g {kind}, total binary, numbers binary")

    def added(t: pa.Table) -> pa.Table:
        held = 0.0
        for x in t.column("numbers"):
            held = held + np.frombuffer(x.as_py())
        return pa.table({"_g": t.column("_g").slice(0, 1), "total": t.column("total").slice(0, 1), "numbers": pa.array([held.tobytes()], pa.binary())})

    return store.table(shares.groupBy("_g").applyInArrow(added, f"_g {kind}, total binary, numbers binary"), "gathered")


def intervals(df: DataFrame, key: str, value: str, flag: str, by: list[str], draws: int = 400, level: float = 0.95, trim: float = 0.2, threshold: float | None = 0.0, steps: int = 9, least: float = 1e-12) -> DataFrame:
    """by, effect, point, low, high: all effect sizes of the flagged side against the other
    with percentile intervals over ``draws``: median_diff, trimmed_diff, mad_control,
    delta_star, a, delta, wasserstein, shift_1 and so on, and with a threshold rate_diff and
    positive_median_diff. Groups without rows of both sides are left out. The order of
    ``by`` and its nulls are kept; equal keys count alike in all draws."""
    spark = df.sparkSession
    store = Stored(spark)
    qs = [k / (steps + 1) for k in range(1, steps + 1)]
    if 0.5 not in qs:
        qs.append(0.5)
    main = Layout(draws, qs, trim, threshold, True)
    whole = Layout(draws, [0.5], 0.0, None, False)
    good = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    some = good.groupBy(*by).agg(F.count_if(F.col(flag)).alias("_n"), F.count_if(~F.col(flag)).alias("_m")).where("_n > 0 and _m > 0")
    inside = F.struct(*by)
    kept = good.withColumn("_g", inside).join(some.select(inside.alias("_g")), "_g", "left_semi")
    every = counted(kept, by, value, flag, key, draws, store)
    rows = dealt(every, store)
    found = gathered(rows, main, store)
    middle = qs.index(0.5)
    kind = dict(rows.dtypes)["_g"]

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(np.frombuffer(t, np.int64).reshape(4, -1), np.frombuffer(n).reshape(-1, draws + 1)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(main.quantile(n, t, 1, middle)[0]) for t, n in made], pa.float64())], ["_g", "_c"])

    centres = found.mapInArrow(centre, f"_g {kind}, _c double")
    # deviations of the other side from its median, and of all rows from theirs
    off = lambda some, c: some.join(c, "_g").withColumn("_v", F.abs(F.col("_v") - F.col("_c"))).drop("_c")
    mads = gathered(dealt(off(every.where(~F.col("_f")), centres), store), whole, store)
    one_side = every.withColumn("_f", F.lit(False))
    pooled = gathered(rows.withColumn("_f", F.lit(False)), whole, store)

    def pooled_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(np.frombuffer(t, np.int64).reshape(4, -1), np.frombuffer(n).reshape(-1, draws + 1)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(whole.quantile(n, t, 1, 0)[0]) for t, n in made], pa.float64())], ["_g", "_c"])

    all_off = off(one_side, pooled.mapInArrow(pooled_centre, f"_g {kind}, _c double"))
    pooled_mads = gathered(dealt(all_off, store), whole, store)
    together = found.join(mads.select("_g", F.col("total").alias("mt"), F.col("numbers").alias("mn")), "_g").join(pooled_mads.select("_g", F.col("total").alias("pt"), F.col("numbers").alias("pn")), "_g")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, str, float, float, float]] = []
            for k, (t, n, mt, mn, pt, pn) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                t, mt, pt = (np.frombuffer(x, np.int64).reshape(4, -1) for x in (t, mt, pt))
                n, mn, pn = (np.frombuffer(x).reshape(-1, draws + 1) for x in (n, mn, pn))
                for name, x in effects(main, whole, t, n, whole.quantile(mn, mt, 1, 0), whole.quantile(pn, pt, 1, 0), steps, least):
                    drawn = x[1:][np.isfinite(x[1:])]
                    low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2]) if len(drawn) else (np.nan, np.nan)
                    out.append((k, name, float(x[0]), float(low), float(high)))
            at, names, point, low, high = zip(*out, strict=True) if out else ((),) * 5
            none = lambda x: pa.array([None if v != v else v for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), none(point), none(low), none(high)], ["_g", "effect", "point", "low", "high"])

    made = store.table(together.mapInArrow(finished, f"_g {kind}, effect string, point double, low double, high double"), "intervals", keep=True)
    store.clear()
    return made.select("_g.*", "effect", "point", "low", "high")


def effects(main: Layout, whole: Layout, total: np.ndarray, n: np.ndarray, mad: np.ndarray, pooled: np.ndarray, steps: int, least: float) -> Iterator[tuple[str, np.ndarray]]:
    """Each effect size in all slots."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = total[0].astype(float), total[1].astype(float)
        some = (x > 0) & (y > 0)
        gap = lambda k, over=False: main.quantile(n, total, 0, k, over) - main.quantile(n, total, 1, k, over)
        median = gap(main.qs.index(0.5))
        yield "median_diff", median
        yield "trimmed_diff", n[2] / n[3] - n[4] / n[5]
        mad, pooled = 1.4826 * mad, 1.4826 * pooled
        yield "mad_control", mad
        yield "delta_star", median / np.where(mad > least, mad, np.where(pooled > least, pooled, 1.0))
        a = np.where(some, (n[0] - x * (x + 1) / 2) / (x * y), np.nan)
        yield "a", a
        yield "delta", 2 * a - 1
        yield "wasserstein", np.where(some, n[1], np.nan)
        for k in range(steps):
            yield f"shift_{k + 1}", gap(k)
        if main.threshold is not None:
            yield "rate_diff", (x - total[2]) / x - (y - total[3]) / y
            yield "positive_median_diff", gap(len(main.qs), True)
