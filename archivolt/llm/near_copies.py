"""Near copies: texts whose sets of five-word shingles have a Jaccard index of 0.8 or
more. The tiled SimHash comparison finds candidates, exact comparison decides.

Each row has its set of shingles (64 bits of its sorted values) and a SimHash of 512
bits over the set. Sets of index 0.8 differ in 15 % of the bits: 78 of 512, give or
take 8, and 19 of the first 128, give or take 4; so ``RADIUS`` loses less than one pair
in 10,000 (README has the measured recall), and most pairs that it lets through have
an index over 0.6. Tiles hold sets of one class of size. Tile pairs are skipped whose
sizes allow no index of 0.8 or whose population counts differ beyond the radius; of the
others the first 128 bits are compared in full with exclusive-or and bit counts, and of
what is near in these the rest.

The first search returns each set's nearest candidate alone, a row a set. These pairs are
verified and joined into components: so a text links the variants that were made of
it. The second search takes the sets that had a candidate, with their values, in tiles
of bounded bytes. It verifies, nearest first, all candidates that aren't in one
component yet, there and then, and returns what links components. So no search returns
more than a row a set and block, a group whose texts are alike costs little more than
its size, and all pairs count. Texts that are near, not alike and not linked otherwise
cost a comparison each pair. Nothing is sampled or capped.

Sets of fewer than ``LEAST`` shingles are alike only if equal. Texts without a word
have the empty set and are copies of each other. A row is its id and text, as in
``simhash``. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, materialise, remove, shuffle_parts, texts_of
from archivolt.llm.simhash import BLOCK, TILE, block_pairs, connected, identified, named_rows, shingle_hashes

WIDTH = 5
#: Words of a SimHash, those compared first, and the bits that may differ in these and in all.
WORDS, FIRST, RADIUS_FIRST, RADIUS = 8, 2, 38, 110
#: Smallest set that can have an index of 0.8 with a different one: 4 of 5.
LEAST = 4
#: Sizes of index 0.8 are in the ratio 1.25 at most: in one class of this base, or the next.
CLASS = 1.26
#: Tasks that the members of one set's pairs are dealt out to.
SALTS = 8
#: Bytes of sets of a tile, and tiles of a block, of the second search: what a task holds.
TILE_BYTES, SIDE = 4 << 20, 8
#: Candidates that are verified before components are looked up again.
CHUNK = 4096
#: Added to the hashes to make others; fixed values.
STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Beyond all distances.
FAR = 1 << 14


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def set_id(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), 42)).view(np.int64))


def signature(values: np.ndarray) -> bytes:
    """The bits that more than half of the set's hashes have: of the hashes themselves, and
    of hashes made of them."""
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(values), 255):
        x = values[k : k + 255, None] + STEPS
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        # up to 255 rows can be added up in bytes
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(values), bitorder="little").tobytes()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard index of two sets is 0.8 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag, set, n (the set's size), sign (its SimHash) of each row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary())],
                ["doc_id", "tag", "set", "n", "sign"],
            )

    return identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, tag long, set long, n int, sign binary")


def contents(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set, vals (its sorted values) of the rows of ``docs`` that ``named`` has."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "vals"])

    return named_rows(docs, named, id_col, text_col).select(F.col(text_col).cast("string")).mapInArrow(run, "set long, vals binary")


def tiles(sets: DataFrame) -> DataFrame:
    """tile, level (the class of size) and, as bytes, set, root, n and sign of up to
    ``TILE`` sets; where ``sets`` has their values, these too (vals, end to end), up to
    ``TILE_BYTES`` (a larger set is a tile of its own)."""
    columns = ["set", "root", "n", "sign", *(["vals"] if "vals" in sets.columns else [])]
    keyed = sets.select(F.floor(F.log("n") / float(np.log(CLASS))).cast("int").alias("level"), *columns)
    order = ["level", "n", "set"]
    dealt = keyed.repartitionByRange(shuffle_parts(sets.sparkSession), *order).sortWithinPartitions(*order)
    schema = pa.schema([("tile", pa.int64()), ("level", pa.int32()), *((c, pa.binary()) for c in columns)])

    def run(batches):
        held: list[tuple] = []
        weight = 0

        def row():
            level, sets, roots, n, *rest = zip(*held, strict=True)
            made = {"tile": min(sets), "level": level[0], "set": np.array(sets, np.int64).tobytes(), "root": np.array(roots, np.int64).tobytes(), "n": np.array(n, np.int32).tobytes()}
            held.clear()
            return made | {c: b"".join(x) for c, x in zip(columns[3:], rest, strict=True)}

        for b in batches:
            out = []
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = len(x[-1])
                if held and (held[0][0] != x[0] or len(held) == TILE or weight + size > TILE_BYTES):
                    out.append(row())
                    weight = 0
                held.append(x)
                weight += size
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return dealt.mapInArrow(run, "tile long, level int, " + ", ".join(f"{c} binary" for c in columns))


class Tile:
    def __init__(self, row: dict):
        self.tile = row["tile"]
        self.set, self.root, self.n = (np.frombuffer(row[c], t) for c, t in (("set", np.int64), ("root", np.int64), ("n", np.int32)))
        self.sign = np.frombuffer(row["sign"], np.uint64).reshape(-1, WORDS)
        self.first = [np.ascontiguousarray(self.sign[:, k]) for k in range(FIRST)]
        bits = np.bitwise_count(self.sign).sum(axis=1, dtype=np.int64)
        self.vals = np.split(np.frombuffer(row["vals"], np.uint64), np.cumsum(self.n[:-1])) if "vals" in row else None
        self.least, self.most, self.low, self.high = int(self.n.min()), int(self.n.max()), int(bits.min()), int(bits.max())

    def out_of_reach(self, other: Tile) -> bool:
        by_size = 5 * self.most < 4 * other.least or 5 * other.most < 4 * self.least
        return by_size or self.low - other.high > RADIUS or other.low - self.high > RADIUS


def distances(x: Tile, y: Tile):
    """Blocks (k, d): the differing bits of some sets of x from the k-th on and all of y;
    ``FAR`` beyond the radius, where sizes allow no index of 0.8, and in one component.
    Blocks without a candidate are left out."""
    step = max(1, BLOCK // len(y.n))
    for k in range(0, len(x.n), step):
        near = np.zeros((min(step, len(x.n) - k), len(y.n)), np.uint8)
        for a, b in zip(x.first, y.first, strict=True):
            near += np.bitwise_count(a[k : k + step, None] ^ b[None, :])
        i, j = np.nonzero(near <= RADIUS_FIRST)
        if not len(i):
            continue
        n, m = x.n[k + i].astype(np.int64), y.n[j].astype(np.int64)
        ok = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (x.root[k + i] != y.root[j])
        i, j = i[ok], j[ok]
        bits = np.bitwise_count(x.sign[k + i] ^ y.sign[j]).sum(axis=1, dtype=np.int16)
        ok = bits <= RADIUS
        if ok.any():
            d = np.full(near.shape, FAR, np.int16)
            d[i[ok], j[ok]] = bits[ok]
            yield k, d


def nearest(x: Tile, y: Tile) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """u, v, d: the nearest candidate of each set of both tiles that has any."""
    out = []
    best, of = np.full(len(y.n), FAR, np.int16), np.zeros(len(y.n), np.int64)
    for k, d in distances(x, y):
        low = d.min(axis=0)
        closer = low < best
        best[closer], of[closer] = low[closer], k + d.argmin(axis=0)[closer]
        i = np.flatnonzero(d.min(axis=1) < FAR)
        j = d[i].argmin(axis=1)
        out.append((x.set[k + i], y.set[j], d[i, j]))
    there = np.flatnonzero(best < FAR)
    out.append((y.set[there], x.set[of[there]], best[there]))
    return out


def met(left: pa.Table, right: pa.Table, own: bool):
    """The pairs of tiles of two blocks that are to be compared."""
    a = [Tile(r) for r in left.to_pylist()]
    b = a if own else [Tile(r) for r in right.to_pylist()]
    return a, b, [(p, q) for p in a for q in b if not (own and p.tile > q.tile or p.out_of_reach(q))]


def candidates(tiled: DataFrame) -> DataFrame:
    """u, v, d: each set's nearest candidate, once for each pair of blocks."""

    def compare(left: pa.Table, right: pa.Table, own: bool) -> pa.Table:
        found = [x for p, q in met(left, right, own)[2] for x in nearest(p, q)]
        u, v, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16))
        order = np.lexsort((v, d, u))
        order = order[np.r_[True, u[order][1:] != u[order][:-1]][: len(order)]]
        return pa.table({"u": u[order], "v": v[order], "d": d[order].astype(np.int32)})

    return block_pairs(tiled, 1, compare, "u long, v long, d int")


class Joined:
    """Components of some roots, as pairs are joined."""

    def __init__(self, roots: np.ndarray):
        self.roots = np.unique(roots)
        self.label = np.arange(len(self.roots))

    def of(self, roots: np.ndarray) -> np.ndarray:
        return self.label[np.searchsorted(self.roots, roots)]

    def join(self, i: int, j: int) -> None:
        low, high = sorted((int(self.label[i]), int(self.label[j])))
        self.label[self.label == high] = low


def linking(tiled: DataFrame) -> DataFrame:
    """u, v: roots of sets that are alike and weren't joined; of each pair of blocks no more
    than join its components."""

    def compare(left: pa.Table, right: pa.Table, own: bool) -> pa.Table:
        a, b, pairs = met(left, right, own)
        joined = Joined(np.concatenate([t.root for t in (a if own else a + b)]))
        us, vs = [], []
        for p, q in pairs:
            p.now, q.now = (np.searchsorted(joined.roots, t.root) for t in (p, q))
            for k, d in distances(p, q):
                i, j = np.nonzero(d < FAR)
                order = np.argsort(d[i, j], kind="stable")
                i, j = k + i[order], j[order]
                for at in range(0, len(i), CHUNK):
                    x, y = i[at : at + CHUNK], j[at : at + CHUNK]
                    open_pairs = joined.label[p.now[x]] != joined.label[q.now[y]]
                    for s, t in zip(x[open_pairs].tolist(), y[open_pairs].tolist(), strict=True):
                        m, n = int(p.now[s]), int(q.now[t])
                        if joined.label[m] != joined.label[n] and alike(p.vals[s], q.vals[t]):
                            joined.join(m, n)
                            us.append(int(p.root[s]))
                            vs.append(int(q.root[t]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return block_pairs(tiled, 1, compare, "u long, v long", SIDE)


def salt(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def every_salt():
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """u, v of the pairs whose sets are alike; ``held`` has their values. Pairs of one v
    are dealt out to ``SALTS`` tasks."""
    of_u = pairs.join(held.select(F.col("set").alias("u"), F.col("vals").alias("x")).hint("merge"), "u").withColumn("salt", salt("u"))
    of_v = held.join(pairs.select(F.col("v").alias("set")).distinct().hint("merge"), "set", "left_semi").select(F.col("set").alias("v"), F.col("vals").alias("y"), every_salt())

    def run(batches):
        for b in batches:
            hit = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], ["u", "v"])

    return of_u.join(of_v.hint("merge"), ["v", "salt"]).select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def roots(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, root of all sets with a smaller one in their component. ``firsts`` (set, n,
    sign and the set's first row) is a written table."""
    spark = docs.sparkSession
    every = firsts.where(F.col("n") >= LEAST).select("set", "n", "sign").withColumn("root", F.col("set"))
    tiled, tiles_path = materialise(tiles(every), "tiles")
    hits, hits_path = materialise(candidates(tiled).groupBy("u").agg(F.min(F.struct("d", "v")).alias("b")).select("u", F.col("b.v").alias("v")), "hits")
    remove(spark, tiles_path)
    pairs, pairs_path = materialise(hits.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    held, held_path = materialise(contents(docs, firsts.join(hits.select(F.col("u").alias("set")).hint("merge"), "set", "left_semi"), id_col, text_col), "sets")
    near, _ = materialise(verified(pairs, held), "near")
    found = connected(near)
    own = held.join(every.select("set", "n", "sign").hint("merge"), "set").join(found.select(F.col("node").alias("set"), "root").hint("merge"), "set", "left")
    again, again_path = materialise(tiles(own.withColumn("root", F.coalesce("root", "set"))), "tiles")
    more, _ = materialise(linking(again), "near")
    for path in (hits_path, pairs_path, held_path, again_path):
        remove(spark, path)
    return connected(near.unionByName(more))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set, root, and the set's first row (_null, _key, _tag)."""
    rows, path = materialise(hashed(docs, id_col, text_col), "hashed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_key"), F.col("tag").alias("_tag"))).alias("f")
    firsts, _ = materialise(rows.groupBy("set").agg(least, F.first("n").alias("n"), F.first("sign").alias("sign")).select("set", "n", "sign", "f.*"), "firsts")
    remove(docs.sparkSession, path)
    found = roots(docs, firsts, id_col, text_col)
    return firsts.join(found.hint("merge"), firsts["set"] == found["node"], "left").select("set", F.coalesce("root", "set").alias("root"), "_null", "_key", "_tag")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies, all columns: that with the
    smallest id."""
    kept = grouped(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct("_null", "_key", "_tag")).alias("f")).select("f.*")
    return named_rows(docs, kept, id_col, text_col)
