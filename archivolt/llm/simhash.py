"""SimHash near-duplicates by tiled exact comparison.

``fingerprints`` gives each text 64 bits: over all its word shingles, a bit is 1
if more than half of the shingles' XXH64 values have it. ``components`` links
fingerprints that differ in ``radius`` bits at most and gives each the smallest
document id it reaches.

The distinct fingerprints, sorted by population count (of the whole, then of the
bytes), are cut into tiles of one population count each. Two values within the
radius differ by no more than the radius in population count, of the whole and
summed over the bytes; tile pairs beyond that are skipped, the others compared
in full with exclusive-or and bit counts. Tiles meet in pairs of blocks
(``block_pairs``), by counts, before any value moves. A block pair returns a star for
each of its groups, never the pairs themselves, so a large group of near copies costs
its size and not its square. Nothing is sampled or capped. The comparisons grow with
the square of the number of different fingerprints, less what the counts exclude.

Null or empty text (and text without words): no shingle, fingerprint zero, linked
like any other. Repeated rows share a fingerprint and a component. A null id stays
null and never is a component's id unless it is the only one. Empty input gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from archivolt.llm.common import LOWER, bound_batches, materialise, remove, shuffle_parts, texts_of

TILE = 2048
#: Tiles of a block at most.
BLOCK_TILES = 256
#: Tasks that a star's edges are dealt out to.
SALTS = 16
#: Cells of one block of a comparison: 8 bytes each, to stay in the cache.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> np.ndarray:
    words = text.translate(LOWER).split()  # bytes.split() parts at [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([hashed(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 17):
        bits = np.unpackbits(hashes[k : k + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        # blocks of 255 rows can be added up in bytes
        total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def tiles(distinct: DataFrame, size: int = TILE) -> DataFrame:
    """tile (its smallest value), level (its population count), low and high (of the
    bytes' population counts), vals (uint64, little-endian). Every value is in one tile."""
    pops = [F.bit_count(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))).alias(f"b{i}") for i in range(8)]
    keyed = distinct.select("fp", F.bit_count("fp").alias("pop"), *pops)
    order = ["pop", *(f"b{i}" for i in range(8)), "fp"]
    dealt = keyed.repartitionByRange(shuffle_parts(distinct.sparkSession), *order).sortWithinPartitions(*order).select("fp", "pop")

    def run(batches):
        held = np.empty(0, np.uint64)
        pop = -1

        def row(vals):
            counts = np.bitwise_count(vals.view(np.uint8).reshape(-1, 8))
            return {"tile": int(vals.view(np.int64).min()), "level": pop, "low": counts.min(axis=0).tobytes(), "high": counts.max(axis=0).tobytes(), "vals": vals.tobytes()}

        schema = pa.schema([("tile", pa.int64()), ("level", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("vals", pa.binary())])
        for b in batches:
            vals, of = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            rows = []
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                if of[part[0]] != pop and len(held):
                    rows.append(row(held))
                    held = held[:0]
                pop = int(of[part[0]])
                held = np.concatenate([held, vals[part]])
                while len(held) >= size:
                    rows.append(row(held[:size]))
                    held = held[size:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if len(held):
            yield pa.RecordBatch.from_pylist([row(held)], schema)

    return dealt.mapInArrow(run, "tile long, level int, low binary, high binary, vals binary")


def block_pairs(tiled: DataFrame, reach: int, compare: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, most: int = BLOCK_TILES) -> DataFrame:
    """What ``compare`` finds in all pairs of tiles whose levels differ by ``reach`` at
    most.

    The tiles of a level are dealt to blocks of some tiles each, and every pair of blocks
    within reach is a group of its own, so a tile's values move once for each block that
    it must meet, not once for each tile, and a group holds two blocks. ``compare`` gets
    the tiles of both (level, tile, ...), and whether they are one and the same block;
    then each pair of its tiles, and each tile with itself, is its to find once."""
    spark = tiled.sparkSession
    parts = shuffle_parts(spark)
    count = {r["level"]: r["count"] for r in tiled.groupBy("level").count().collect()}  # a row a level, of which there are some hundreds at most
    # larger blocks move less, smaller ones make more tasks; ``most`` tiles bound a block's memory
    side = min(most, max(4, -(-sum(count.values()) // (2 * max(1, int(parts**0.5))))))
    blocks = {k: -(-n // side) for k, n in count.items()}
    first = dict(zip(sorted(blocks), np.cumsum([0, *(blocks[k] for k in sorted(blocks))]).tolist()))
    near_levels = {k: [x for x in sorted(blocks) if abs(x - k) <= reach] for k in blocks}
    # by level: the first and the last block number within reach
    bounds = spark.createDataFrame([(k, first[k], blocks[k], first[v[0]], first[v[-1]] + blocks[v[-1]] - 1) for k, v in near_levels.items()] or [(0, 0, 1, 0, 0)], "level int, base long, own long, a long, z long")
    placed = tiled.join(F.broadcast(bounds), "level").withColumn("block", F.col("base") + F.pmod(F.xxhash64("tile"), F.col("own")))
    met = placed.withColumn("other", F.explode(F.sequence("a", "z")))
    pairs = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), *tiled.columns)
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(group: pa.Table) -> pa.Table:
        own = group["i"][0] == group["j"][0]
        second = group["second"]
        group = group.drop_columns(["i", "j", "second"])
        left = group.filter(pc.invert(second))
        right = left if own else group.filter(second)
        return compare(left, right, own) if left.num_rows and right.num_rows else none

    return pairs.repartition(max(parts, 2 * sum(blocks.values())), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where x[i] and y[j] differ in ``radius`` bits at most."""
    rows = max(1, BLOCK // max(1, len(y)))
    diff, bits = np.empty((rows, len(y)), np.uint64), np.empty((rows, len(y)), np.uint8)
    left, right = [], []
    for k in range(0, len(x), rows):
        n = min(rows, len(x) - k)
        np.bitwise_xor(x[k : k + n, None], y[None, :], out=diff[:n])
        np.bitwise_count(diff[:n], out=bits[:n])
        hit = bits[:n] <= radius
        if hit.any():
            i, j = np.nonzero(hit)
            left.append(i + k)
            right.append(j)
    empty = np.empty(0, np.int64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between values: for each value with a smaller one in its group, the
    value and the group's smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(tiled: DataFrame, radius: int = 4) -> DataFrame:
    """Stars (u, v) that connect what is within the radius, over all tile pairs."""

    def compare(left: pa.Table, right: pa.Table, own: bool) -> pa.Table:
        a = left.to_pylist()
        b = a if own else right.to_pylist()
        for x in (a,) if own else (a, b):
            for t in x:
                t["low"], t["high"] = (np.frombuffer(t[k], np.uint8).astype(np.int16) for k in ("low", "high"))
                t["vals"] = np.frombuffer(t["vals"], np.uint64)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in a:
            for y in b:
                if own and x["tile"] > y["tile"] or abs(x["level"] - y["level"]) > radius:
                    continue
                if np.maximum(0, np.maximum(x["low"] - y["high"], y["low"] - x["high"])).sum() > radius:
                    continue
                i, j = near(x["vals"], y["vals"], radius)
                u, v = x["vals"][i].view(np.int64), y["vals"][j].view(np.int64)
                different = u != v
                if different.any():
                    u, v = stars(u[different], v[different])
                    us.append(u)
                    vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(us) > 2:  # the stars of all tile pairs of the group as one set of stars
            u, v = stars(u, v)
        return pa.table({"u": u, "v": v})

    return block_pairs(tiled, radius, compare, "u long, v long")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest value of its component) of all nodes with a smaller
    one, by alternating large and small stars until nothing changes: some rounds, as
    their number grows with the logarithm of the size. Each round is a table in the
    shared folder. The edges of a star's centre are dealt out to ``SALTS`` tasks."""
    spark = edges.sparkSession
    now, path = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), every.alias("salt"))
        large = both.withColumn("salt", salt).join(least.hint("merge"), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", every.alias("salt"))
        small = large.withColumn("salt", salt).join(low.hint("merge"), ["u", "salt"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new, new_path = materialise(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        remove(spark, path)
        now, path = new, new_path
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def rooted(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fp, first_doc (its smallest document id) and root (the component's smallest
    fingerprint) of the distinct fingerprints of ``fps``."""
    distinct, _ = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    tiled, tile_path = materialise(tiles(distinct), "tiles")
    roots = connected(links(tiled, radius))
    remove(fps.sparkSession, tile_path)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of all rows of ``fps`` (doc_id, fp), which is read
    more than once and so should be a written table."""
    found = rooted(fps, radius)
    named = found.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_fp = found.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``."""
    return components(materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")[0], radius)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and tag: a row is its id and its text, null and empty alike."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"))


def first_of(rows: DataFrame, group: str) -> DataFrame:
    """The first row (doc_id, tag) of each group, by id, nulls last, and tag: the group,
    _null, _key and _tag."""
    row = F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_key"), F.col("tag").alias("_tag"))
    return rows.groupBy(group).agg(F.min(row).alias("f")).select(group, "f.*")


def named_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``named`` (_null, _key, _tag) has, all columns, repeated
    ones once."""
    # null ids as a key of their own, so that the join and the removal of repeated rows share a shuffle
    key = ["_key", "_null", "_tag"]
    ids = F.col(id_col).cast("long")
    whole = docs.select(F.coalesce(ids, F.lit(0).cast("long")).alias("_key"), ids.isNull().alias("_null"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_tag"), F.struct(*docs.columns).alias("_row"))
    # the same plan at every size: a sort-merge join, never a broadcast of ids
    left = whole.join(named.select(*key).hint("merge"), key, "left_semi")
    return left.dropDuplicates(key).select("_row.*")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, all columns: that with the smallest id."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "tag", "fp"])

    rows, _ = materialise(identified(docs, id_col, text_col).mapInArrow(run, "doc_id long, tag long, fp long"), "fingerprints")
    return named_rows(docs, first_of(rows.join(rooted(rows, radius).select("fp", "root"), "fp"), "root"), id_col, text_col)
