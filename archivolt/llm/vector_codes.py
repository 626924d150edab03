"""Vector codes: parts of vectors as indexes into codebooks of integers.

A component becomes the integer floor(``scale`` x). Vectors are cut into ``parts`` equal
parts; each part position has a codebook, that starts as the parts of the smallest ids'
vectors. A round sends the codebooks (a model of fixed size: parts x entries vectors'
parts) to all tasks. A task works through its Arrow batches: all distances to a codebook
are |x|^2 - 2 x c + |c|^2 by one exact int64 matrix product, the first least one counts,
and sums and counts of each entry are added up; these, one row per entry that the task
has used, are merged by a grouped shuffle. The entry becomes the floored mean; an unused
one stays. No vector is shuffled, no group holds vectors, and all sums are exact, so the
result depends neither on the split of the table nor on tasks that run again.

Left out are vectors that are null, empty, hold a null or non-finite component, or have
another length than the vector of the smallest id. A length that ``parts`` doesn't
divide is a ValueError. Repeated rows count as often as they occur; the start takes rows
by id, of equal ids by vector, and null ids last. With fewer vectors than entries the
codebooks are smaller. Integers are held to +-2^27 (components of 131,072), so that no
square overflows. An empty table gives an empty result and codebooks without entries.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, materialise

MOST = 1 << 27
#: Vectors whose distances to a codebook are held at a time.
ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part, entry, position."""

    entries: np.ndarray
    scale: int = 1024

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of integers the first nearest entry of each part, and the squared
        distance to it."""
        parts, _, width = self.entries.shape
        found, far = np.empty((parts, len(x)), np.int64), np.empty((parts, len(x)), np.int64)
        for p, book in enumerate(self.entries):
            turned, norms = np.ascontiguousarray(book.T), (book * book).sum(1)
            for k in range(0, len(x), ROWS):
                y = np.ascontiguousarray(x[k : k + ROWS, p * width : (p + 1) * width])
                d = y @ turned
                d *= -2
                d += norms
                at = d.argmin(1)
                found[p, k : k + ROWS] = at
                far[p, k : k + ROWS] = d[np.arange(len(y)), at] + (y * y).sum(1)
        return found, far


def sound(vector: Column) -> Column:
    """Whether a vector has components, and all are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """The batch's vectors as floor(scale x), a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64)


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v of the rows whose vector is sound."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).alias("_id"), v.alias("_v")).where(sound(F.col("_v")))


def fitted(df: DataFrame, id_col: str, vector_col: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all sound vectors."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = prepared(df, id_col, vector_col)
    smallest = rows.orderBy(F.asc_nulls_last("_id"), "_v")
    head = smallest.limit(1).collect()
    if not head:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    width = len(head[0]["_v"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("_v") == width)
    first = smallest.where(F.size("_v") == width).limit(entries).collect()  # ``entries`` rows
    start = integers(pa.array([r["_v"] for r in first], pa.list_(pa.float64())), width, scale)
    books = np.stack(np.split(start, parts, axis=1))
    step = width // parts
    places = [f"s{k}" for k in range(step)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)

        def summed(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            now = Codebooks(held.value, scale)
            n = len(held.value[0])
            sums, counts = np.zeros((parts, n, step), np.int64), np.zeros((parts, n), np.int64)
            for b in batches:
                x = integers(b.column(0), width, scale)
                for p, at in enumerate(now.nearest(x)[0]):
                    order = np.argsort(at, kind="stable")
                    used, begins = np.unique(at[order], return_index=True)
                    if len(used):
                        sums[p, used] += np.add.reduceat(x[order, p * step : (p + 1) * step], begins)
                        counts[p] += np.bincount(at, minlength=n)
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), *(pa.array(sums[p, e, k], pa.int64()) for k in range(step))], ["part", "entry", "n", *places])

        schema = ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in places)])
        merged = rows.select("_v").mapInArrow(summed, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in places))
        books = books.copy()
        for r in merged.collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [r[c] // r["n"] for c in places]
        held.destroy()
    return Codebooks(books, scale)


def coded(df: DataFrame, books: Codebooks, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """``id_col``, the ``keep`` columns, code (two hex digits a part; more where a codebook
    has over 256 entries) and error, the squared distance, of each sound vector."""
    bound_batches(df.sparkSession)
    parts, n, step = books.entries.shape
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep_{c}") for c in keep), v.alias("_v")).where(sound(F.col("_v")) & (F.size("_v") == parts * step))
    digits = max(2, len(f"{max(0, n - 1):x}"))
    names = [id_col, *keep, "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = np.array([f"{k:0{digits}x}" for k in range(n)], dtype=f"U{digits}")
        for b in batches:
            at, far = books.nearest(integers(b.column(b.num_columns - 1), parts * step, books.scale))
            code = hexed[at[0]]
            for more in at[1:]:
                code = np.char.add(code, hexed[more])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(code.tolist(), pa.string()), pa.array(far.sum(0), pa.int64())], names)

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *keep)), "code string", "error long"])
    return rows.mapInArrow(run, schema)


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels added up, nulls
    together) and codebooks_sha256 of each sound vector."""
    books = fitted(df, id_col, vector_col, parts, entries, rounds)
    each, _ = materialise(coded(df, books, id_col, vector_col, label_col), "codes")
    total = each.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    return each.join(total, F.col(label_col).eqNullSafe(F.col("_label"))).select(F.col(id_col).alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
