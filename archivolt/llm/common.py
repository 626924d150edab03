"""What the operators of this folder share: the shared folder, tables written
into it, batches of bounded size and the range split of a table by its ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], and A-Z to a-z.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Rows, and bytes, an Arrow batch may hold: a batch of long texts must fit a worker's
#: memory. One row is a batch at least, however long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> None:
    """Lower the session's bounds of an Arrow batch to ``rows`` and ``most`` bytes; never
    raises them. They stay lowered, as queries that were built run later."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most)):
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if now <= 0 or now > bound:
            spark.conf.set(key, bound)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or the context's own
    checkpoint folder. Without either only local mode, as in tests, gets a temporary
    one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("no folder that all machines share: set spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="archivolt-"))
    return qualified(spark, named or sc.getCheckpointDir()).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, as Spark resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/archivolt/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the
    lineage and outlives the executors. Also returns the path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no DataFrame reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items whose lengths add to ``most`` at most; a longer
    item is a run of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


class IdRanges:
    """Split of a table into consecutive ranges of its ids.

    The bounds are ids of the table, found from the id column alone, so that the
    costly columns are computed once and go straight to their range. Nulls are
    in range 0, before all ids. ``first`` is the smallest id, null if any is.
    """

    def __init__(self, df: DataFrame, id_col: str, parts: int):
        share = [i / parts for i in range(1, parts)]
        ids = F.col(id_col)
        wanted = [F.min(ids).alias("least"), F.count_if(ids.isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")]
        if share:
            wanted.append(F.percentile_approx(ids, share, max(10_000, 20 * parts)).alias("at"))
        row = df.select(id_col).agg(*wanted).first()
        self.rows, self.first = row["rows"], None if row["nulls"] else row["least"]
        least = row["least"]
        cuts = set(row["at"] or []) if share else set()
        # with nulls present the smallest id may open a range of its own
        self.bounds = np.array(sorted(c for c in cuts if row["nulls"] or c > least), dtype=np.int64)
        self.parts = len(self.bounds) + 1

    def of(self, ids: pa.Array) -> np.ndarray:
        known = ids.cast(pa.int64())
        got = np.searchsorted(self.bounds, known.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(known.is_null().to_numpy(zero_copy_only=False), 0, got)
