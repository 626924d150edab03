"""Tables written into the folder that all machines share: they cut the lineage, are
computed once and outlive the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own checkpoint folder. Without either
    only local mode, as in tests, gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("no folder that all machines share: set spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="archivolt-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


PARTS = "spark.sql.shuffle.partitions"
#: Parts of the shuffles of a table that may be large; small ones are put together again.
SPREAD = 512


class Stored:
    """Tables of one computation; ``clear`` removes those that nobody needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str, keep: bool = False, spread: bool = False) -> DataFrame:
        """With ``spread`` the shuffles behind it have ``SPREAD`` parts at least, so that no
        task holds much of a large table."""
        path, parts = f"{folder(self.spark)}/archivolt/{label}-{uuid.uuid4().hex}", self.spark.conf.get(PARTS)
        self.spark.conf.set(PARTS, str(max(int(parts), SPREAD)) if spread else parts)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(PARTS, parts)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []
