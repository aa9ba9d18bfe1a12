"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder. A temporary folder serves where
    neither is set and the session runs on one machine; on a cluster that raises, as executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foldloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str = "foldloom") -> str:
    """A fresh folder under the shared base, removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes and rows. The setting is the session's and acts when a plan runs; every operator
    asks for the same values, so it doesn't matter which was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


#: Bytes of input that make a bucket, and how many there are at least (no more than Spark's shuffle partitions).
BUCKET_BYTES, LEAST_BUCKETS = 1_000_000, 24
#: For a write into buckets: a task reads whole buckets, and so has a file or a few open and sorts nothing; joins on the
#: key and more columns take the buckets as they are.
WHOLE = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def buckets(df: DataFrame) -> int:
    """Buckets for what is made of ``df``, by the bytes of its inputs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    least = min(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, sum(s for s in sizes if s < 2**50) // BUCKET_BYTES)


@dataclass(frozen=True)
class Dealt:
    """Stores tables in so many buckets by one key. What reads them, to be stored by it too, moves no rows for a window,
    group or join on the key (and more columns)."""

    spark: SparkSession
    key: str
    parts: int

    def __call__(self, df: DataFrame) -> DataFrame:
        conf, name = self.spark.conf, f"foldloom_{uuid.uuid4().hex}"
        before = {k: conf.get(k) for k in WHOLE}
        for k, v in WHOLE.items():
            conf.set(k, v)
        try:
            df.write.bucketBy(self.parts, self.key).option("path", shared_dir(self.spark)).mode("overwrite").saveAsTable(name)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay, and out reads them
        return out

    def moved(self, df: DataFrame) -> DataFrame:
        """Rows of any order, so that a task has whole buckets."""
        return df.repartition(self.parts, self.key)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: lineage ends there, so a lost executor costs at most its running tasks, and what reads it
    prunes columns."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
