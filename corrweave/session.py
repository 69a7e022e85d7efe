"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: `spark.checkpoint.dir`; a local session without it (as in tests) gets a temporary one.

    Executors of a cluster can't see a folder of the driver's machine, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corrweave-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: rows, order and partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own within the shared one, and read again.

    Unlike a checkpoint, a read table has the size of its files: size estimates of a
    checkpoint are those of its plan, and in a loop of joins they multiply round by round.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.path = f"{shared_dir(spark)}/corrweave/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        """The rows of `df` as a table; at most `parts` tasks write it, if that is given."""
        self.n += 1
        (df.coalesce(parts) if parts else df).write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
