"""Tables written to the folder that ``spark.checkpoint.dir`` names.

A written table cuts lineage (a lost executor recomputes nothing before it), and, other
than a checkpoint, it has a size that the optimizer knows, so small ones are
broadcast without a hint.
"""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; all executors see it.

    Only a local session without that setting gets a folder of its own (tests);
    on a cluster a missing setting is an error, because executors would write to
    disks that the others cannot read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: executors of this session are processes of their own")
    path = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Written tables of one run of an operator; ``drop`` removes those that no later read needs."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tidewater/{operator}-{uuid.uuid4().hex}"
        self.n = 0

    def folder(self, tag: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{tag}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.folder(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        """Remove all tables of the run; call it when its result has been written."""
        self._delete(self.base)

    def release_shuffles(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs: it acts
        when the driver collects the garbage that referred to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
