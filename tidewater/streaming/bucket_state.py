"""Keyed state of a stream in hash buckets with a manifest.

``root/data/<version>/_b=<bucket>`` holds the rows of a bucket, ``root/manifest/<batch>.json`` names the folder of each
bucket after a batch (and the batch's own notes, such as its event-time high mark).  A micro-batch reads and rewrites
the buckets of its keys only.  Its folders are written first and the manifest appears by one rename, so a crash
in between leaves the state as it was, and the replayed batch writes folders of its own.  Folders that
none of the last ``keep`` manifests names are removed after the swap.

All files go through the Hadoop file system of ``root``; one root belongs to one stream checkpoint.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, KEEP = 64, 3


class Files:
    """The few file operations that commits need, in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write beside ``path`` and rename: readers see nothing or the whole file."""
        held = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(held), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(self.path(held), self.path(path)):
            self.fs.delete(self.path(held), False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class BucketState:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.root, self.keys, self.schema, self.buckets, self.keep = spark, root, keys, schema, buckets, keep
        self.files = Files(spark, root)

    def _batches(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def _manifest(self, batch: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/manifest/{batch:012d}.json"))

    def done(self, batch: int) -> bool:
        return self.files.exists(f"{self.root}/manifest/{batch:012d}.json")

    def latest(self) -> dict:
        batches = self._batches()
        return self._manifest(batches[-1]) if batches else {"buckets": {}, "notes": {}}

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        folders = self.latest()["buckets"]
        paths = [f"{self.root}/{folder}" for b, folder in folders.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def commit(self, batch: int, rows: DataFrame, touched: list[int], notes: dict | None = None) -> None:
        """Replace the touched buckets by ``rows``; ``notes`` are kept in the manifest."""
        before = self.latest()
        folder = f"data/{batch:012d}-{uuid.uuid4().hex}"
        out = rows.select(*self.schema.names, self.bucket().alias("_b"))
        if touched:
            out.repartition("_b").write.partitionBy("_b").parquet(f"{self.root}/{folder}")
        written = {int(n[3:]) for n in self.files.names(f"{self.root}/{folder}") if n.startswith("_b=")}
        buckets = {b: f for b, f in before["buckets"].items() if int(b) not in touched}
        buckets |= {str(b): f"{folder}/_b={b}" for b in sorted(written)}
        self._swap(batch, {"buckets": buckets, "notes": {**before["notes"], **(notes or {})}})
        self._expire()

    def _swap(self, batch: int, manifest: dict) -> None:
        self.files.publish(f"{self.root}/manifest/{batch:012d}.json", json.dumps(manifest))

    def _expire(self) -> None:
        """Remove bucket folders of versions that no kept manifest names; a crashed batch's folders go, too."""
        kept = self._batches()[-self.keep:]
        named = {f for b in kept for f in self._manifest(b)["buckets"].values()}
        for version in self.files.names(f"{self.root}/data"):
            if version[:12].isdigit() and int(version[:12]) > kept[-1]:
                continue  # of a batch that is being written
            folders = [f"data/{version}/{n}" for n in self.files.names(f"{self.root}/data/{version}") if n.startswith("_b=")]
            if not any(f in named for f in folders):
                self.files.delete(f"{self.root}/data/{version}")
            else:
                for f in folders:
                    if f not in named:
                        self.files.delete(f"{self.root}/{f}")
