"""Raw archive with high-water marks (S7, I8, I11 over many runs).

``root/data/batch=<n>/try=<id>/source_id=<s>`` holds the new rows of a batch, ``root/manifest/<version>.json`` names the
folders of all batches, the marks of each source and how far each reader has come.  A batch's folder is written
first; folder and marks then appear together by one rename, so a crash in between leaves neither, and the
batch can be replayed.  A reader asks for what lies above its own marks: only those folders are listed, and inside them
the marks are partition filters.  One root has one writer; manifests hold a few numbers per source and batch, never rows.
"""
from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidewater.operators.ingest import archive_raw, valid_date
from tidewater.sources.local import literal_frame
from tidewater.streaming.bucket_state import Files

KEYS = ["source_id", "source_doc_id", "content_hash"]
EMPTY = {"folders": {}, "sources": {}, "readers": {}}


class RawArchive:
    """``schema``: the archived columns; KEYS and ``published_at`` (text) are among them."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        own = [f for f in schema.fields if f.name != "source_id"]
        self.columns = schema.names
        self.schema = StructType([*own, StructField("batch", IntegerType()), StructField("try", StringType()), StructField("source_id", StringType())])

    # ---- manifest ----
    def _versions(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        held = self._versions()
        return json.loads(self.files.read(f"{self.root}/manifest/{held[-1]}")) if held else json.loads(json.dumps(EMPTY))

    def _publish(self, manifest: dict) -> None:
        held = self._versions()
        n = int(held[-1][:-5]) + 1 if held else 0
        self.files.publish(f"{self.root}/manifest/{n:012d}.json", json.dumps(manifest))

    # ---- rows ----
    def _scan(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{f}" for f in folders.values()])

    def read(self) -> DataFrame:
        """All archived rows, with their batch."""
        return self._scan(self.manifest()["folders"]).drop("try")

    def append(self, batch: int, rows: DataFrame) -> None:
        """Archive the rows that are new by KEYS and advance the marks of their sources; a batch that is in
        already is left as it is.  Rows without a document id are not kept; a date that is none moves no mark."""
        m = self.manifest()
        if str(batch) in m["folders"]:
            return
        folder = f"data/batch={batch}/try=t{uuid.uuid4().hex}"
        new = archive_raw(self.read(), rows.select(*self.columns).where("source_id is not null"))
        new.write.partitionBy("source_id").parquet(f"{self.root}/{folder}")
        written = self._scan({str(batch): folder})
        # one row per source
        for r in written.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max(valid_date("published_at")).cast("date").alias("high")).collect():
            s = m["sources"].setdefault(r.source_id, {"rows": 0, "high": None, "batch": batch})
            s["rows"] += r.n
            s["batch"] = batch
            s["high"] = max(filter(None, [s["high"], r.high.isoformat() if r.high else None]), default=None)
        m["folders"][str(batch)] = folder
        self._publish(m)

    # ---- I8 ----
    def since(self, as_of: dt.date, lookback_days: int = 7, default_days: int = 30) -> DataFrame:
        """I8 per source: the next run starts ``lookback_days`` before the highest publication date, or ``default_days`` before ``as_of``."""
        rows = []
        for source, s in sorted(self.manifest()["sources"].items()):
            high = dt.date.fromisoformat(s["high"]) if s["high"] else None
            rows.append((source, s["rows"], high, high - dt.timedelta(lookback_days) if high else as_of - dt.timedelta(default_days)))
        return literal_frame(self.spark, rows, [("source_id", "string"), ("n_rows", "bigint"), ("max_published", "date"), ("since", "date")])

    # ---- readers ----
    def pending(self, reader: str) -> tuple[DataFrame, dict[str, int]]:
        """Rows above the reader's marks and the marks that ``acknowledge`` sets once their work is written."""
        m = self.manifest()
        marks = m["readers"].get(reader, {})
        ahead = {s: v["batch"] for s, v in m["sources"].items() if v["batch"] > marks.get(s, -1)}
        low = min((marks.get(s, -1) for s in ahead), default=-1)
        rows = self._scan({b: f for b, f in m["folders"].items() if ahead and int(b) > low})
        keep = F.lit(False)
        for s in ahead:
            keep = keep | ((F.col("source_id") == s) & (F.col("batch") > marks.get(s, -1)))
        return rows.where(keep).drop("try"), ahead

    def acknowledge(self, reader: str, marks: dict[str, int]) -> None:
        m = self.manifest()
        m["readers"][reader] = {**m["readers"].get(reader, {}), **marks}
        self._publish(m)


def backfill_newer(state: DataFrame, rows: DataFrame, keys: list[str], col: str, ts: str, seq: str) -> DataFrame:
    """I11 by batches: ``col`` takes the newest non-empty value of ``rows`` where it is newer than the one it came from.

    ``state`` has ``<col>_ts`` and ``<col>_seq``, the place of its value (NULL: older than all).  Any order of batches, and
    batches read twice, end in the values of one pass over the whole archive.  ``backfilled`` marks changed values.
    """
    at, no = f"{col}_ts", f"{col}_seq"
    full = rows.where(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))
    last = full.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), F.col(col).alias("v"))).alias("_l"))
    j = state.join(last, keys, "left")
    newer = F.col("_l").isNotNull() & (F.col(at).isNull() | (F.struct(F.col("_l.t").alias("t"), F.col("_l.s").alias("s")) > F.struct(F.col(at).alias("t"), F.col(no).alias("s"))))
    pick = lambda new, old: F.when(newer, F.col(f"_l.{new}")).otherwise(F.col(old))
    return j.withColumns({"backfilled": newer & ~F.col(col).eqNullSafe(F.col("_l.v")), at: pick("t", at), no: pick("s", no), col: pick("v", col)}).drop("_l")
