"""WARC archives with an index: write first, then read selected records by byte range.

Writing: each task writes gzip-per-record files into the shared folder and returns one
index row per record (file, offset, length, url, digest).  File names are new for every
attempt and only rows of attempts that Spark commits reach the index, so a lost or
repeated task leaves at most a file that nothing refers to.

Reading: the index is the table to select from.  The chosen records are dealt out by
(file, stretch of the file), sorted by offset, and neighbouring byte ranges are read
in one request.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, text_or_empty

#: Payloads shorter than this are never written as revisits.
REVISIT_MIN_BYTES = 1000
FILE_BYTES = 64 << 20
#: Stretch of a file that one reading task takes, the largest request, and the gap that is read over.
STRETCH_BYTES, REQUEST_BYTES, GAP_BYTES = 32 << 20, 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"

INDEX = ("file string, offset long, length long, page_id long, url string, digest string, "
         "record_type string, refers_to long")
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def _filesystem(folder: str):
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    if folder.startswith("file:"):
        folder = folder[5:]
    return pafs.LocalFileSystem(), folder


def _field(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record(page_id, url, digest: str, kind: str, target, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>",
            "Content-Type: application/http; msgtype=response",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {target}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at the indexed place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def _writer(folder: str):
    def write(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = (r["html"] or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = _record(r["page_id"], r["url"], digest, r["record_type"], r["refers_to"], payload)
                member = z.compress(raw) + z.flush()
                out.write(member)
                rows.append({"file": name, "offset": at, "length": len(member), "page_id": r["page_id"], "url": r["url"],
                             "digest": digest, "record_type": r["record_type"], "refers_to": r["refers_to"]})
                at += len(member)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if out is not None:
            out.close()
    return write


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

    def requests(batches):
        """Neighbouring records of one file as one range: (file, start, end, [(offset, length)])."""
        now = None
        for batch in batches:
            for name, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist()):
                if now and now[0] == name and offset - now[2] <= GAP_BYTES and offset + length - now[1] <= REQUEST_BYTES:
                    now[2] = max(now[2], offset + length)
                    now[3].append((offset, length))
                else:
                    if now:
                        yield now
                    now = [name, offset, offset + length, [(offset, length)]]
        if now:
            yield now

    def number(text):
        return int(text) if text is not None else None

    def read(batches):
        fs, base = _filesystem(folder)
        name, source = None, None
        for file, start, end, parts in requests(batches):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, fs.open_input_file(f"{base}/{file}")
            data = source.read_at(end - start, start)
            rows, held = [], 0
            for offset, length in parts:
                f = _parse(zlib.decompress(data[offset - start:offset - start + length], 31))
                digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = f["WARC-Type"]
                url = f.get("WARC-Target-URI")
                rows.append({"page_id": number(f.get("X-Page-ID")), "url": _unfield(url) if url is not None else None, "record_type": kind,
                             "refers_to": number(f.get("X-Refers-To-Page-ID")), "digest": digest,
                             "payload": f["payload"] if kind == "response" else None})
                held += len(f["payload"])
                if held > REQUEST_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if source is not None:
            source.close()
    return read


def plan_records(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Add record_type and refers_to to (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(text_or_empty("html"), "UTF-8").alias("body"), F.col("html").cast("string").alias("html"))
    p = p.select("page_id", "url", "html", F.sha1("body").alias("sha"), F.octet_length("body").alias("n"))
    groups = (p.where(F.col("n") >= min_bytes).groupBy("sha", "n")
               .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
               .where("copies > 1 and last is not null").select("sha", "n", "last"))
    p = p.join(groups, ["sha", "n"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return p.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("last")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Write one WARC record per row of (page_id, url, html); return the index table.

    Of equal payloads of at least ``min_bytes`` the one with the largest page_id is the
    response; the others, also rows without page_id, are revisits of it.  Repeated rows with
    the largest page_id are each a response; if no row of a group has a page_id all are.
    Null html: empty payload; null url: no target field.  An empty table gives an empty index.
    """
    rows = plan_records(pages, min_bytes).mapInArrow(_writer(folder), INDEX)
    return scratch.write(rows, "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The selected records (any subset of the index rows): see RECORD; revisits have no payload."""
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = (index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch"))
                  .repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset"))
    return dealt.select("file", "offset", "length").mapInArrow(_reader(folder), RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archive")
    index = write_archive(pages, folder, scratch)
    records = read_records(index, folder)
    records = scratch.write(records.select("page_id", "url", "record_type", "refers_to", "digest",
                                           F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("read_digest")), "records")
    # a revisit's payload is the one of the response that it names; digest and size come from there
    full = (records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("read_digest").alias("digest"))
                   .agg(F.max("payload_bytes").alias("full_bytes")))
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to", "digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    first = records.where("record_type = 'response'").withColumn("payload_digest", F.col("read_digest"))
    again = revisits.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.when(F.col("full_bytes").isNotNull(), F.col("digest"))})
    return first.select(*cols).union(again.select(*cols))


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to, url
FROM g
"""
