"""Written search index of a corpus: postings, documents, attributes.

* ``postings`` (piece, program_id): each document's distinct pieces of one to GRAM characters, as numbers.  Rows hold
  ids only.
* ``documents``: lower-cased fields, bucketed by program_id, and the blob where it is not just these fields in a row.
  Candidates are shuffled to the documents' buckets and hashed there; a search neither shuffles nor sorts a text.
* ``attributes``: what filters and order need.

An index is built once per corpus and read by all searches of it.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.functions.constants import FIELD_WEIGHTS_X10
from tidewater.scratch import Scratch

GRAM = 3
#: The rarest pieces of a term that a candidate must hold (or all, if there are fewer).
PIECES = 3
FIELDS = [name for name, _ in FIELD_WEIGHTS_X10]
#: The fields in the order of the blob.
BLOB = ["name", "field", "tags_text", "summary", "agency", "body_text"]
ATTRIBUTES = ["program_id", "name", "region", "is_open", "period_end"]
#: Characters that one numpy step handles (a longer single text is handled alone).
BLOCK_CHARS = 1 << 19


def piece_codes(texts: list[str], shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs: three code points of 21 bits each.

    With ``shorter`` also the pieces of fewer characters that begin anywhere (zeros fill them up);
    without, only pieces of min(GRAM, length) characters.
    """
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # characters from here to the text's end
    # a character's number in the block, so that a row and a piece are one number of 63 bits and sorted as one
    met = np.zeros(0x110000, bool)
    met[0] = True
    met[flat] = True
    alphabet = np.flatnonzero(met)
    base = len(alphabet)
    number = (np.cumsum(met) - 1)[flat]
    if (len(texts) + 1) * base ** GRAM >= 1 << 63:
        half = len(texts) // 2
        if half == 0:
            raise ValueError("a text of too many different characters")
        first, last = piece_codes(texts[:half], shorter), piece_codes(texts[half:], shorter)
        return np.concatenate([first[0], last[0] + half]), np.concatenate([first[1], last[1]])
    key = row
    for k in range(GRAM):  # zeros fill up the pieces at a text's end
        key = key * base + np.where(left > k, np.append(number, np.zeros(k, np.int64))[k:], 0)
    if not shorter:
        key = key[left >= np.minimum(size, GRAM)[row]]
    key = np.sort(key)
    found = [_distinct(key)]
    for k in range(1, GRAM if shorter else 1):  # the beginnings of sorted pieces are sorted
        short = _distinct(found[0] // base ** k)
        found.append(short * base ** k)
    key = np.sort(np.concatenate(found)) if shorter else found[0]
    key = _distinct(key)
    code = np.zeros(len(key), np.int64)
    for k in range(GRAM):
        code |= alphabet[key // base ** k % base] << 21 * k
    return key // base ** GRAM, code


def _distinct(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def pieces(texts: DataFrame, key: str, text: str, shorter: bool) -> DataFrame:
    """(key, piece) of every row with a text."""
    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(rows):
                end, volume = at, 0
                while end < len(rows) and (end == at or volume + len(rows[end]) <= BLOCK_CHARS):
                    volume += len(rows[end])
                    end += 1
                row, code = piece_codes(rows[at:end], shorter)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + at)), pa.array(code)], names=[key, "piece"])
                at = end

    schema = StructType([texts.schema[key], StructField("piece", LongType())])
    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


@dataclass
class SearchIndex:
    postings: DataFrame
    documents: DataFrame
    attributes: DataFrame
    scratch: Scratch


def build_index(notices: DataFrame) -> SearchIndex:
    """Index of notices with distinct ids; rows without an id cannot be found and are left out."""
    spark = notices.sparkSession
    scratch = Scratch(spark, "search-index")
    rows = notices.where("program_id is not null")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = rows.select("program_id", "search_blob", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"l_{c}") for c in FIELDS])
    joined = F.concat_ws(" ", *[f"l_{c}" for c in BLOB])
    low = low.withColumn("plain", F.col("search_blob").eqNullSafe(joined)).withColumn("search_blob", F.when(~F.col("plain"), F.col("search_blob")))
    table = f"tidewater_index_{uuid.uuid4().hex}"
    (low.repartition(buckets, "program_id").write.bucketBy(buckets, "program_id")
        .option("path", scratch.folder("documents")).saveAsTable(table))
    documents = spark.table(table).withColumn("search_blob", F.when(F.col("plain"), joined).otherwise(F.col("search_blob"))).drop("plain")
    attributes = scratch.write(rows.select(*[c for c in ATTRIBUTES if c in rows.columns]), "attributes")
    postings = scratch.write(pieces(documents.select("program_id", "search_blob"), "program_id", "search_blob", True), "postings")
    return SearchIndex(postings, documents, attributes, scratch)


_BUILT: dict[tuple, SearchIndex] = {}


def _state(spark, path: str) -> tuple:
    """(path, length, time) of the files of a table: an index of other files is another index."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(sc._jvm.org.apache.hadoop.fs.Path(path + "{,/*}"))
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in found))


def shared_index(notices: DataFrame, path: str) -> SearchIndex:
    """The session's index of the notices made from the table at ``path``; built once for all searches."""
    spark = notices.sparkSession
    key = (spark.sparkContext.applicationId, path, _state(spark, path))
    if key not in _BUILT:
        _BUILT[key] = build_index(notices)
    return _BUILT[key]


def keyed_terms(index: SearchIndex, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(lterm, piece, need): the PIECES rarest pieces of each distinct term, and how many these are.

    A term with a piece that no document holds is left out: nothing contains it.
    """
    t = terms.select("lterm").where(F.col("lterm") != "").distinct()
    cut = scratch.write(pieces(t.withColumn("_t", F.col("lterm")), "lterm", "_t", False), "term-pieces")
    df = index.postings.join(cut.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    known = cut.join(df, "piece", "left")
    rare = Window.partitionBy("lterm").orderBy("df", "piece")
    whole = Window.partitionBy("lterm")
    known = known.withColumns({"r": F.row_number().over(rare), "missing": F.count_if(F.col("df").isNull()).over(whole), "all": F.count(F.lit(1)).over(whole)})
    known = known.where(f"missing = 0 and r <= {PIECES}").select("lterm", "piece", F.least(F.col("all"), F.lit(PIECES)).alias("need"))
    return scratch.write(known, "keyed")


def candidates(index: SearchIndex, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(program_id, lterm) pairs whose document holds the term's rarest pieces: equi-join of numbers, then a count."""
    keyed = keyed_terms(index, terms, scratch)
    met = index.postings.join(keyed, "piece").groupBy("program_id", "lterm").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return met.where("n = need").select("program_id", "lterm")


def fetched(index: SearchIndex, pairs: DataFrame) -> DataFrame:
    """The pairs beside their documents: only the pairs are shuffled, to the documents' buckets, and hashed; no text is sorted."""
    return pairs.hint("shuffle_hash").join(index.documents, "program_id")
