"""Exact dedup by content sort (native).

Sampled splitters (``repartitionByRange``) deal the normalised texts into key
ranges by their first characters and, among equal beginnings, their hash; the external
sort inside each range puts equal texts side by side and the window's neighbour
comparison of the full bytes finds the runs.

A text whose copies are more than ``rows / SPLITS`` would make one range too
large.  Such texts are found first by a pre-aggregated count of 64-bit hashes; there
are at most SPLITS of them, so that table is broadcast.  Their rows get a second
range key, so the copies spread over several ranges, and the pieces of a text are
put together again by full text (one row per piece).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, text_or_empty

#: A text with more than 1/SPLITS of all rows is dealt out in pieces; also the bound on how many such texts exist.
SPLITS = 2000
#: Characters of a text in the sampled splitters.
KEY_CHARS = 32
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str):
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256, n_bytes).

    Equal: identical after each run of ASCII white space became one space; null
    counts as empty, so null and empty texts form one group.  The smallest id
    of a group stays; a null id sorts after all others and never stays beside one.
    Repeated rows with the smallest id share ``keep_id``; ``kept`` then marks exactly one of
    them (``copy`` numbers rows of one group and id).  Other columns of ``docs`` play no part.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    counts = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.write(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    piece = max(1, total // SPLITS)
    hot = counts.where(F.col("n") > piece).select("h", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    rows = (rows.withColumn("h", F.xxhash64("norm")).join(F.broadcast(hot), "h", "left")
                .withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", F.lit(17)), F.col("pieces")), F.lit(0)).cast("int")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # splitters are sampled to the driver: the key is the text's beginning and hash, not a text of any length
    dealt = (rows.select("id", "norm", "piece", F.col("pieces").isNotNull().alias("hot"), F.substring("norm", 1, KEY_CHARS).alias("lead"), "h")
                 .repartitionByRange(parts, "lead", "h", "piece"))
    run = Window.partitionBy("lead", "h", "piece", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = dealt.select(
        "id", "hot", "piece", F.row_number().over(run).alias("place"),
        F.first("id").over(whole).alias("low"), F.count(F.lit(1)).over(whole).alias("n"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
        F.when(F.col("hot") & (F.row_number().over(run) == 1), F.col("norm")).alias("norm"))
    found = scratch.write(sorted_rows, "sorted")
    scratch.drop(counts)
    # pieces of the texts dealt out: few rows (SPLITS * 2 at most), joined by full text
    heads = found.where("hot and place = 1").select("norm", "text_sha256", "piece", "low", "n")
    merged = heads.groupBy("norm").agg(
        F.min(F.struct(F.col("low").isNull().alias("x"), F.col("low").alias("low"), F.col("piece").alias("piece"))).alias("m"),
        F.sum("n").alias("all_n"), F.first("text_sha256").alias("text_sha256"))
    merged = merged.select("text_sha256", F.col("m.low").alias("all_low"), F.col("m.piece").alias("all_piece"), "all_n")
    out = found.drop("norm").join(F.broadcast(merged), "text_sha256", "left")
    keep = F.when(F.col("hot"), F.col("all_low")).otherwise(F.col("low"))
    return out.select(
        "id", keep.alias("keep_id"), F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | (F.col("piece") == F.col("all_piece")))).alias("kept"),
        "text_sha256", F.col("n_bytes").cast("long").alias("n_bytes"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    g = content_groups(docs)
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the row that stays of each group, with all its columns.

    Rows are identified by their id; of repeated rows with one id and equal texts one stays.
    """
    key = [F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("z"), F.col("text_sha256").alias("sha")]
    kept = content_groups(docs).where("kept").select(*key)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"], F.lit(0)).alias("k"),
        docs["doc_id"].isNull().alias("z"), F.sha2(F.encode(normalised("text"), "UTF-8"), 256).alias("sha"))
    return rows.join(kept, ["k", "z", "sha"], "left_semi").dropDuplicates(["k", "z", "sha"]).select("row.*")
