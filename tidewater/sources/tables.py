"""Table loading and the bindings from the driver tables to the logical tables.

Every binding is one deterministic projection over a driver table: no rows are
dropped, sampled or capped, and whole texts are kept.  The same projection is
written once more as a DuckDB CTE in ``tidewater.sources.oracle_bindings`` so
the oracle can read the raw tables only.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.constants import NATIONAL, NOT_FOUNDED, REGIONS, SEGMENTS, STAGES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed dates of the bindings (never current_date() inside an operator).
AS_OF = dt.date(2026, 6, 1)
PERIOD_BASE = dt.date(2026, 1, 1)
SYNC_BASE_EPOCH = 1767225600  # 2026-01-01 00:00:00 UTC


def load(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Column-pruned parquet scan (S10).  Catalyst pushes the projection into the reader."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# ---------------------------------------------------------------------------
# notices <- documents
# ---------------------------------------------------------------------------

def search_blob(name="name", field="field", tags_text="tags_text", summary="summary",
                agency="agency", body="body_text"):
    """Lower-cased concatenation of the searchable fields, NULL -> ''."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (name, field, tags_text, summary, agency, body)]
    return F.lower(F.concat_ws(" ", *parts))


def notices_from_documents(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "lang", "source")
    region_codes = F.array(*[F.lit(r) for r in REGIONS + [NATIONAL]])
    out = d.select(
        F.col("doc_id").alias("program_id"),
        F.lit("DOCS").alias("source_portal"),
        F.col("doc_id").cast("string").alias("source_doc_id"),
        F.trim(F.substring_index("text", "\n", 1)).alias("name"),
        F.col("source").alias("agency"),
        F.col("lang").alias("field"),
        F.array(F.col("source")).alias("normalized_tags"),
        F.element_at(region_codes, (F.col("doc_id") % 18 + 1).cast("int")).alias("region"),
        F.regexp_extract("text", r"^[^\n]*\n([^\n]*)", 1).alias("summary"),
        F.col("text").alias("body_text"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(PERIOD_BASE), (F.col("doc_id") % 400).cast("int")))
         .alias("period_end"),
        (F.col("doc_id") % 7 != 0).alias("is_open"),
        F.timestamp_seconds(F.lit(SYNC_BASE_EPOCH) + F.col("doc_id") * 60).alias("synced_at"),
        F.concat(F.lit("https://notices.example/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("detail_url"),
    )
    out = out.withColumn("tags_text", F.array_join("normalized_tags", " "))
    return out.withColumn("search_blob", search_blob())


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices_from_documents(load(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))


# ---------------------------------------------------------------------------
# profiles <- customer, match notices <- part
# ---------------------------------------------------------------------------

# market segment -> segment code of the binding
MKT_SEGMENT_CODE = {"AUTOMOBILE": "LOAN", "BUILDING": "SMB", "FURNITURE": "WOMAN",
                    "HOUSEHOLD": "YOUTH", "MACHINERY": "RND"}
FOUNDED_YEARS = [NOT_FOUNDED, "2026", "2025", "2024", "2023", "2019"]
PART_TYPE_CODE = {"ECONOMY": "SMB", "SMALL": "PRE", "LARGE": "EARLY", "MEDIUM": "WORKER",
                  "PROMO": "YOUTH", "STANDARD": "RND"}


def _map_expr(mapping: dict, col):
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])[col]


def profiles_from_customer(cust: DataFrame) -> DataFrame:
    seg_codes = F.array(*[F.lit(s) for s in SEGMENTS])
    years = F.array(*[F.lit(y) for y in FOUNDED_YEARS])
    mkt = _map_expr(MKT_SEGMENT_CODE, F.col("c_mktsegment"))
    by_key = F.element_at(seg_codes, (F.col("c_custkey") % 9 + 1).cast("int"))
    return cust.select(
        F.col("c_custkey").alias("profile_id"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("biz_name"),
        F.element_at(years, (F.col("c_custkey") % 6 + 1).cast("int")).alias("founded_year"),
        F.col("c_nationkey").cast("string").alias("industry_code"),
        F.array_distinct(F.array_compact(F.array(mkt, by_key))).alias("segments"),
    )


def match_notices_from_part(part: DataFrame) -> DataFrame:
    seg_codes = F.array(*[F.lit(s) for s in SEGMENTS])
    stages = F.array(*[F.lit(s) for s in STAGES])
    ptype = _map_expr(PART_TYPE_CODE, F.col("p_type"))
    by_size = F.element_at(seg_codes, (F.col("p_size") % 9 + 1).cast("int"))
    segs = F.when(F.col("p_size") % 9 == 4, F.array().cast("array<string>")) \
            .otherwise(F.array_distinct(F.array_compact(F.array(ptype, by_size))))
    stage = F.when(F.col("p_size") % 5 == 4, F.array().cast("array<string>")) \
             .otherwise(F.array(F.element_at(stages, (F.col("p_size") % 5 + 1).cast("int"))))
    inds = F.when(F.col("p_partkey") % 10 == 0,
                  F.array((F.col("p_partkey") % 25).cast("string"))) \
            .otherwise(F.array().cast("array<string>"))
    return part.select(
        F.col("p_partkey").alias("program_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("agency"),
        F.col("p_type").alias("field"),
        segs.alias("target_segments"),
        stage.alias("target_stages"),
        inds.alias("target_industries"),
    )


# ---------------------------------------------------------------------------
# raw feed <- events
# ---------------------------------------------------------------------------

FEED_SPLIT_TS = dt.datetime(2024, 1, 20)


def raw_feed_from_events(events: DataFrame) -> DataFrame:
    """source = event_type, source_doc_id = user_id, payload = props, fetched_at = ts."""
    return events.select(
        F.col("event_type").alias("source_id"),
        F.col("user_id").cast("string").alias("source_doc_id"),
        F.col("props").alias("payload"),
        F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("value"),
    )


# ---------------------------------------------------------------------------
# submissions / users / consulting <- orders, customer
# ---------------------------------------------------------------------------

# fixed values: lead types and statuses accepted by the intake form
LEAD_TYPES = ["예비창업자", "소상공인"]
STATUS_VALUES = ["pending", "contacted", "completed"]
PRIORITY_TYPE = {"1-URGENT": "예비창업자", "2-HIGH": "소상공인", "3-MEDIUM": "예비창업자",
                 "4-NOT SPECIFIED": "소상공인", "5-LOW": "기업"}
ORDER_STATUS = {"P": "pending", "O": "contacted", "F": "completed"}


def submissions_from_orders(orders: DataFrame, cust: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    c = cust.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    return j.select(
        F.col("o_orderkey").alias("id"),
        _map_expr(PRIORITY_TYPE, F.col("o_orderpriority")).alias("type"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("+82 10-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"),
                 F.lit("-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("biz-"), F.col("c_mktsegment")).alias("business_name"),
        F.col("c_name").alias("company_name"),
        F.array(F.col("c_mktsegment")).alias("interests"),
        F.col("o_orderpriority").alias("message"),
        _map_expr(ORDER_STATUS, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def users_from_customer(cust: DataFrame) -> DataFrame:
    return cust.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@members.example")).alias("email"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("010-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"),
                 F.lit("-0000")).alias("phone"),
        F.when(F.col("c_custkey") % 50 == 0, F.lit("admin")).otherwise(F.lit("member")).alias("role"),
        F.timestamp_seconds(F.lit(SYNC_BASE_EPOCH) + F.col("c_custkey") * 3600).alias("created_at"),
    )
