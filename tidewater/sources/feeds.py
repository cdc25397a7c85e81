"""Landed feeds: envelope flattening, filters, enrichment, and the three mappings to canonical notices
(S1-S6, S8, S9, S11, N16)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import korean as K
from tidewater.functions.korean import TextLimits, cut, pick

# --- fixed values: where an envelope may hold its rows, in the order of trial ('$' is the bare array) ---
STARTUP_PATHS = ["$", "$.data", "$.response.body.items", "$.response.body.items.item", "$.body.items", "$.items"]
BIZ_PATHS = ["$", "$.jsonArray", "$.response.body.items", "$.body.items", "$.items", "$.data"]
AGGREGATE_PATHS = ["$.results"]

# --- fixed values: field names of the three sources, with their aliases in the order of trial ---
STARTUP_FIELDS = {
    "doc": ["pbanc_sn", "pbancSn", "id"], "title": ["biz_pbanc_nm", "bizPbancNm", "title"],
    "body": ["pbanc_ctnt", "pbancCtnt", "summary"], "target": ["aply_trgt_ctnt", "aplyTrgtCtnt"],
    "region": ["supt_regin", "suptRegin"], "agency": ["pbanc_ntrp_nm", "pbancNtrpNm"],
    "field": ["supt_biz_clsfc", "suptBizClsfc"], "start": ["pbanc_rcpt_bgng_dt", "pbancRcptBgngDt"],
    "end": ["pbanc_rcpt_end_dt", "pbancRcptEndDt"], "url": ["detl_pg_url", "detlPgUrl"],
}
BIZ_FIELDS = {
    "doc": ["pblancId", "pblanc_id"], "title": ["pblancNm", "pblanc_nm"], "body": ["bsnsSumryCn", "bsns_sumry_cn"],
    "target": ["trgetNm", "trget_nm"], "region": ["areaNm", "area_nm"],
    "agency": ["jrsdInsttNm", "jrsd_instt_nm", "excInsttNm"], "field": ["pldirSportRealmLclasCodeNm"],
    "period": ["reqstBeginEndDe", "reqst_begin_end_de"], "url": ["pblancUrl", "pblanc_url"],
}
AGGREGATE_FIELDS = {
    "doc": ["id"], "title": ["title"], "summary": ["summary"], "body": ["_body"], "region": ["region"],
    "agency": ["org", "ministry_name"], "field": ["support_field"], "deadline": ["deadline_at"], "url": ["source_url"],
    "published": ["published_at"],
}
STARTUP_AGENCY, BIZ_AGENCY = "창업진흥원", "중소벤처기업부"


def read_landed(landed: DataFrame, payload: str, paths: list[str]) -> DataFrame:
    """One row per notice of each envelope, as JSON text ``row``.

    The notices are the array at the first path that holds one, or that holds an object with an array
    under ``item``; an envelope without any, or unreadable JSON, gives no row.
    """
    found = F.lit(None).cast("string")
    for p in reversed(paths):
        at = F.get_json_object(payload, p)
        inner = F.get_json_object(payload, p + ".item") if not p.endswith(".item") else F.lit(None).cast("string")
        found = F.when(at.startswith("["), at).when(at.startswith("{") & inner.startswith("["), inner).otherwise(found)
    rest = [c for c in landed.columns if c != payload]
    return landed.select(*rest, F.explode(F.from_json(found, "array<string>")).alias("row"))


def fields_of(rows: DataFrame, names: dict[str, list[str]], row: str = "row") -> DataFrame:
    """The fields of a JSON row, parsed once; each the first non-blank of its aliases, default ''."""
    keys = list(dict.fromkeys(k for aliases in names.values() for k in aliases))
    rest = [c for c in rows.columns if c != row]
    parsed = rows.select(*rest, F.from_json(row, ", ".join(f"`{k}` string" for k in keys)).alias("_r"))
    return parsed.select(*rest, *[pick(*[F.col("_r")[k] for k in aliases]).alias(f"f_{n}") for n, aliases in names.items()])


CANONICAL = ["program_id", "source_portal", "source_doc_id", "name", "agency", "field", "target_stages", "target_segments",
             "region", "amount_text", "max_amount", "funding_type", "period_start", "period_end", "detail_url", "summary",
             "body_text", "normalized_tags"]


def _classified(f: DataFrame, summary: str, extra: Column) -> DataFrame:
    """Only rows with id and title (others are not normalizable); a region field of its own beats the text."""
    f = f.where((F.col("f_doc") != "") & (F.col("f_title") != "")).withColumn("_extra", extra)
    f = K.classify_frame(f, "f_title", summary, "_extra", prefix="c_")
    return f.withColumn("c_region", F.when(F.col("f_region") != "", K.infer_region(F.col("f_region"))).otherwise(F.col("c_region")))


def _canonical(f: DataFrame, portal: str, ident: Column, agency: Column, field: Column, amount_text: Column, amount: Column,
               start: Column, end: Column, summary: Column, body: Column, limits: TextLimits) -> DataFrame:
    return f.select(
        ident.alias("program_id"), F.lit(portal).alias("source_portal"), F.col("f_doc").alias("source_doc_id"),
        cut(F.col("f_title"), limits.name).alias("name"), cut(agency, limits.agency).alias("agency"), cut(field, limits.field).alias("field"),
        F.col("c_target_stages").alias("target_stages"), F.col("c_target_segments").alias("target_segments"), F.col("c_region").alias("region"),
        amount_text.alias("amount_text"), amount.alias("max_amount"), F.col("c_funding_type").alias("funding_type"),
        start.alias("period_start"), end.alias("period_end"), F.col("f_url").alias("detail_url"), cut(summary, limits.summary).alias("summary"),
        cut(body, limits.body).alias("body_text"), F.col("c_normalized_tags").alias("normalized_tags"))


def _or(c: Column, other) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def normalize_startup(rows: DataFrame, limits: TextLimits = TextLimits()) -> DataFrame:
    """S6, start-up portal: dates from their own fields."""
    f = _classified(fields_of(rows, STARTUP_FIELDS), "f_body", F.concat_ws(" ", "f_target", "f_region"))
    return _canonical(
        f, "KSTARTUP", K.program_id("KS-", F.col("f_doc"), chars=limits.doc_id), _or(F.col("f_agency"), STARTUP_AGENCY),
        _or(F.col("f_field"), F.col("c_funding_type")), K.amount_text(F.col("f_body"), chars=limits.amount_text),
        K.first_amount(F.col("f_body"), F.col("f_title")), K.parse_date(F.col("f_start")), K.parse_date(F.col("f_end")),
        F.col("f_body"), F.lit(None).cast("string"), limits)


def normalize_biz(rows: DataFrame, limits: TextLimits = TextLimits()) -> DataFrame:
    """S6, business portal: one period text, ids without their zero-padded prefix."""
    f = _classified(fields_of(rows, BIZ_FIELDS), "f_body", F.concat_ws(" ", "f_target", "f_region"))
    f = f.withColumn("_period", K.split_period(F.col("f_period")))
    return _canonical(
        f, "BIZINFO", K.program_id("BZ-", F.col("f_doc"), "^PBLN_0*", limits.doc_id), _or(F.col("f_agency"), BIZ_AGENCY),
        _or(F.col("f_field"), F.col("c_funding_type")), K.amount_text(F.col("f_body"), chars=limits.amount_text),
        K.first_amount(F.col("f_body"), F.col("f_title")), F.col("_period.start"), F.col("_period.end"),
        F.col("f_body"), F.lit(None).cast("string"), limits)


def normalize_aggregate(rows: DataFrame, limits: TextLimits = TextLimits()) -> DataFrame:
    """S6, aggregator: agency recovered, labelled lines classify, a structured deadline beats the text."""
    f = fields_of(rows, AGGREGATE_FIELDS)
    f = f.withColumn("_text", _or(F.col("f_body"), F.col("f_summary")))
    f = _classified(f, "f_summary", K.structured_hints(F.col("f_body"), limits.labeled))
    f = f.withColumn("_period", K.parse_period(F.col("_text"), limits.period_reach))
    labelled = K.labeled_field(F.col("f_body"), "지원분야", limits.labeled)
    return _canonical(
        f, "ONEGOV", K.program_id("OG-", F.col("f_doc"), chars=limits.doc_id),
        F.nullif(K.recover_agency(F.col("f_agency"), F.col("f_title"), F.col("f_summary")), F.lit("")),
        _or(F.col("f_field"), _or(labelled, F.col("c_funding_type"))), K.amount_text(F.col("_text"), True, limits.amount_text),
        K.first_amount(F.col("f_body"), F.col("f_summary"), F.col("f_title")), F.col("_period.start"),
        F.when(F.col("f_deadline") != "", K.parse_date(F.col("f_deadline"))).otherwise(F.col("_period.end")),
        _or(F.col("f_summary"), F.col("f_body")), F.nullif(F.col("f_body"), F.lit("")), limits)


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0].select(*CANONICAL)
    for f in frames[1:]:
        out = out.unionByName(f.select(*CANONICAL))
    return out


def notice_detail(notices: DataFrame, ids: DataFrame, internal=("content_hash", "search_blob", "source_doc_id")) -> DataFrame:
    """The asked notices without internal columns; an id without a notice gives no row."""
    return notices.join(ids.select("program_id").distinct(), "program_id").drop(*internal)


def filter_hosts(df: DataFrame, url: str, hosts: list[str]) -> DataFrame:
    """S3: keep rows whose URL contains an allowed host; an empty list keeps all."""
    if not hosts:
        return df
    cond = None
    for h in hosts:
        c = F.coalesce(F.col(url).contains(h), F.lit(False))
        cond = c if cond is None else cond | c
    return df.where(cond)


def filter_since(df: DataFrame, ts: str, since) -> DataFrame:
    """Keep published_at >= since; unparsable dates pass."""
    parsed = F.try_to_timestamp(F.col(ts))
    return df.where(parsed.isNull() | (parsed >= F.lit(since).cast("timestamp")))


def enrich(listing: DataFrame, detail: DataFrame, key: str, body: str = "html") -> DataFrame:
    """List row + body by id; a missing detail gives ''."""
    d = detail.select(F.col(key).alias("_k"), F.col(body).alias("_body"))
    return listing.join(d, listing[key] == d["_k"], "left").drop("_k") \
        .withColumn(body, F.coalesce("_body", F.lit(""))).drop("_body")


def payload_field(payload: Column, key: str) -> Column:
    """Text of a JSON payload key (NULL when absent)."""
    return F.get_json_object(payload, f"$.{key}")


def csv_safe(c: Column) -> Column:
    """Cells starting with = + - @ TAB CR get a leading quote."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), s)).otherwise(s)


#: Every cell quoted, quotes doubled, spaces at the ends of a cell kept.
CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str, array_cols=(), order_col: str | None = None) -> None:
    """Guarded CSV export, arrays joined ' | ', every cell quoted, newest first."""
    out = df if order_col is None else df.orderBy(F.col(order_col).desc())  # before cells become text
    for c in array_cols:
        out = out.withColumn(c, F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " | "))
    out = out.select(*[csv_safe(F.col(c)).alias(c) for c in out.columns])
    out.write.mode("overwrite").options(**CSV).csv(path)


def import_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An export read back; cells keep their guards, line ends and spaces.  A file with line ends in cells is read by one task."""
    return spark.read.options(**CSV, multiLine=True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path).fillna("")
