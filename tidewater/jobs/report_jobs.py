"""Report jobs (A1-A8) over the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.constants import SEGMENTS
from tidewater.operators import reports as R
from tidewater.operators.common import attach_scalar
from tidewater.registry import job
from tidewater.sources import tables as T
from tidewater.sources.feeds import enrich, filter_hosts
from tidewater.sources.local import literal_frame
from tidewater.sources.oracle_bindings import NOTICES_CTE, sql_case, with_ctes

# portal rules of the pages binding: URL substring rules, then source-code rules
PAGE_URL_RULES = [(".org/", "org-portal"), ("://m.", "mobile-portal"),
                  ("ref=", "referral-portal"), ("#top", "anchor-portal")]
PAGE_SOURCE_RULES = [("EN", "english-portal"), ("FR", "french-portal"),
                     ("DE", "german-portal"), ("ES", "spanish-portal")]


def pages_as_notices(spark, sf):
    p = T.load(spark, sf, "pages", ["page_id", "url"])
    return p.select(
        F.col("page_id").alias("program_id"),
        F.col("url").alias("detail_url"),
        F.upper(F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1)).alias("source_portal"),
    )


def _portal_sql() -> str:
    whens = [f"WHEN contains(url, '{p}') THEN '{label}'" for p, label in PAGE_URL_RULES]
    whens += [f"WHEN upper(regexp_extract(url, '://[^/]+/([a-z]{{2}})/', 1)) = '{c}' THEN '{label}'"
              for c, label in PAGE_SOURCE_RULES]
    return f"""SELECT CASE {' '.join(whens)} ELSE 'other' END AS portal, count(*) AS count
FROM pages GROUP BY 1"""


@job("a2_portal_breakdown", sql=_portal_sql())
def a2_portal_breakdown(spark, sf):
    return R.portal_breakdown(pages_as_notices(spark, sf), PAGE_URL_RULES, PAGE_SOURCE_RULES)


@job("a1_corpus_meta", sql=with_ctes(NOTICES_CTE) + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_open) AS open_count, max(synced_at) AS last_synced
FROM notices""")
def a1_corpus_meta(spark, sf):
    return R.corpus_meta(T.notices(spark, sf))


@job("a3_regions", sql=with_ctes(NOTICES_CTE) + """
SELECT DISTINCT region FROM notices WHERE region IS NOT NULL AND region <> '' ORDER BY region""")
def a3_regions(spark, sf):
    return R.regions(T.notices(spark, sf))


SUBMISSIONS_CTE = f"""
submissions AS (
  SELECT o_orderkey AS id,
         {sql_case('o_orderpriority', T.PRIORITY_TYPE)} AS type,
         c_name AS name,
         '+82 10-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '-' ||
             lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone,
         'biz-' || c_mktsegment AS business_name,
         c_name AS company_name,
         [c_mktsegment] AS interests,
         o_orderpriority AS message,
         {sql_case('o_orderstatus', T.ORDER_STATUS)} AS status,
         o_orderdate AS created_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

USERS_CTE = """
users AS (
  SELECT c_custkey AS id,
         lower(replace(c_name, '#', '.')) || '@members.example' AS email,
         c_name AS name,
         '010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-0000' AS phone,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'member' END AS role,
         TIMESTAMP '2026-01-01 00:00:00' + to_hours(CAST(c_custkey AS BIGINT)) AS created_at
  FROM customer
)"""


def submissions(spark, sf):
    return T.submissions_from_orders(
        T.load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                     "o_orderdate"]),
        T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]))


@job("a4_submission_stats", sql=with_ctes(SUBMISSIONS_CTE) + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE type = '예비창업자') AS startup,
       count(*) FILTER (WHERE type = '소상공인') AS small,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'contacted') AS contacted,
       count(*) FILTER (WHERE status = 'completed') AS completed
FROM submissions""")
def a4_submission_stats(spark, sf):
    return R.submission_stats(submissions(spark, sf))


# A5: type + status + text filter, page 2 of 20 newest first
A5_ARGS = dict(type_="소상공인", status="pending", q="mer#0000_01", page=2)


@job("a5_search_submissions", sql=with_ctes(SUBMISSIONS_CTE) + """,
hits AS (
  SELECT * FROM submissions
  WHERE type = '소상공인' AND status = 'pending'
    AND (name ILIKE '%mer#0000_01%' OR phone ILIKE '%mer#0000_01%'
         OR business_name ILIKE '%mer#0000_01%' OR company_name ILIKE '%mer#0000_01%')
),
ranked AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM hits)
SELECT r.id, r.name, r.status, r.created_at, CAST(r.rn AS INTEGER) AS rn, t.total
FROM ranked r CROSS JOIN (SELECT count(*) AS total FROM hits) t
WHERE r.rn > 20 AND r.rn <= 40""")
def a5_search_submissions(spark, sf):
    rows, total = R.search_submissions(submissions(spark, sf), **A5_ARGS)
    # one-row total attached by broadcast; the page holds at most 20 rows
    return attach_scalar(rows, total).select("id", "name", "status", "created_at", "rn", "total")


def consulting(spark, sf):
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                     "o_orderdate"])
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("application_id"),
        F.col("o_orderpriority").alias("area"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"),
        F.to_json(F.struct(F.col("o_custkey").alias("user"))).alias("context"),
        T._map_expr(T.ORDER_STATUS, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


@job("a6_consulting_report", sql=with_ctes(USERS_CTE) + f"""
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS application_id, o_orderpriority AS area,
       o_orderpriority || ' ' || o_orderstatus AS message, '{{"user":' || CAST(o_custkey AS VARCHAR) || '}}' AS context,
       {sql_case('o_orderstatus', T.ORDER_STATUS)} AS status, o_orderdate AS created_at,
       u.name AS user_name, u.email AS user_email, u.phone AS user_phone
FROM orders LEFT JOIN users u ON u.id = o_custkey
WHERE {sql_case('o_orderstatus', T.ORDER_STATUS)} = 'pending'
ORDER BY created_at DESC""")
def a6_consulting_report(spark, sf):
    users = T.users_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name"]))
    return R.consulting_report(consulting(spark, sf), users, status="pending")


def funnel_children(spark, sf):
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    li = T.load(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"])
    plan_rows = li.where(F.col("l_returnflag") == "R").join(o, li.l_orderkey == o.o_orderkey)
    deck_rows = li.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")) \
                  .join(o, li.l_orderkey == o.o_orderkey)
    return {
        "s_item": o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("user_id")),
        "s_analysis": o.where(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_custkey").alias("user_id")),
        "s_plan": plan_rows.select(F.col("o_custkey").alias("user_id")),
        "s_deck": deck_rows.select(F.col("o_custkey").alias("user_id")),
        "s_consulting": o.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("user_id")),
    }


@job("a7_member_funnel", sql=with_ctes(USERS_CTE) + """,
prof AS (SELECT c_custkey AS profile_id, c_custkey AS user_id, c_name AS biz_name,
                CAST(c_nationkey AS VARCHAR) AS industry_code
         FROM customer WHERE c_acctbal >= 0)
SELECT u.id, u.email, u.name, u.created_at, p.biz_name, p.industry_code,
       (p.profile_id IS NOT NULL) AS s_profile,
       EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = u.id AND o.o_orderpriority = '1-URGENT') AS s_item,
       EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = u.id AND o.o_orderpriority = '2-HIGH') AS s_analysis,
       EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
               WHERE o.o_custkey = u.id AND l.l_returnflag = 'R') AS s_plan,
       EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
               WHERE o.o_custkey = u.id AND l.l_returnflag = 'A' AND l.l_linestatus = 'F') AS s_deck,
       EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = u.id AND o.o_orderstatus = 'P') AS s_consulting
FROM users u LEFT JOIN prof p ON p.user_id = u.id
WHERE u.role = 'member' OR u.role IS NULL""")
def a7_member_funnel(spark, sf):
    cust = T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    users = T.users_from_customer(cust)
    profiles = T.profiles_from_customer(cust.where(F.col("c_acctbal") >= 0))
    out = R.member_funnel(users, profiles, funnel_children(spark, sf))
    return out.select("id", "email", "name", "created_at", "biz_name", "industry_code", "s_profile",
                      "s_item", "s_analysis", "s_plan", "s_deck", "s_consulting")


# All segment codes; those that some customer's market maps to are active
@job("a8_active_segments", sql="""
WITH used AS (
  SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'LOAN' WHEN 'BUILDING' THEN 'SMB'
                  WHEN 'FURNITURE' THEN 'WOMAN' WHEN 'HOUSEHOLD' THEN 'YOUTH' ELSE 'RND' END AS code
  FROM customer),
codes(code, sort_order) AS (VALUES ('PRE', 1), ('EARLY', 2), ('SMB', 3), ('YOUTH', 4), ('SENIOR', 5), ('WORKER', 6), ('WOMAN', 7), ('LOAN', 8), ('RND', 9))
SELECT code, CAST(sort_order AS INTEGER) AS sort_order, true AS active FROM codes WHERE code IN (SELECT code FROM used) ORDER BY sort_order""")
def a8_active_segments(spark, sf):
    used = T.load(spark, sf, "customer", ["c_mktsegment"]).select(T._map_expr(T.MKT_SEGMENT_CODE, F.col("c_mktsegment")).alias("code")).distinct()
    codes = literal_frame(spark, [(c, i + 1) for i, c in enumerate(SEGMENTS)], [("code", "string"), ("sort_order", "int")])
    codes = codes.join(used.withColumn("used", F.lit(True)), "code", "left").select("code", "sort_order", F.coalesce("used", F.lit(False)).alias("active"))
    return R.active_codes(codes)


# S3 + S5: host allow-list on the listing, then the detail body by id; only labelled documents have a detail
HOSTS = [".org/", "://m."]


@job("s5_enrich_pages", sql="""
WITH listing AS (SELECT page_id, url FROM pages WHERE contains(url, '.org/') OR contains(url, '://m.')),
     detail AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT l.page_id, l.url, CAST(length(coalesce(d.text, '')) AS INTEGER) AS body_chars
FROM listing l LEFT JOIN detail d ON d.doc_id = l.page_id""")
def s5_enrich_pages(spark, sf):
    listing = filter_hosts(T.load(spark, sf, "pages", ["page_id", "url"]), "url", HOSTS)
    labelled = T.load(spark, sf, "labels", ["doc_id"]).distinct()
    detail = T.load(spark, sf, "documents", ["doc_id", "text"]).join(labelled, "doc_id", "left_semi")
    out = enrich(listing, detail.select(F.col("doc_id").alias("page_id"), "text"), "page_id", "text")
    return out.select("page_id", "url", F.length("text").alias("body_chars"))
