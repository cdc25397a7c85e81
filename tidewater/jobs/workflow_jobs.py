"""Document-workflow jobs.

Bindings: profiles and users = customer; item texts = documents (profile_id = doc_id: the lines of the text
are the strategies, its first sentences the other fields); applications = orders (one per order, profile = customer,
notice = first part of the order's lines).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import workflow as W
from tidewater.registry import job
from tidewater.sources import tables as T
from tidewater.sources.oracle_bindings import PROFILES_CTE, with_ctes

NOW = dt.datetime(2024, 3, 1)


def profiles(spark, sf):
    return T.profiles_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


def items(spark, sf):
    """profile_id, core_function, customer_benefit, problem_point, market_status, core_tech, strategy_1..3."""
    d = T.load(spark, sf, "documents", ["doc_id", "text", "source"])
    text = F.coalesce("text", F.lit(""))
    sentence = lambda i: F.get(F.split(text, "[.]"), F.lit(i))
    line = lambda i: F.get(F.split(text, "\n"), F.lit(i))
    return d.select(F.col("doc_id").alias("profile_id"), F.substring(sentence(0), 1, 12).alias("core_function"), sentence(1).alias("customer_benefit"),
                    sentence(0).alias("problem_point"), sentence(2).alias("market_status"), F.repeat("source", F.length("source") * 3).alias("core_tech"),
                    line(0).alias("strategy_1"), line(1).alias("strategy_2"), line(2).alias("strategy_3"))


def wide(spark, sf, names=None):
    it = items(spark, sf)
    if names is None:
        names = it.select("profile_id", F.lit(None).cast("string").alias("suggestion_text"), F.lit(False).alias("selected"))
    return W.profile_wide(profiles(spark, sf), it.select("profile_id", "core_function", "customer_benefit", "core_tech"),
                          it.select("profile_id", "problem_point", "market_status"), it.select("profile_id", "strategy_1", "strategy_2", "strategy_3"), names)


ITEMS = """
items AS (
  SELECT doc_id AS profile_id, substr(split_part(t, '.', 1), 1, 12) AS core_function, s[2] AS customer_benefit, s[1] AS problem_point, s[3] AS market_status,
         repeat(source, length(source) * 3) AS core_tech, l[1] AS strategy_1, l[2] AS strategy_2, l[3] AS strategy_3
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), '.') AS s, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
wide AS (SELECT p.*, i.* EXCLUDE (profile_id) FROM profiles p LEFT JOIN items i USING (profile_id))"""
BASE = with_ctes(PROFILES_CTE, ITEMS)
NAMES = """,
kw AS (SELECT profile_id, coalesce(nullif(core_function, ''), nullif(industry_code, ''), '혁신 기술') AS kw, coalesce(nullif(customer_benefit, ''), '맞춤형') AS benefit,
         CASE WHEN list_contains(segments, 'SMB') THEN '소상공인' ELSE '창업기업' END AS target
       FROM wide WHERE core_function IS NOT NULL OR customer_benefit IS NOT NULL OR problem_point IS NOT NULL),
cand AS (SELECT profile_id, 0 AS no, '기본형' AS type, kw || ' 기반 ' || benefit || ' 플랫폼' AS suggestion_text FROM kw
   UNION ALL SELECT profile_id, 1, '차별성 강조형', '기존 방식 대체 ' || kw || ' 솔루션' FROM kw
   UNION ALL SELECT profile_id, 2, '시장 기회형', target || ' 맞춤 ' || benefit || ' 서비스' FROM kw),
choice AS (SELECT o_custkey AS profile_id, arg_max(o_orderkey % 3, o_orderkey) AS pick FROM orders GROUP BY 1),
names AS (SELECT c.*, coalesce(c.no = h.pick, false) AS selected FROM cand c LEFT JOIN choice h USING (profile_id))"""


def changes(spark, sf):
    """Profile forms: one per order, its customer the user; odd orders leave the second half blank."""
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    given = lambda c: F.when(key % 2 == 0, c).otherwise(F.lit(""))
    return o.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("biz_name"), F.when(status == "O", "").otherwise(F.lit("2024")).alias("founded_year"),
        status.alias("industry_code"), F.when(status != "P", F.lit("")).otherwise(F.lit("서울")).alias("region_sido"),
        given(F.concat(F.lit("gu "), (key % 25).cast("string"))).alias("region_sigungu"), given(F.concat(F.floor(F.col("o_totalprice") / 50000).cast("string"), F.lit("억"))).alias("revenue_band"),
        F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(" people")).alias("employees"),
        F.split(F.repeat(F.concat(status, F.lit(",")), (key % 12).cast("int")), ",").alias("segments"),
        F.concat_ws(" ", "o_orderpriority", key.cast("string")).alias("biz_summary"), F.when(status == "F", "").otherwise(F.col("o_orderpriority")).alias("product_desc"),
        given(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("core_tech"), F.when(status == "P", status).alias("competitive_edge"), key.alias("seq"))


LAST_FORM = """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1)"""


def merged_profiles(spark, sf):
    text = F.lit(None).cast("string")
    state = profiles(spark, sf).select("user_id", "biz_name", "founded_year", "industry_code", text.alias("region_sido"), F.col("industry_code").alias("region_sigungu"),
                                       F.lit(None).cast("int").alias("employee_cnt"), text.alias("revenue_band"), "segments", F.to_timestamp(F.lit("2023-01-01")).alias("updated_at"))
    return W.merge_profiles(state, changes(spark, sf), NOW, W.PROFILE_SEGMENTS)


@job("p1_merge_profiles", sql=with_ctes(PROFILES_CTE) + LAST_FORM + """
SELECT coalesce(p.user_id, l.o_custkey) AS user_id, CASE WHEN l.r = 1 THEN o_orderpriority ELSE biz_name END AS biz_name,
  CASE WHEN l.r = 1 THEN CASE WHEN o_orderstatus = 'O' THEN NULL ELSE '2024' END ELSE founded_year END AS founded_year,
  CASE WHEN l.r = 1 THEN o_orderstatus ELSE industry_code END AS industry_code,
  CASE WHEN l.r = 1 AND o_orderstatus = 'P' THEN '서울' END AS region_sido,
  CASE WHEN l.r IS NULL THEN industry_code WHEN o_orderkey % 2 = 0 THEN 'gu ' || CAST(o_orderkey % 25 AS VARCHAR) END AS region_sigungu,
  CASE WHEN l.r = 1 THEN nullif(CAST(floor(o_totalprice / 1000) AS INTEGER), 0) END AS employee_cnt,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(floor(o_totalprice / 50000) AS INTEGER) AS VARCHAR) || '억' END AS revenue_band,
  array_to_string(CASE WHEN l.r = 1 THEN string_split(repeat(o_orderstatus || ',', CAST(o_orderkey % 12 AS INTEGER)), ',')[1:9] ELSE segments END, '|') AS segments,
  CASE WHEN l.r = 1 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2023-01-01 00:00:00' END AS updated_at, l.r IS NOT NULL AS touched
FROM profiles p FULL OUTER JOIN last l ON p.user_id = l.o_custkey""")
def p1_merge_profiles(spark, sf):
    return merged_profiles(spark, sf).withColumn("segments", F.array_join("segments", "|"))


@job("p1_merge_business", sql=with_ctes(PROFILES_CTE) + LAST_FORM + """,
held AS (SELECT profile_id, biz_name AS biz_summary, industry_code AS product_desc, biz_name AS core_tech, industry_code AS competitive_edge FROM profiles WHERE profile_id % 3 > 0)
SELECT coalesce(h.profile_id, l.o_custkey) AS profile_id,
  CASE WHEN l.r = 1 THEN o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) ELSE biz_summary END AS biz_summary,
  CASE WHEN l.r IS NULL THEN product_desc WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS product_desc,
  CASE WHEN l.r IS NULL THEN core_tech WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS core_tech,
  CASE WHEN l.r IS NULL THEN competitive_edge WHEN o_orderstatus = 'P' THEN 'P' END AS competitive_edge
FROM held h FULL OUTER JOIN (SELECT * FROM last WHERE o_custkey IN (SELECT user_id FROM profiles)) l ON h.profile_id = l.o_custkey""")
def p1_merge_business(spark, sf):
    """The business satellite of each saved profile; two thirds of the profiles have one already."""
    p = profiles(spark, sf)
    held = p.where("profile_id % 3 > 0").select("profile_id", F.col("biz_name").alias("biz_summary"), F.col("industry_code").alias("product_desc"),
                                                F.col("biz_name").alias("core_tech"), F.col("industry_code").alias("competitive_edge"))
    return W.merge_satellite(held, p, changes(spark, sf))


def named(spark, sf):
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    choices = o.select(F.col("o_custkey").alias("profile_id"), (F.col("o_orderkey") % 3).cast("int").alias("no"), F.col("o_orderkey").alias("seq"))
    return W.select_one(W.name_candidates(wide(spark, sf)).withColumn("selected", F.lit(False)), choices)


@job("p4_selected_names", sql=BASE + NAMES + "SELECT profile_id, CAST(no AS INTEGER) AS no, type, suggestion_text, selected FROM names")
def p4_selected_names(spark, sf):
    """Three candidates per profile with items; the last choice of a profile is selected."""
    return named(spark, sf)


@job("p2_profile_wide", sql=BASE + NAMES + """
SELECT w.profile_id, w.biz_name, w.core_function, w.customer_benefit, w.problem_point, w.market_status, w.strategy_1, w.strategy_2, w.strategy_3, n.suggestion_text AS item_name
FROM wide w LEFT JOIN (SELECT * FROM names WHERE selected) n USING (profile_id)""")
def p2_profile_wide(spark, sf):
    return wide(spark, sf, named(spark, sf)).select("profile_id", "biz_name", "core_function", "customer_benefit", "problem_point", "market_status",
                                                     "strategy_1", "strategy_2", "strategy_3", "item_name")


def _score(c):
    return f"CAST(least(5, greatest(2, 2 + floor(length(coalesce({c}, '')) / 30))) AS INTEGER)"


SCORES = f"""
scores AS (SELECT profile_id, {_score('problem_point')} AS problem_fit, {_score('market_status')} AS market, {_score('core_tech')} AS founder_fit,
    CASE WHEN n >= 3 THEN 5 WHEN n = 2 THEN 4 ELSE 3 END AS differentiation, {_score('customer_benefit')} AS scalability
  FROM (SELECT *, CASE WHEN strategy_1 <> '' THEN 1 ELSE 0 END + CASE WHEN strategy_2 <> '' THEN 1 ELSE 0 END + CASE WHEN strategy_3 <> '' THEN 1 ELSE 0 END AS n FROM wide))"""


@job("p5_rubric_scores", sql=with_ctes(PROFILES_CTE, ITEMS, SCORES) + "SELECT * FROM scores")
def p5_rubric_scores(spark, sf):
    return W.rubric_scores(wide(spark, sf))


@job("p6_strengths_gaps", sql=with_ctes(PROFILES_CTE, ITEMS, SCORES) + """,
a AS (SELECT profile_id, 0 AS pos, '문제-해결 적합성' AS area, problem_fit AS s FROM scores UNION ALL SELECT profile_id, 1, '시장 크기·성장성', market FROM scores
  UNION ALL SELECT profile_id, 2, '실행 역량', founder_fit FROM scores UNION ALL SELECT profile_id, 3, '차별성·진입장벽', differentiation FROM scores
  UNION ALL SELECT profile_id, 4, '확장 가능성', scalability FROM scores),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY s DESC, pos) AS best, row_number() OVER (PARTITION BY profile_id ORDER BY s, pos DESC) AS worst FROM a)
SELECT profile_id, '강점' AS kind, CAST(best AS INTEGER) AS rank, area, area || ' — 입력 내용 기준 강점으로 평가됩니다.' AS text FROM r WHERE best <= 3
UNION ALL SELECT profile_id, '보완', CAST(worst AS INTEGER), area, area || ' — 구체적 근거·정량 목표 보강을 권장합니다.' FROM r WHERE worst <= 3""")
def p6_strengths_gaps(spark, sf):
    return W.strengths_gaps(W.rubric_scores(wide(spark, sf)))


def applications(spark, sf):
    """(application_id = plan_id, user_id = profile_id, program_id): the notice is the smallest part of an order's lines."""
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    li = T.load(spark, sf, "lineitem", ["l_orderkey", "l_partkey"]).groupBy("l_orderkey").agg(F.min("l_partkey").alias("program_id"))
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").alias("application_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("profile_id"), "program_id")


def part_notices(spark, sf):
    return T.load(spark, sf, "part", ["p_partkey", "p_name"]).select(F.col("p_partkey").alias("program_id"), F.col("p_name").alias("name"))


APPS = """
apps AS (SELECT o_orderkey AS application_id, o_orderkey AS plan_id, o_custkey AS user_id, o_custkey AS profile_id, l.program_id
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS program_id FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey)"""
SECTIONS = """
drafts AS (SELECT a.plan_id, unnest([
  {'section_key': 'problem', 'section_title': '1. 문제 인식', 'content': '「' || p.p_name || '」 지원을 위한 문제 인식' || chr(10) || chr(10) || coalesce(nullif(w.problem_point, ''), '대상 시장에는 해결되지 않은 문제가 존재합니다.')
     || ' 본 사업 「' || coalesce(nullif(w.biz_name, ''), '본 사업') || '」은 이 문제를 정조준합니다.' || chr(10) || chr(10) || '(목업 — AI 연동 시 공고 평가항목·시장데이터 기반 자동 작성)'},
  {'section_key': 'feasibility', 'section_title': '2. 실현 가능성', 'content': '실현 가능성' || chr(10) || chr(10) || coalesce(nullif(w.core_function, ''), '핵심 기능') || '을 통해 ' || coalesce(nullif(w.customer_benefit, ''), '고객 가치')
     || '를 제공합니다. 사업기간 내 MVP 개발·검증을 완료할 계획입니다.' || chr(10) || chr(10) || '(목업)'},
  {'section_key': 'growth', 'section_title': '3. 성장 전략', 'content': '성장 전략' || chr(10) || chr(10) || '초기 목표 시장을 확보한 뒤 인접 시장으로 확장합니다. 정부지원사업 선정으로 성장을 가속합니다.' || chr(10) || chr(10) || '(목업)'},
  {'section_key': 'team', 'section_title': '4. 팀 구성', 'content': '팀 구성' || chr(10) || chr(10) || '대표자의 ' || coalesce(nullif(w.core_tech, ''), '전문성') || '을 중심으로 핵심 인력을 구성합니다.' || chr(10) || chr(10) || '(목업)'}], recursive := true), 1 AS version
  FROM apps a JOIN part p ON p.p_partkey = a.program_id JOIN wide w ON w.profile_id = a.profile_id),
before AS (SELECT o_orderkey AS plan_id, 'problem' AS section_key, '1. 문제 인식' AS section_title, o_orderpriority AS content, 3 AS version FROM orders),
sections AS (SELECT * FROM drafts UNION ALL SELECT * FROM before WHERE plan_id NOT IN (SELECT plan_id FROM drafts))"""


def sections(spark, sf):
    old = T.load(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("plan_id"), F.lit("problem").alias("section_key"), F.lit("1. 문제 인식").alias("section_title"), F.col("o_orderpriority").alias("content"), F.lit(3).alias("version"))
    return W.draft_sections(applications(spark, sf), wide(spark, sf), part_notices(spark, sf), old)


@job("p7_draft_sections", sql=with_ctes(PROFILES_CTE, ITEMS, APPS, SECTIONS) + "SELECT plan_id, section_key, section_title, content, version FROM sections")
def p7_draft_sections(spark, sf):
    return sections(spark, sf)


ASKED = "asked AS (SELECT l_orderkey AS plan_id, CASE l_linestatus WHEN 'O' THEN 'growth' ELSE 'outlook' END AS section_key FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1)"


def section_requests(spark, sf):
    li = T.load(spark, sf, "lineitem", ["l_orderkey", "l_linestatus", "l_returnflag", "l_linenumber"]).where("l_returnflag = 'R' or l_linenumber = 1")
    return li.select(F.col("l_orderkey").alias("plan_id"), F.when(F.col("l_linestatus") == "O", "growth").otherwise("outlook").alias("section_key"))


@job("p8_regenerate", sql=with_ctes(PROFILES_CTE, ITEMS, APPS, SECTIONS, ASKED) + """
SELECT s.plan_id, s.section_key, CAST(s.version + coalesce(n, 0) AS INTEGER) AS version,
  CASE WHEN n IS NOT NULL THEN '[재생성됨] 이 섹션은 새로 생성된 샘플 내용입니다. 실제 재생성은 순차 오픈됩니다.' ELSE content END AS content
FROM sections s LEFT JOIN (SELECT plan_id, section_key, count(*) AS n FROM asked GROUP BY ALL) USING (plan_id, section_key)""")
def p8_regenerate(spark, sf):
    out, _ = W.regenerate(sections(spark, sf), section_requests(spark, sf))
    return out.select("plan_id", "section_key", "version", "content")


@job("p8_unknown_sections", sql=with_ctes(PROFILES_CTE, ITEMS, APPS, SECTIONS, ASKED) + """
SELECT plan_id, section_key FROM asked WHERE (plan_id, section_key) NOT IN (SELECT (plan_id, section_key) FROM sections)""")
def p8_unknown_sections(spark, sf):
    return W.regenerate(sections(spark, sf), section_requests(spark, sf))[1]


@job("p9_draft_slides", sql="""
SELECT o_orderkey AS plan_id, CAST(n AS INTEGER) AS order_no, t AS slide_type, h AS headline, t || ' 슬라이드 본문 (목업)' AS body_content, '표/그래프/이미지 제안 (목업)' AS visual_suggestion
FROM orders, (VALUES (1, '표지', '사업 아이템명 · 대표자명'), (2, '문제인식', '시장 현황 및 문제점'), (3, '솔루션', '제품·서비스 개요'), (4, '차별성', '차별화 전략 3가지'),
  (5, '실현가능성', '마일스톤 타임라인'), (6, '시장성', '시장 규모·확장 계획'), (7, '팀', '대표자 경력·역량'), (8, '자금운용', '지원금 사용 계획'), (9, '클로징', '한 줄 요약')) s(n, t, h)""")
def p9_draft_slides(spark, sf):
    """Nine ordered slides per plan (one plan per order)."""
    return W.draft_slides(T.load(spark, sf, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("plan_id")))


@job("p10_owned_plans", sql=with_ctes(APPS) + """,
asked AS (SELECT DISTINCT l_orderkey AS plan_id, l_suppkey AS user_id FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT a.plan_id, a.program_id, q.user_id FROM apps a JOIN asked q ON q.plan_id = a.plan_id AND q.user_id = a.user_id""")
def p10_owned_plans(spark, sf):
    """Plans shown to users who ask for them: only those of their own applications."""
    a = applications(spark, sf)
    li = T.load(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"]).select(F.col("l_orderkey").alias("plan_id"), F.col("l_suppkey").alias("user_id"))
    own = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("user_id"))
    return W.owned(a.select("plan_id", "program_id"), a.select("plan_id", "application_id"), a, li.union(own))


P11 = """
state AS (SELECT user_id, program_id, 'SUBMITTED' AS status, max(o_orderdate) AS updated_at FROM apps JOIN orders ON o_orderkey = application_id WHERE program_id IS NOT NULL GROUP BY 1, 2),
req AS (SELECT c_custkey AS user_id, CAST(c_custkey + c_nationkey AS BIGINT) AS program_id FROM customer UNION ALL SELECT user_id, program_id FROM state WHERE user_id < program_id)"""


def application_requests(spark, sf):
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    state = applications(spark, sf).join(o, F.col("application_id") == F.col("o_orderkey")).where("program_id is not null") \
        .groupBy("user_id", "program_id").agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("updated_at")).withColumn("status", F.lit("SUBMITTED"))
    c = T.load(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + F.col("c_nationkey")).cast("long").alias("program_id"))
    return state, c.union(state.where("user_id < program_id").select("user_id", "program_id"))


@job("p11_upsert_applications", sql=with_ctes(APPS, P11) + """,
ok AS (SELECT DISTINCT * FROM req WHERE program_id IN (SELECT p_partkey FROM part))
SELECT coalesce(s.user_id, o.user_id) AS user_id, coalesce(s.program_id, o.program_id) AS program_id,
  CASE WHEN o.user_id IS NOT NULL THEN 'PLAN_DRAFTING' ELSE s.status END AS status,
  CASE WHEN o.user_id IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE CAST(s.updated_at AS TIMESTAMP) END AS updated_at
FROM state s FULL OUTER JOIN ok o ON s.user_id = o.user_id AND s.program_id = o.program_id""")
def p11_upsert_applications(spark, sf):
    state, requests = application_requests(spark, sf)
    return W.upsert_applications(state, requests, part_notices(spark, sf), NOW)[0]


@job("p11_unknown_notices", sql=with_ctes(APPS, P11) + "SELECT user_id, program_id FROM req WHERE program_id NOT IN (SELECT p_partkey FROM part)")
def p11_unknown_notices(spark, sf):
    state, requests = application_requests(spark, sf)
    return W.upsert_applications(state, requests, part_notices(spark, sf), NOW)[1].select("user_id", "program_id")


@job("p12_context", sql=with_ctes(PROFILES_CTE) + """
SELECT o_orderkey AS id, CAST(json_object('profile', CASE WHEN p.user_id IS NOT NULL THEN json_object('biz_name', p.biz_name, 'segments', p.segments, 'industry_code', p.industry_code, 'region_sido', NULL) END,
  'user', CASE WHEN c.c_custkey IS NOT NULL THEN json_object('name', c.c_name, 'email', lower(replace(c.c_name, '#', '.')) || '@members.example',
     'phone', '010-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0') || '-0000') END) AS VARCHAR) AS context
FROM orders LEFT JOIN profiles p ON p.user_id = o_custkey LEFT JOIN customer c ON c.c_custkey = o_custkey""")
def p12_context(spark, sf):
    users = T.users_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name"]))
    requests = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    p = profiles(spark, sf).withColumn("region_sido", F.lit(None).cast("string"))
    return W.snapshot_context(requests, p, users).select("id", "context")


PATCH = """
patch AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_suppkey * 10000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'lost'
      WHEN l_returnflag = 'R' THEN 'contacted' END AS status, CASE WHEN l_linestatus = 'O' THEN l_returnflag || ' ' || CAST(l_partkey AS VARCHAR) END AS memo FROM lineitem)"""


def patches(spark, sf):
    li = T.load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"])
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("seq"),
                     F.when(flag == "A", "completed").when((flag == "R") & (line == "F"), "lost").when(flag == "R", "contacted").alias("status"),
                     F.when(line == "O", F.concat_ws(" ", flag, F.col("l_partkey").cast("string"))).alias("memo"))


@job("p13_apply_patches", sql=with_ctes(PATCH) + """,
p AS (SELECT id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS st, arg_max(memo, seq) FILTER (WHERE memo IS NOT NULL) AS me
      FROM patch WHERE status IS NULL OR status <> 'lost' GROUP BY 1)
SELECT o_orderkey AS id, coalesce(st, 'pending') AS status, coalesce(me, o_orderpriority) AS memo,
  CASE WHEN st IS NOT NULL OR me IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at
FROM orders LEFT JOIN p ON p.id = o_orderkey""")
def p13_apply_patches(spark, sf):
    state = T.load(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate"]).select(
        F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"), F.col("o_orderpriority").alias("memo"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return W.apply_patches(state, patches(spark, sf), NOW, memo_chars=W.MEMO_CHARS)[0]


@job("p13_rejected_patches", sql=with_ctes(PATCH) + "SELECT id, CAST(seq AS BIGINT) AS seq, status, memo FROM patch WHERE status = 'lost'")
def p13_rejected_patches(spark, sf):
    state = T.load(spark, sf, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"), F.lit("").alias("memo"))
    return W.apply_patches(state, patches(spark, sf), memo_chars=W.MEMO_CHARS)[1].withColumn("seq", F.col("seq").cast("long"))


LEADS = """
leads AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN '예비창업자' WHEN 'de' THEN '소상공인' ELSE lang END AS type, split_part(text, '.', 1) AS name,
    CASE WHEN length(text) % 5 = 0 THEN source ELSE '+82 10-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') END AS phone, split_part(text, chr(10), 1) AS message, source AS company_name, split_part(text, '.', 2) AS consult_type, string_split(split_part(text, '.', 2), ' ') AS interests FROM documents)"""


def leads(spark, sf):
    d = T.load(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    part = lambda sep, i: F.get(F.split("text", sep), F.lit(i))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "예비창업자").when(F.col("lang") == "de", "소상공인").otherwise(F.col("lang")).alias("type"),
                    part("[.]", 0).alias("name"), F.when(F.length("text") % 5 == 0, F.col("source")).otherwise(F.concat(F.lit("+82 10-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).alias("phone"),
                    part("\n", 0).alias("message"), F.col("source").alias("company_name"), part("[.]", 1).alias("consult_type"), F.split(F.coalesce(part("[.]", 1), F.lit("")), " ").alias("interests"))


TRIMMED = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"


@job("p14_valid_leads", sql=with_ctes(LEADS) + f"""
SELECT id, type, {TRIMMED.format('name')} AS name, phone, array_to_string(interests[1:10], '|') AS interests FROM leads
WHERE type IN ('예비창업자', '소상공인') AND length({TRIMMED.format('name')}) BETWEEN 1 AND 50 AND starts_with(phone, '+') AND length(coalesce(message, '')) <= 2000
  AND length({TRIMMED.format('consult_type')}) <= 100""")
def p14_valid_leads(spark, sf):
    return W.validate_submissions(leads(spark, sf), W.INTERESTS)[0].select("id", "type", "name", "phone", F.array_join("interests", "|").alias("interests"))


@job("p14_rejected_leads", sql=with_ctes(LEADS) + f"""
SELECT id, array_to_string(list_filter([CASE WHEN type IN ('예비창업자', '소상공인') THEN NULL ELSE 'type' END, CASE WHEN length({TRIMMED.format('name')}) NOT BETWEEN 1 AND 50 THEN 'name' END,
  CASE WHEN NOT starts_with(phone, '+') THEN 'phone' END, CASE WHEN length(coalesce(message, '')) > 2000 THEN 'message' END,
  CASE WHEN length({TRIMMED.format('consult_type')}) > 100 THEN 'consult_type' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM leads WHERE NOT (coalesce(type IN ('예비창업자', '소상공인'), false) AND length({TRIMMED.format('name')}) BETWEEN 1 AND 50 AND starts_with(phone, '+') AND length(coalesce(message, '')) <= 2000
  AND length({TRIMMED.format('consult_type')}) <= 100)""")
def p14_rejected_leads(spark, sf):
    return W.validate_submissions(leads(spark, sf), W.INTERESTS)[1].select("id", F.array_join("reasons", "|").alias("reasons"))


@job("p15_items_valid", sql=with_ctes(PROFILES_CTE, ITEMS) + r"""
SELECT profile_id, len(list_filter([strategy_1, strategy_2, strategy_3], lambda s: regexp_replace(coalesce(s, ''), '\s', '', 'g') <> '')) = 3 AS valid FROM items""")
def p15_items_valid(spark, sf):
    return items(spark, sf).select("profile_id", W.validate_items(F.array("strategy_1", "strategy_2", "strategy_3")).alias("valid"))


@job("p16_fill_defaults", sql="""
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(o.p, '카카오 사용자') ELSE c_name END AS name,
  CASE WHEN c_nationkey < 12 THEN CASE c_nationkey % 2 WHEN 0 THEN coalesce(nullif(o.s, ''), '') ELSE nullif(o.s, '') END ELSE '010' END AS phone
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p, max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def p16_fill_defaults(spark, sf):
    c = T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    users = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", W.DEFAULT_NAME).otherwise(F.col("c_name")).alias("name"),
                     F.when(F.col("c_nationkey") >= 12, "010").when(F.col("c_nationkey") % 2 == 0, "").alias("phone"))
    o = T.load(spark, sf, "orders", ["o_custkey", "o_orderpriority", "o_orderstatus"])
    fresh = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"), F.max(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))).alias("phone"))
    return W.fill_defaults(users, fresh)
