"""Normalization and landed-feed jobs (N1-N19, S1, S2, S4, S6, S8, S11) over Korean notices derived from ``documents``.

The driver tables hold no Korean notices, so every document gets a notice header of our own in front of its whole
text: wording by its id (an equi-join on a 12-row literal table), while title, year, amount, period and area also depend on its
own text (first word and length), so that the rules see hundreds of different inputs.  The landed feeds are
those notices again as JSON envelopes of three sources.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import korean as K
from tidewater.functions.korean import CATALOGUE_TEXT as C
from tidewater.jobs import normalize_sql as Q
from tidewater.registry import job
from tidewater.scratch import Scratch
from tidewater.sources import feeds
from tidewater.sources import tables as T
from tidewater.sources.local import literal_frame

# Our own notice headers (title, summary, further lines, period text, region field); not taken from any feed.
HEADERS = [
    ("[강원] 속초시 바닷가 상점 새단장 지원", "속초 해변의 작은 가게를 돕는 사업", "지원대상: 예비 창업자와 창업 3년 이내 기업\n접수기간: 2027.4.5 ~ 2027.5.9\n지원내용: 최대 2억원 사업화 자금", "20270405 ~ 20270509", "강원"),
    ("소상공인 겨울 운전자금 융자", "가게마다\u00a07,500만원\u3000까지 빌려 드립니다.", "신청기간:\u30002027-01-11 ~ 2027-02-12\n지원내용:\u00a0업체당 7,500만원 이내 대출", "2027-01-11 - 2027-02-12", ""),
    ("전국 중장년 기술창업 R & D 과제", "경험 많은 분들의 연구개발을 지원", "모집기간 2027년 6월 3일 ~ 2027년 6월 24일\n지원규모: 3억 2천만원", "2027년 6월 3일부터 2027년 6월 24일까지", "전국"),
    ("여성기업 판로 열기", "(재)한빛여성경제재단에서 함께 합니다", "지원금액: 4천만원", "", "서울 전 지역"),
    ("[전북] 스마트 공방 디지털 전환", "공방 설비를 새것으로", "지원분야:\u3000제조 설비\u00a0\n접수기간: 20270315 ~ 20271130", "20270315~20271130", "전라북도"),
    ("해외 수출 바우처", "처음 내보내는 기업에게.\n최고 1,800만원 지원. 상담 가능", "지원대상: 수출 중소기업\n지원내용: 최고 1,800만원 바우처", "2027.03.02 ~ 상시", "부산광역시"),
    ("창업 보육 공간 입주 모집", "빈 사무실을 내어 드립니다", "신청자격: 창업 7년 미만 기업\n보증금 64000000원", "상시", "대구"),
    ("직장인 부업 교실", "퇴근 뒤 듣는 교육과 멘토링", "지원대상: 재직자\u00a0및 퇴사 예정자", "", ""),
    ("청년 아이디어 단계 사업화", "만 39세 이하라면 누구나", "지원대상: 청년\n기간: 2027.02.31 ~ 2027.14.01", "2027-02-31 ~ 2027-14-01", "제주"),
    ("점포 키오스크 나눔", "전통시장 상인을 위한 설비", "지원내용: 점포당 250만원 보증 지원", "20270601", "인천광역시"),
    ("초기 창업 도약 프로그램", "성장 단계 기업의 스케일업", "지원대상: 창업 후 2년 이내 기업", "", "경상남도"),
    ("알림 문서", "세부 사항 없음", "문의 바랍니다", "", ""),
]
SINCE = dt.datetime(2026, 3, 1)


def korean_feed(spark, sf):
    """doc_id, source and the parts of one notice per document; title and body blank where the document has no such text."""
    docs = T.load(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    heads = literal_frame(spark, [(i, *h) for i, h in enumerate(HEADERS)],
                          [("h_id", "int"), ("title", "string"), ("summary", "string"), ("lines", "string"), ("period", "string"), ("area", "string")])
    n = F.length(F.coalesce("text", F.lit("")))
    other = lambda part, at: F.get(F.array(*[F.lit(h[part]) for h in HEADERS]), (at % len(HEADERS)).cast("int"))
    own_year = lambda c: F.replace(c, F.lit("2027"), (F.lit(2020) + n % 20).cast("string"))
    j = docs.join(heads, (docs.doc_id % len(HEADERS)).cast("int") == heads.h_id)
    j = j.select("doc_id", "lang", "source", "text", F.concat_ws(" ", "title", F.nullif(F.regexp_extract("text", "^([A-Za-z]+)", 1), F.lit(""))).alias("title"), "summary",
                 own_year(other(3, F.floor(n / 7))).alias("period"), other(4, n).alias("area"), own_year(F.col("lines")).alias("lines"),
                 F.concat(F.lit("지원금액: "), (n % 9000 + 1).cast("string"), F.lit("만원")).alias("amount"))
    return j.select("doc_id", "lang", "source", "title", "summary", "period", "area",
                    F.concat_ws("\n", "title", "summary", "lines", "amount", "text").alias("body"))


FEED = f"""
heads(h_id, title, summary, lines, period, area) AS (VALUES {", ".join(f"({i}, " + ", ".join(Q.q(x) for x in h) + ")" for i, h in enumerate(HEADERS))}),
own AS (SELECT *, length(coalesce(text, '')) AS n FROM documents),
feed AS (SELECT *, concat_ws(chr(10), title, summary, lines, '지원금액: ' || CAST(n % 9000 + 1 AS VARCHAR) || '만원', text) AS body
  FROM (SELECT d.doc_id, d.lang, d.source, d.text, d.n, concat_ws(' ', h.title, nullif(regexp_extract(d.text, '^([A-Za-z]+)', 1), '')) AS title, h.summary,
      replace(h.lines, '2027', CAST(2020 + d.n % 20 AS VARCHAR)) AS lines, replace(p.period, '2027', CAST(2020 + d.n % 20 AS VARCHAR)) AS period, a.area
    FROM own d JOIN heads h ON CAST(d.doc_id % {len(HEADERS)} AS INTEGER) = h.h_id JOIN heads p ON CAST(d.n // 7 % {len(HEADERS)} AS INTEGER) = p.h_id
      JOIN heads a ON CAST(d.n % {len(HEADERS)} AS INTEGER) = a.h_id))"""


@job("n14_classify_feed", sql=f"""
WITH {FEED},
f AS (SELECT *, {Q.hints('body', 200)} AS hints, {Q.period_dates('body', 60)} AS dates FROM feed),
c AS (SELECT * FROM {Q.classified('f', 'title', 'summary', 'hints')})
SELECT doc_id, 'KS-' || substr(CAST(doc_id AS VARCHAR), 1, 44) AS program_id, {Q.amount('body')} AS max_amount,
  {Q.amount_text('body', False, 120)} AS amount_text, {Q.date('dates[1]')} AS period_start, {Q.date('dates[2]')} AS period_end,
  array_to_string(stages_, '|') AS target_stages, array_to_string(segs, '|') AS target_segments, region_ AS region,
  funding_ AS funding_type, array_to_string(tags_, '|') AS normalized_tags, hints, {Q.agency('title', 'summary')} AS agency
FROM c""")
def n14_classify_feed(spark, sf):
    """N1-N4 over whole texts, N6-N13 over title, summary and labelled lines: one row per document."""
    f = korean_feed(spark, sf).withColumn("hints", K.structured_hints(F.col("body"), C.labeled))
    f = K.classify_frame(f, "title", "summary", "hints", prefix="c_").withColumn("_period", K.parse_period(F.col("body"), C.period_reach))
    return f.select(
        "doc_id", K.program_id("KS-", F.col("doc_id").cast("string"), chars=C.doc_id).alias("program_id"),
        K.parse_amount(F.col("body")).alias("max_amount"), K.amount_text(F.col("body"), chars=C.amount_text).alias("amount_text"),
        F.col("_period.start").alias("period_start"), F.col("_period.end").alias("period_end"),
        F.array_join("c_target_stages", "|").alias("target_stages"), F.array_join("c_target_segments", "|").alias("target_segments"),
        F.col("c_region").alias("region"), F.col("c_funding_type").alias("funding_type"),
        F.array_join("c_normalized_tags", "|").alias("normalized_tags"), "hints",
        K.infer_agency(F.col("title"), F.col("summary"), "").alias("agency"))


@job("n5_split_period", sql=f"""
WITH {FEED}, p AS (SELECT doc_id, {Q.period_parts('period')} AS parts FROM feed)
SELECT doc_id, {Q.date('parts[1]')} AS period_start, {Q.date('parts[2]')} AS period_end FROM p""")
def n5_split_period(spark, sf):
    p = K.split_period(F.col("period"))
    return korean_feed(spark, sf).select("doc_id", p["start"].alias("period_start"), p["end"].alias("period_end"))


# ---------------------------------------------------------------------------
# landed feeds: pages of notices as JSON, one source per third of the documents
# ---------------------------------------------------------------------------

def landed(spark, sf):
    """(portal, page, payload): envelopes of at most 20 notices, in the shapes that sources use."""
    f = korean_feed(spark, sf).withColumns({"kind": (F.col("doc_id") % 3).cast("int"), "page": F.floor(F.col("doc_id") / 60).cast("long")})
    doc = F.col("doc_id").cast("string")
    old = F.col("lang") == "en"  # older rows use the other spelling of the field names
    text = lambda c: F.when(F.col("lang") != "fr", c)  # noqa: E731  the French documents come without these fields
    row = (F.when(F.col("kind") == 0, F.to_json(F.struct(
        F.when(old, doc).alias("pbanc_sn"), F.when(~old, doc).alias("pbancSn"), F.concat(F.lit(" \u3000"), "title").alias("biz_pbanc_nm"),
        F.col("body").alias("pbanc_ctnt"), F.lit("  ").alias("aply_trgt_ctnt"), text(F.col("area")).alias("supt_regin"),
        text(F.col("source")).alias("pbanc_ntrp_nm"), F.lit("20270105").alias("pbanc_rcpt_bgng_dt"), F.regexp_extract("period", r"[0-9]{8}\z", 0).alias("pbancRcptEndDt"))))
     .when(F.col("kind") == 1, F.to_json(F.struct(
        F.concat(F.lit("PBLN_"), F.lpad(doc, 12, "0")).alias("pblancId"), F.when(F.col("lang") != "es", F.col("title")).alias("pblancNm"),
        F.col("body").alias("bsns_sumry_cn"), F.col("area").alias("areaNm"), text(F.col("source")).alias("excInsttNm"),
        text(F.lit("분야")).alias("pldirSportRealmLclasCodeNm"), F.col("period").alias("reqstBeginEndDe"), F.concat(F.lit("https://biz.example/"), doc).alias("pblancUrl"))))
     .otherwise(F.to_json(F.struct(
        doc.alias("id"), F.col("title"), F.col("summary"), text(F.col("body")).alias("_body"), F.when(old, F.col("area")).alias("region"),
        F.when(old, F.col("source")).otherwise(F.lit(K.AGENCY_PLACEHOLDER)).alias("org"), F.when(~old, F.lit("2027-09-30T00:00:00Z")).alias("deadline_at"),
        F.concat(F.lit("https://www.notices.example/"), doc).alias("source_url"),
        F.when(F.col("lang") == "de", F.lit("someday")).otherwise(F.date_format(F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("doc_id") % 200).cast("int")), "yyyy-MM-dd")).alias("published_at")))))
    pages = f.select("kind", "page", row.alias("row")).groupBy("kind", "page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("rows"))
    shape = F.get(F.array(*[F.lit(s) for s in (
        '{"data":%s}', '{"response":{"body":{"items":%s}}}', '{"response":{"body":{"items":{"item":%s}}}}', '{"body":{"items":%s}}', '{"items":{"item":%s}}', "%s")]), (F.col("page") % 6).cast("int"))
    payload = F.when(F.col("kind") == 2, F.concat(F.lit('{"total":1,"results":'), "rows", F.lit("}"))).otherwise(F.replace(shape, F.lit("%s"), F.col("rows")))
    return pages.select(F.get(F.array(F.lit("KSTARTUP"), F.lit("BIZINFO"), F.lit("ONEGOV")), F.col("kind")).alias("portal"), "page", payload.alias("payload"))


def landed_rows(spark, sf):
    pages = landed(spark, sf)
    parts = (("KSTARTUP", feeds.STARTUP_PATHS), ("BIZINFO", feeds.BIZ_PATHS), ("ONEGOV", feeds.AGGREGATE_PATHS))
    return [feeds.read_landed(pages.where(F.col("portal") == portal), "payload", paths) for portal, paths in parts]


def canonical(spark, sf):
    startup, biz, aggregate = landed_rows(spark, sf)
    return feeds.union_sources(feeds.normalize_startup(startup, C), feeds.normalize_biz(biz, C), feeds.normalize_aggregate(aggregate, C))


@job("s1_landed_rows", sql="""
SELECT CASE doc_id % 3 WHEN 0 THEN 'KSTARTUP' WHEN 1 THEN 'BIZINFO' ELSE 'ONEGOV' END AS portal,
       CASE WHEN doc_id % 3 = 1 THEN 'PBLN_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') ELSE CAST(doc_id AS VARCHAR) END AS doc
FROM documents""")
def s1_landed_rows(spark, sf):
    """Every notice of every envelope, with its document id by alias."""
    names = (feeds.STARTUP_FIELDS, feeds.BIZ_FIELDS, feeds.AGGREGATE_FIELDS)
    frames = [feeds.fields_of(rows, {"doc": n["doc"]}).select("portal", F.col("f_doc").alias("doc")) for rows, n in zip(landed_rows(spark, sf), names)]
    return frames[0].union(frames[1]).union(frames[2])


@job("s4_published_since", sql="""
SELECT doc_id AS doc FROM documents WHERE doc_id % 3 = 2
  AND (lang = 'de' OR lang IS NULL OR DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER) >= DATE '2026-03-01')""")
def s4_published_since(spark, sf):
    """Aggregator rows published since a date; unreadable dates pass."""
    f = feeds.fields_of(landed_rows(spark, sf)[2], feeds.AGGREGATE_FIELDS)
    return feeds.filter_since(f, "f_published", SINCE).select(F.col("f_doc").cast("long").alias("doc"))


def _canonical_sql() -> str:
    cols = "program_id, source_portal, source_doc_id, name, agency, field, target_stages, target_segments, region, amount_text, max_amount, funding_type, period_start, period_end, detail_url, summary, body_text, normalized_tags"
    lists = "array_to_string(stages_, '|') AS target_stages, array_to_string(segs, '|') AS target_segments"
    reg = f"CASE WHEN {Q.strip('area_')} <> '' THEN {Q.region('area_')} ELSE region_ END AS region"
    body = Q.strip("body")
    return f"""
WITH {FEED},
ks AS (SELECT *, {body} AS b, CASE WHEN lang <> 'fr' THEN area ELSE '' END AS area_, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS src FROM feed WHERE doc_id % 3 = 0),
bz AS (SELECT *, {body} AS b, area AS area_, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS src, {Q.period_parts('period')} AS parts FROM feed WHERE doc_id % 3 = 1 AND lang <> 'es'),
og0 AS (SELECT *, CASE WHEN lang <> 'fr' THEN {body} ELSE '' END AS b, CASE WHEN lang = 'en' THEN area ELSE '' END AS area_, {Q.strip('summary')} AS sm FROM feed WHERE doc_id % 3 = 2),
og AS (SELECT *, CASE WHEN b <> '' THEN b ELSE sm END AS t, {Q.hints('b', 200)} AS hints FROM og0),
og2 AS (SELECT *, {Q.period_dates('t', 60)} AS dates FROM og),
allrows AS (
  SELECT 'KS-' || doc_id::VARCHAR AS program_id, 'KSTARTUP' AS source_portal, doc_id::VARCHAR AS source_doc_id, title AS name,
    CASE WHEN src <> '' THEN src ELSE '창업진흥원' END AS agency, funding_ AS field, {lists}, {reg}, {Q.amount_text('b', False, 120)} AS amount_text,
    {Q.amounts('b', 'title')} AS max_amount, funding_ AS funding_type, DATE '2027-01-05' AS period_start,
    {Q.date("regexp_extract(period, '[0-9]{8}$', 0)")} AS period_end, '' AS detail_url, substr(b, 1, 500) AS summary, CAST(NULL AS VARCHAR) AS body_text, array_to_string(tags_, '|') AS normalized_tags
  FROM {Q.classified("(SELECT *, ' ' || area_ AS ex FROM ks)", 'title', 'b', 'ex')}
  UNION ALL
  SELECT 'BZ-' || doc_id::VARCHAR, 'BIZINFO', 'PBLN_' || lpad(doc_id::VARCHAR, 12, '0'), title, CASE WHEN src <> '' THEN src ELSE '중소벤처기업부' END,
    CASE WHEN lang <> 'fr' THEN '분야' ELSE funding_ END, {lists}, {reg}, {Q.amount_text('b', False, 120)}, {Q.amounts('b', 'title')}, funding_,
    {Q.date('parts[1]')}, {Q.date('parts[2]')}, 'https://biz.example/' || doc_id::VARCHAR, substr(b, 1, 500), NULL, array_to_string(tags_, '|')
  FROM {Q.classified("(SELECT *, ' ' || area_ AS ex FROM bz)", 'title', 'b', 'ex')}
  UNION ALL
  SELECT 'OG-' || doc_id::VARCHAR, 'ONEGOV', doc_id::VARCHAR, title, nullif(CASE WHEN lang = 'en' THEN source ELSE {Q.agency('title', 'sm')} END, ''),
    coalesce(nullif({Q.label('b', '지원분야', 200)}, ''), funding_), {lists}, {reg}, {Q.amount_text('t', True, 120)}, {Q.amounts('b', 'sm', 'title')}, funding_,
    {Q.date('dates[1]')}, CASE WHEN lang <> 'en' THEN DATE '2027-09-30' ELSE {Q.date('dates[2]')} END, 'https://www.notices.example/' || doc_id::VARCHAR,
    substr(CASE WHEN sm <> '' THEN sm ELSE b END, 1, 500), substr(nullif(b, ''), 1, 2000), array_to_string(tags_, '|')
  FROM {Q.classified('og2', 'title', 'sm', 'hints')})
SELECT {cols} FROM allrows"""


def _joined(df):
    for c in ("target_stages", "target_segments", "normalized_tags"):
        df = df.withColumn(c, F.array_join(c, "|"))
    return df


@job("s6_canonical", sql=_canonical_sql())
def s6_canonical(spark, sf):
    """Three landed feeds to one canonical notice table."""
    return _joined(canonical(spark, sf))


@job("s11_notice_detail", sql=f"SELECT * EXCLUDE (source_doc_id) FROM ({_canonical_sql()}) WHERE program_id IN (SELECT 'BZ-' || CAST(user_id AS VARCHAR) FROM events)")
def s11_notice_detail(spark, sf):
    """Details of the notices that users' events name; ids without a notice give nothing."""
    ids = T.load(spark, sf, "events", ["user_id"]).select(F.concat(F.lit("BZ-"), F.col("user_id").cast("string")).alias("program_id"))
    return _joined(feeds.notice_detail(canonical(spark, sf), ids))


@job("s9_export_round_trip", sql="""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 9 < 6 OR (doc_id % 9 = 8 AND regexp_matches(coalesce(text, ''), '^[=+@\\t\\r-]')) THEN chr(39) ELSE '' END
    || coalesce(['=', '+', '-', '@', chr(9), chr(13), '"', ' '][doc_id % 9 + 1], '') || coalesce(text, '') AS note, concat_ws(' | ', lang, source, 'a"b') AS tags
FROM documents""")
def s9_export_round_trip(spark, sf):
    """Whole texts behind characters that spreadsheets would run, written as guarded CSV and read again."""
    d = T.load(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    lead = F.get(F.array(*[F.lit(c) for c in ("=", "+", "-", "@", "\t", "\r", '"', " ", "")]), (F.col("doc_id") % 9).cast("int"))
    rows = d.select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("note"), F.array("lang", "source", F.lit('a"b')).alias("tags"))
    folder = Scratch(spark, "export").folder("csv")
    feeds.export_csv(rows, folder, ["tags"], "doc_id")
    return feeds.import_csv(spark, folder, ["doc_id", "note", "tags"])


@job("n19_normalize_phone", sql="""
SELECT id, CASE
  WHEN starts_with(regexp_replace(phone, '\\D', '', 'g'), '82') AND length(regexp_replace(phone, '\\D', '', 'g')) >= 11
    THEN regexp_replace('0' || substr(regexp_replace(phone, '\\D', '', 'g'), 3), '^(0\\d{2})(\\d{4})(\\d{4})$', '\\1-\\2-\\3')
  WHEN length(regexp_replace(phone, '\\D', '', 'g')) = 11 AND starts_with(regexp_replace(phone, '\\D', '', 'g'), '0')
    THEN regexp_replace(regexp_replace(phone, '\\D', '', 'g'), '^(0\\d{2})(\\d{4})(\\d{4})$', '\\1-\\2-\\3')
  ELSE phone END AS phone
FROM (SELECT o_orderkey AS id,
             CASE o_orderkey % 3 WHEN 0 THEN '+82 10-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '-'
                                         || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
                                 WHEN 1 THEN '010' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0')
                                 ELSE '02-' || CAST(o_custkey AS VARCHAR) END AS phone
      FROM orders)""")
def n19_normalize_phone(spark, sf):
    o = T.load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    phone = (F.when(F.col("o_orderkey") % 3 == 0,
                    F.concat(F.lit("+82 10-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"),
                             F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")))
              .when(F.col("o_orderkey") % 3 == 1,
                    F.concat(F.lit("010"), F.lpad((F.col("o_orderkey") % 100000000).cast("string"), 8, "0")))
              .otherwise(F.concat(F.lit("02-"), F.col("o_custkey").cast("string"))))
    return o.select(F.col("o_orderkey").alias("id"), K.normalize_phone(phone).alias("phone"))
