"""Matching jobs (M1-M6): all profiles (customer) x all notices (part)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import matching as M
from tidewater.registry import job
from tidewater.sources import tables as T
from tidewater.sources.oracle_bindings import MATCH_NOTICES_CTE, PROFILES_CTE, with_ctes

TOP_K = 10
AS_OF_YEAR = 2026


def _inputs(spark, sf):
    profiles = T.profiles_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey",
                                                                       "c_mktsegment"]))
    notices = T.match_notices_from_part(T.load(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type",
                                                                   "p_size"]))
    return profiles, notices


PAIRS_SQL = with_ctes(PROFILES_CTE, MATCH_NOTICES_CTE) + """,
ps AS (
  SELECT *, CASE WHEN len(st) = 0 THEN ['예비'] ELSE st END AS stages FROM (
    SELECT *, list_filter([CASE WHEN founded_year = '설립 전' THEN '예비'
                                WHEN founded_year IN ('2026', '2025') THEN '1년미만'
                                WHEN founded_year IN ('2024', '2023') THEN '1-3년'
                                WHEN founded_year IS NOT NULL AND founded_year <> '' THEN '3-7년' END,
                           CASE WHEN list_contains(segments, 'SMB') THEN '소상공인' END],
                          lambda x: x IS NOT NULL) AS st
    FROM profiles)),
pairs AS (
  SELECT p.profile_id, n.program_id,
         list_filter(n.target_segments, lambda x: list_contains(p.segments, x)) AS ov,
         len(list_filter(n.target_stages, lambda x: list_contains(p.stages, x))) > 0 AS sm,
         len(n.target_industries) AS ni,
         coalesce(list_contains(n.target_industries, p.industry_code), false) AS im,
         len(n.target_segments) AS nt
  FROM ps p, match_notices n),
passing AS (
  SELECT *,
         CASE WHEN nt = 0 THEN 25 ELSE CAST(floor((len(ov) * 100 + nt) / (2 * nt)) AS INTEGER) END AS seg,
         CASE WHEN sm THEN 25 ELSE 8 END AS stg,
         CASE WHEN ni = 0 OR im THEN 15 ELSE 8 END AS ind
  FROM pairs WHERE (ni = 0 OR im) AND (len(ov) > 0 OR sm)),
scored AS (
  SELECT profile_id, program_id, CAST(least(100, greatest(0, seg + stg + ind + 6)) AS INTEGER) AS match_score,
         seg, stg, ind,
         list_filter([CASE WHEN len(ov) > 0 THEN '세그먼트 일치 (' || array_to_string(ov, ', ') || ')' END,
                      CASE WHEN sm THEN '사업 단계 적합' END,
                      CASE WHEN ni = 0 THEN '전 업종 대상' WHEN im THEN '업종 적합' END],
                     lambda x: x IS NOT NULL) AS evidence
  FROM passing)
"""


@job("m6_top_matches", sql=PAIRS_SQL + f"""
SELECT profile_id, CAST(rank AS INTEGER) AS rank, program_id, match_score,
       seg AS bd_segment, stg AS bd_stage, ind AS bd_industry, 6 AS bd_base,
       array_to_string(evidence, ' / ') AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY match_score DESC, program_id ASC) AS rank
      FROM scored)
WHERE rank <= {TOP_K}""")
def m6_top_matches(spark, sf):
    """Top-10 notices per profile with score breakdown and evidence."""
    ranked, _ = M.match(*_inputs(spark, sf), page_size=TOP_K, as_of_year=AS_OF_YEAR)
    return ranked.select(
        "profile_id", F.col("rank").cast("int").alias("rank"), "program_id", "match_score",
        F.col("breakdown.segment").alias("bd_segment"), F.col("breakdown.stage").alias("bd_stage"),
        F.col("breakdown.industry").alias("bd_industry"), F.col("breakdown.base").alias("bd_base"),
        F.array_join("evidence", " / ").alias("evidence"))


@job("m6_match_totals", sql=PAIRS_SQL + """
SELECT p.profile_id, CAST(coalesce(c.total, 0) AS BIGINT) AS total
FROM profiles p LEFT JOIN (SELECT profile_id, count(*) AS total FROM scored GROUP BY 1) c USING (profile_id)""")
def m6_match_totals(spark, sf):
    """Number of notices passing the hard filter, per profile (every profile listed)."""
    _, totals = M.match(*_inputs(spark, sf), page_size=TOP_K, as_of_year=AS_OF_YEAR)
    return totals


@job("m1_derive_stages", sql=with_ctes(PROFILES_CTE) + """
SELECT profile_id, array_to_string(CASE WHEN len(st) = 0 THEN ['예비'] ELSE st END, '|') AS stages FROM (
  SELECT profile_id, list_filter([CASE WHEN founded_year = '설립 전' THEN '예비'
                                       WHEN founded_year IN ('2026', '2025') THEN '1년미만'
                                       WHEN founded_year IN ('2024', '2023') THEN '1-3년'
                                       WHEN founded_year IS NOT NULL AND founded_year <> '' THEN '3-7년' END,
                                  CASE WHEN list_contains(segments, 'SMB') THEN '소상공인' END],
                                 lambda x: x IS NOT NULL) AS st
  FROM profiles)""")
def m1_derive_stages(spark, sf):
    profiles, _ = _inputs(spark, sf)
    return profiles.select("profile_id", F.array_join(
        M.derive_stages(F.col("founded_year"), F.col("segments"), AS_OF_YEAR), "|").alias("stages"))
