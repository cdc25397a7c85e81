"""The bindings of ``tables.py`` written as DuckDB CTEs for the SQL oracle.

The oracle sees the raw driver tables only, so each logical table is derived
again here with the same rule.
"""
from __future__ import annotations

from tidewater.functions.constants import NATIONAL, REGIONS, SEGMENTS, STAGES
from tidewater.sources.tables import (FOUNDED_YEARS, MKT_SEGMENT_CODE, PART_TYPE_CODE)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {whens} END)"


def sql_distinct2(a: str, b: str) -> str:
    """Order-keeping distinct of a two-element list whose second element is never NULL."""
    return f"(CASE WHEN ({a}) IS NULL THEN [{b}] WHEN ({a}) = ({b}) THEN [{a}] ELSE [{a}, {b}] END)"


NOTICES_CTE = rf"""
notices_base AS (
  SELECT doc_id AS program_id,
         'DOCS' AS source_portal,
         CAST(doc_id AS VARCHAR) AS source_doc_id,
         trim(split_part(text, chr(10), 1)) AS name,
         source AS agency,
         lang AS field,
         [source] AS normalized_tags,
         ({sql_list(REGIONS + [NATIONAL])})[CAST(doc_id % 18 + 1 AS INTEGER)] AS region,
         regexp_extract(text, '^[^\n]*\n([^\n]*)', 1) AS summary,
         text AS body_text,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              ELSE DATE '2026-01-01' + CAST(doc_id % 400 AS INTEGER) END AS period_end,
         doc_id % 7 <> 0 AS is_open,
         TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS synced_at,
         'https://notices.example/' || source || '/' || CAST(doc_id AS VARCHAR) AS detail_url,
         array_to_string([source], ' ') AS tags_text
  FROM documents
),
notices AS (
  SELECT *,
         lower(concat_ws(' ', coalesce(name, ''), coalesce(field, ''), coalesce(tags_text, ''),
                         coalesce(summary, ''), coalesce(agency, ''), coalesce(body_text, ''))) AS search_blob
  FROM notices_base
)"""

PROFILES_CTE = rf"""
profiles AS (
  SELECT c_custkey AS profile_id,
         c_custkey AS user_id,
         c_name AS biz_name,
         ({sql_list(FOUNDED_YEARS)})[CAST(c_custkey % 6 + 1 AS INTEGER)] AS founded_year,
         CAST(c_nationkey AS VARCHAR) AS industry_code,
         {sql_distinct2(sql_case('c_mktsegment', MKT_SEGMENT_CODE),
                        f"({sql_list(SEGMENTS)})[CAST(c_custkey % 9 + 1 AS INTEGER)]")} AS segments
  FROM customer
)"""

MATCH_NOTICES_CTE = rf"""
match_notices AS (
  SELECT p_partkey AS program_id,
         p_name AS name,
         p_brand AS agency,
         p_type AS field,
         CASE WHEN p_size % 9 = 4 THEN []::VARCHAR[]
              ELSE {sql_distinct2(sql_case('p_type', PART_TYPE_CODE),
                                  f"({sql_list(SEGMENTS)})[CAST(p_size % 9 + 1 AS INTEGER)]")} END AS target_segments,
         CASE WHEN p_size % 5 = 4 THEN []::VARCHAR[]
              ELSE [({sql_list(STAGES)})[CAST(p_size % 5 + 1 AS INTEGER)]] END AS target_stages,
         CASE WHEN p_partkey % 10 = 0 THEN [CAST(p_partkey % 25 AS VARCHAR)]
              ELSE []::VARCHAR[] END AS target_industries
  FROM part
)"""

RAW_FEED_CTE = r"""
raw_feed AS (
  SELECT event_type AS source_id,
         CAST(user_id AS VARCHAR) AS source_doc_id,
         props AS payload,
         ts AS fetched_at,
         event_id AS seq,
         value
  FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

