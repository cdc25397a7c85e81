"""The table of searches run against the documents corpus (our own cases).

Each case mirrors one behaviour of the search flow: synonyms, generic-word
exclusion, AND of concepts, phrases, spelling, acronym boundaries, compounds,
joined neighbours, concept dedup, region and open filters, out-of-range pages,
weak and browse routes, and the expansion gates.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidewater.sources.local import literal_frame

# (query_id, q, region, open_only, page, page_size)
SEARCHES = [
    (1, "license", "", False, 1, 20),
    (2, "apache license", "", False, 1, 20),
    (3, "the der", "", False, 1, 20),
    (4, '"apache license" version', "", False, 1, 20),
    (5, "tion schpf", "", False, 1, 20),
    (6, "password", "", False, 1, 20),
    (7, "cookie jar", "", False, 1, 20),
    (8, "", "", False, 2, 20),
    (9, "the and", "", False, 1, 20),
    (10, "licnese", "", False, 1, 20),
    (11, "mit", "", False, 1, 20),
    (12, "license", "서울", True, 1, 20),
    (13, "tion", "", False, 400, 20),
    (14, "apachelicense", "", False, 1, 20),
    (15, "licence license", "", False, 1, 20),
    (16, "ai", "", False, 1, 10),
    (17, "zzqx", "", False, 1, 20),
    (18, 'der "zzqx qq"', "", False, 1, 20),
    (19, "token gratis", "", False, 1, 20),
    (20, "apache  「license」", "부산", False, 1, 5),
    (21, "", "제주", True, 1, 20),
    (22, "under find", "", True, 1, 20),
    (23, "schpf und les que", "", False, 1, 20),
    (24, "mitlicense", "", False, 1, 20),
]

SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("q", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("open_only", T.BooleanType()),
    T.StructField("page", T.IntegerType()), T.StructField("page_size", T.IntegerType()),
])


FIELDS = [("query_id", "bigint"), ("q", "string"), ("region", "string"), ("open_only", "boolean"),
          ("page", "int"), ("page_size", "int")]


def searches(spark: SparkSession):
    return literal_frame(spark, SEARCHES, FIELDS)
