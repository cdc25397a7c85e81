"""Text column functions shared by the planner and the normalizers."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.constants import MIDDLE_DOTS, ORNAMENT_BRACKETS


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC (no Spark built-in).  Arrow-batched; used on search tables only."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def normalize_query(c: Column) -> Column:
    """Q2: middle dots -> space before NFKC and again after; ornament brackets -> space;
    whitespace runs -> one space; trim."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{MIDDLE_DOTS}]", " ")
    t = nfkc(t)
    t = F.regexp_replace(t, "[ᆞᆢ]", " ")
    t = F.regexp_replace(t, f"[{ORNAMENT_BRACKETS}]", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


def leading_int(c: Column) -> Column:
    """The whole number that a text begins with ('12 people' -> 12), else NULL."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")
