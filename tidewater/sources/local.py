"""Small literal tables built inside the JVM (no Python-backed RDD).

``createDataFrame(list)`` parallelizes pickled rows, so every stage that scans
such a frame starts Python workers.  Search tables and lexicons are literals
that belong in the plan itself: ``inline`` of a literal array of structs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_frame(spark: SparkSession, rows, fields: list[tuple[str, str]]) -> DataFrame:
    """rows: iterable of tuples; fields: (name, spark SQL type) in column order."""
    struct_type = "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>"
    items = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    arr = F.array(*items).cast(struct_type) if items else F.array().cast(struct_type)
    return spark.range(0, 1, 1, 1).select(F.inline(arr))
