"""Small shared DataFrame helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    Broadcast equi-join on a constant key: the one-row side has a proven size
    bound (it is a global aggregate) and no Cartesian product is planned.
    """
    return (df.withColumn("_one", F.lit(0))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(0))), "_one", "left")
              .drop("_one"))
