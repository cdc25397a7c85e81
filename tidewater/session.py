"""Session helpers.

Operators never create sessions; they take DataFrames.  These helpers only
(a) build a local session for tests/bench and (b) make sure the runtime SQL
settings every operator relies on are present on whatever session the caller
hands us (the cluster's own settings win, but for the time zone: dates are defined in UTC).
"""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tidewater.scratch import shared_dir

# Runtime SQL settings the operators rely on.  Only applied when the session
# does not already carry a value, so a cluster configuration is never overridden.
RUNTIME_DEFAULTS = {
    # Dates/timestamps are compared against fixed as-of values: pin UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

def ensure_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        if key == "spark.sql.session.timeZone":
            # a cluster may default to its local zone; results are defined in UTC
            spark.conf.set(key, value)
            continue
        try:
            current = spark.conf.get(key, None)
        except Exception:  # pragma: no cover - conf lookups never fail in practice
            current = None
        if current is None:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | None = None, app: str = "tidewater") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_runtime_conf(spark)
    shared_dir(spark)
    return spark
