"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, BPE.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.bpe import stage_bpe
from tidewater.llm.exact_dedup import stage_exact_dedup
from tidewater.llm.jobs import RUNTIME
from tidewater.llm.mixing import stage_mixing
from tidewater.llm.near_dup import stage_near_dup
from tidewater.llm.quality import stage_quality
from tidewater.llm.shared import Scratch


def _configured(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in RUNTIME.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", _configured(stage_quality)),
    ("exact_dedup", _configured(stage_exact_dedup)),
    ("near_dedup", _configured(stage_near_dup)),
    ("mixing", _configured(stage_mixing)),
    ("bpe", _configured(stage_bpe)),
]

#: The CRF of the first stage and the tokenizer of the last have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for name, stage in STAGES[:-1]:
        out = scratch.write(stage(spark, docs, sf_dir), name)
        if held is not None:
            scratch.drop(held)
        docs = held = out
        scratch.release_shuffles()
    return STAGES[-1][1](spark, docs, sf_dir)
